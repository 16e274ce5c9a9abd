"""Coordinates from distances by simulated annealing, and runs over grids of options."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import analysis as A

#: Points of an embedding; their distances are held by one task for each restart.
MAX_POINTS = 2000


def anneal(target: np.ndarray, known: np.ndarray, dims: int, temperature: float, rate: float, steps: int, seed: int) -> tuple[np.ndarray, float]:
    """Points whose distances are near target where known: one point moves at a time, by the Metropolis rule."""
    rng, n = np.random.default_rng(seed), len(target)
    x = rng.uniform(-1, 1, (n, dims)) * (target[known].mean() if known.any() else 1)

    def misfit(i: int, p: np.ndarray) -> float:
        d = np.sqrt(((x - p) ** 2).sum(axis=1))
        e = (d - target[i]) ** 2
        e[i] = 0
        return float(e[known[i]].sum())

    for _ in range(steps):
        if temperature < 1e-5:
            break
        i = int(rng.integers(n))
        new = x[i] + rng.normal(0, 0.1 * np.sqrt(temperature) + 1e-3, dims)
        change = misfit(i, new) - misfit(i, x[i])
        if change < 0 or rng.random() < np.exp(-change / temperature):
            x[i] = new
        temperature *= rate
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    return x, float(((d - target) ** 2)[np.triu(known, 1)].sum())


def embed(dcc: DataFrame, dims: int, temperature: float = 10, rate: float = 0.995, steps: int = 100_000, restarts: int = 4, seed: int = 0) -> DataFrame:
    """(cluster_id, point, energy) of the best of several restarts, which run in parallel."""
    spark = dcc.sparkSession
    rows = dcc.where("i < j").limit(MAX_POINTS * (MAX_POINTS - 1) // 2 + 1).collect()
    ids = sorted({i for r in rows for i in (r["i"], r["j"])})
    if len(ids) > MAX_POINTS:
        raise ValueError(f"more than {MAX_POINTS} points")
    at = {c: k for k, c in enumerate(ids)}
    target, known = np.zeros((len(ids),) * 2), np.zeros((len(ids),) * 2, bool)
    for r in rows:
        a, b = at[r["i"]], at[r["j"]]
        target[a, b] = target[b, a] = r["dist"]
        known[a, b] = known[b, a] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                x, energy = anneal(target, known, dims, temperature, rate, steps, seed + k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(x.tolist(), pa.list_(pa.float64())), pa.array([energy] * len(ids), pa.float64())],
                    names=["restart", "cluster_id", "point", "energy"],
                )

    tried = spark.range(0, restarts, 1, restarts).mapInArrow(run, "restart long, cluster_id long, point array<double>, energy double")
    return tried.groupBy("cluster_id").agg(F.min_by(F.struct("point", "energy"), F.struct("energy", "restart")).alias("b")).select("cluster_id", "b.point", "b.energy")


def tune(frames: DataFrame, side: int | None = None, rows: int = 2000, maxcl: int = 2000) -> DataFrame:
    """Runs over the first rows with radii and tile grids scaled from the median distance.

    (setting, rlim, tiles, clusters, joint_states, distances_per_frame). side: image width, for tiles.
    """
    from .cluster import fit
    from .tiles import fit_tiles, grid_tiles, tuples

    some = frames.where(F.col("frame_id") < rows)
    median = A.scan_statistics(some).first()["d_median"]
    out = None
    for grid, factor in (("1x1", 1.5), ("2x2", 1.5 * 0.92), ("3x3", 1.5 * 0.75)):
        config = replace(EngineConfig(), rlim=factor * median, maxcl=maxcl, maxim=rows)
        if grid == "1x1" or not side:
            member = fit(some, config).withColumn("tile_id", F.lit(0))
        else:
            member = fit_tiles(some, config, grid_tiles(side, side, grid))
        joint = tuples(member).select(F.countDistinct("tuple").alias("joint_states"))
        one = member.agg(F.countDistinct("tile_id", "cluster_id").alias("clusters"), (F.sum(F.size("evals")) / F.countDistinct("frame_id")).alias("distances_per_frame")).crossJoin(joint)
        one = one.select(F.lit(grid).alias("tiles"), F.lit(config.rlim).alias("rlim"), "clusters", "joint_states", "distances_per_frame")
        out = one if out is None else out.unionByName(one)
    return out
