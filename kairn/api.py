"""The library in one place: batch functions, and a session that is fed frame by frame."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import EngineConfig
from .functions import analysis
from .operators.cluster import Model, cluster
from .operators.knn import Search, knn
from .operators.stepper import FrameStepper, Step
from .operators.tiles import JointStepper, Tiles, fit_tiles, grid_tiles, map_tiles, tuples
from .sources.files import decode_fits
from .streaming.fit import fit_stream

__all__ = ["EngineConfig", "Model", "Search", "Session", "analyze", "cluster", "fit_stream", "joint_metrics", "knn", "read_tile_config", "read_tile_map", "run", "scandist"]


def run(frames: DataFrame, config: EngineConfig, width: int | None = None, tiles: Tiles | None = None) -> DataFrame:
    """Membership of a run; with tiles (a map, or the grid of config.tiles over images of `width`) one row for each tile."""
    if tiles is None and config.tiles:
        size = frames.select(F.size("data")).first()[0]
        wide = width or int(size**0.5)
        tiles = grid_tiles(wide, size // wide, config.tiles)
    return fit_tiles(frames, config, tiles) if tiles else cluster(frames, config).membership


def scandist(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Consecutive distances, and their statistics."""
    return analysis.sequential_distances(frames), analysis.scan_statistics(frames)


def analyze(model: Model) -> dict[str, DataFrame]:
    """All statistics of a run as tables."""
    m = model.membership
    moves = analysis.transitions(m)
    return {
        "metrics": analysis.cluster_metrics(m), "entropy": analysis.cluster_entropy(m), "lifetimes": analysis.lifetimes(m), "transitions": moves, "dwell": analysis.dwell(moves),
        "topology": analysis.topology(model.dcc(), model.config.rlim), "spread": analysis.spread(model.frames, m, model.anchors()), "discovery": analysis.cumulative_clusters(m), "spectrum": analysis.rank_spectrum(m, "cluster_id"),
    }


def joint_metrics(member: DataFrame) -> DataFrame:
    """One row for a tiled run: joint states, and root mean square and greatest joint distances.

    A joint distance is the root of the sum of squared tile distances of a frame.
    """
    joint = tuples(member).join(member.groupBy("frame_id").agg(F.sum(F.col("dist") * F.col("dist")).alias("sq")), "frame_id").where(~F.array_contains("tuple", -1))
    each = joint.groupBy("tuple").agg(F.count("*").alias("n"), F.sum("sq").alias("sq"), F.max("sq").alias("far"))
    total = F.sum("n")
    return each.agg(
        F.count("*").alias("joint_states"), F.sqrt(F.sum("sq") / total).alias("joint_rms"), F.avg(F.sqrt(F.col("sq") / F.col("n"))).alias("mean_tuple_rms"),
        F.sqrt(F.max("far")).alias("max_dist"), (F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total).alias("entropy"),
    )


def read_tile_map(path: str, width: int, height: int) -> Tiles:
    """Tiles from a FITS image of tile ids with the size of the frames."""
    with open(path, "rb") as f:
        image = decode_fits(f.read())
    if image.shape != (1, height, width):
        raise ValueError("the tile map has another size than the frames")
    return map_tiles(image.astype(int).ravel().tolist())


def read_tile_config(path: str, base: EngineConfig) -> dict[int, EngineConfig]:
    """Options of single tiles from lines `tile rlim maxcl`; # starts a comment."""
    from dataclasses import replace

    with open(path) as f:
        rows = [r for line in f if (r := line.split("#")[0].split())]
    return {int(t): replace(base, rlim=float(r), maxcl=int(n)) for t, r, n in rows}


class Session:
    """A clustering that is fed frames one by one, on the driver: for interactive use and small runs."""

    def __init__(self, config: EngineConfig, tiles: Tiles | None = None):
        self.config, self.tiles = config, tiles
        self.reset()

    def reset(self) -> None:
        self._engine = JointStepper(self.config, self.tiles) if self.tiles else FrameStepper(self.config)
        self.steps: list[Step] = []
        self.same_as_last = 0

    @property
    def _first(self) -> FrameStepper:
        return self._engine.steppers[0] if self.tiles else self._engine

    def process_frame(self, x: Iterable[float]) -> int | tuple[int, ...]:
        """The cluster of a frame (creation number); of all tiles, with tiles."""
        if self.tiles:
            out = self._engine.step(np.asarray(list(x), float))
            self.steps.append(out[min(out)])
            return tuple(s.cluster for s in out.values())
        step = self._engine.step(np.asarray(list(x), float))
        self.same_as_last += bool(self.steps) and self.steps[-1].cluster == step.cluster
        self.steps.append(step)
        return step.cluster

    def process_batch(self, frames: Iterable[Iterable[float]]) -> list:
        return [self.process_frame(x) for x in frames]

    def num_clusters(self) -> int:
        return self._first.k

    def capacity(self) -> int:
        return len(self._first.prob)

    def anchors(self) -> np.ndarray:
        return self._first.anchors[: self._first.k].copy()

    def dcc(self) -> np.ndarray:
        return self._first.high[: self._first.k, : self._first.k].copy()

    def transition_matrix(self) -> np.ndarray:
        return self._first.moves[: self._first.k, : self._first.k].copy()

    def probabilities(self) -> np.ndarray:
        return self._first.prob[: self._first.k].copy()

    def evaluations(self) -> list[tuple[int, float]]:
        """What was measured for the last frame."""
        return self.steps[-1].evals if self.steps else []

    def telemetry(self) -> dict[str, float]:
        steps = self.steps
        return {
            "frames": len(steps), "clusters": self._first.k, **self._first.calls, "pruned": sum(s.pruned for s in steps),
            "predictions": sum(s.predicted for s in steps), "hits": sum(s.hit for s in steps), "same_as_last": self.same_as_last,
        }
