"""Results of a run as tables on disk."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import analysis as A
from ..operators.cluster import Model
from .files import encode_fits, encode_png


def write_run(model: Model, out: str, clusters: bool = False, averages: bool = False, all_distances: bool = False, clustered: bool = False) -> None:
    """One Parquet table for each result under `out`; members partitioned by cluster if `clusters`."""
    tables = {
        "membership": model.membership.select("frame_id", "cluster_id", "dist"), "anchors": model.anchors(), "dcc": both_orders(model.dcc(), model.anchors()),
        "transition_matrix": model.transitions(), "cluster_counts": model.counts(), "cluster_radii": model.radii(), "discarded": model.discarded(), "run_log": run_log(model),
    }
    if all_distances:
        tables["distall"] = model.all_distances()
    if averages:
        tables["average"] = A.centroids(model.frames, model.membership)
    if clustered:
        tables["clustered"] = model.clustered()
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")
    if clusters:
        members = model.clustered().where("cluster_id >= 0")
        members.repartition("cluster_id").write.mode("overwrite").partitionBy("cluster_id").parquet(f"{out}/clusters")


def both_orders(dcc: DataFrame, anchors: DataFrame) -> DataFrame:
    """Anchor distances in both orders and with the diagonal."""
    same = anchors.select(F.col("cluster_id").alias("i"), F.col("cluster_id").alias("j"), F.lit(0.0).alias("dist"))
    return dcc.unionByName(dcc.select(F.col("j").alias("i"), F.col("i").alias("j"), "dist")).unionByName(same)


def run_log(model: Model) -> DataFrame:
    """(key, value): options, counters and metrics."""
    spark = model.frames.sparkSession
    options = spark.createDataFrame([(f"option.{k}", json.dumps(v)) for k, v in asdict(model.config).items()], "key string, value string")
    for prefix, one in (("telemetry", model.telemetry()), ("metrics", model.metrics())):
        pairs = F.array(*[F.struct(F.lit(f"{prefix}.{c}").alias("key"), F.col(c).cast("string").alias("value")) for c in one.columns])
        options = options.unionByName(one.select(F.inline(pairs)))
    return options


def run_log_lines(model: Model) -> list[str]:
    """The run log as text: options, counters, and the blocks of frames by probes and of failed probes by cluster.

    The blocks have at most as many rows as there are clusters.
    """
    t = model.telemetry().first()
    frames, failed = A.probe_statistics(model.membership, model.config.rlim)
    lines = [f"PARAM_{k.upper()}: {json.dumps(v)}" for k, v in asdict(model.config).items()]
    lines += [f"STATS_CLUSTERS: {t['clusters_made']}", f"STATS_FRAMES: {t['frames']}", f"STATS_DISTS_SAMPLE: {t['sample_distances']}", f"STATS_PRUNED: {t['pruned']}"]
    lines += [f"STATS_PRED_ATTEMPTS: {t['predictions']}", f"STATS_PRED_HITS: {t['hits']}"]
    lines += ["STATS_DIST_HIST_START", *[f"{r['n_evals']} {r['frames']} {r['pruned']}" for r in frames.orderBy("n_evals").collect()], "STATS_DIST_HIST_END"]
    lines += ["STATS_CLUSTER_QUERIES_START", *[f"{r['cluster_id']} {r['failed']}" for r in failed.orderBy("cluster_id").collect()], "STATS_CLUSTER_QUERIES_END"]
    return lines + [f"# Pruning Step {r['depth']}: {r['pruned_fraction']:.4f}" for r in A.pruned_by_depth(model.membership).orderBy("depth").collect()]


def write_binary(df: DataFrame, path: str, suffix: str) -> None:
    """(name, content) as one file each, `path/name` + suffix, written by the tasks through Hadoop's file systems."""
    spark = df.sparkSession
    names = df.select("name").distinct().count()
    if names != df.count():
        raise ValueError("names are not distinct")
    os.makedirs(path, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                with open(os.path.join(path, f"{name}{suffix}"), "wb") as f:
                    f.write(content.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    spark.sparkContext.setJobDescription(f"write {suffix} files")
    df.select("name", "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def anchor_images(anchors: DataFrame, width: int, height: int, kind: str = "png") -> DataFrame:
    """(name, content): each anchor as a PNG (clipped to 0..255) or FITS image of width x height pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = [np.asarray(a.as_py(), float).reshape(height, width) for a in batch.column("anchor")]
            content = [encode_png(x) if kind == "png" else encode_fits(x[None]) for x in images]
            yield pa.RecordBatch.from_arrays([pa.array([f"anchor_{c:05d}" for c in batch.column("cluster_id").to_pylist()]), pa.array(content, pa.binary())], names=["name", "content"])

    return anchors.mapInArrow(run, "name string, content binary")


def write_anchor_images(anchors: DataFrame, path: str, width: int, height: int, kind: str = "png") -> None:
    """A file for each anchor in a folder that all executors share."""
    write_binary(anchor_images(anchors, width, height, kind), path, f".{kind}")


def knn_fits(padded: DataFrame) -> DataFrame:
    """(name, content): for each range of queries a FITS cube of two planes, neighbours and distances, a row for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, near, dist = [], [], []
        for batch in batches:
            ids += batch.column("query_id").to_pylist()
            near += batch.column("neighbors").to_pylist()
            dist += batch.column("dists").to_pylist()
        if ids:
            cube = np.stack([np.array(near, float), np.array(dist, float)])
            yield pa.RecordBatch.from_arrays([pa.array([f"knn_{ids[0]:012d}"]), pa.array([encode_fits(cube)], pa.binary())], names=["name", "content"])

    return padded.repartitionByRange("query_id").sortWithinPartitions("query_id").mapInArrow(run, "name string, content binary")


def write_text(df: DataFrame, path: str, order: str, columns: list[str]) -> None:
    """Rows as values separated by spaces, arrays spelled out, in order over the part files."""
    line = F.concat_ws(" ", *[F.concat_ws(" ", F.transform(F.col(c), lambda v: v.cast("string"))) if dict(df.dtypes)[c].startswith("array") else F.col(c).cast("string") for c in columns])
    df.repartitionByRange(order).sortWithinPartitions(order).select(line.alias("value")).write.mode("overwrite").text(path)


def write_knn_text(padded: DataFrame, path: str) -> None:
    """`query id dist id dist ...`; missing neighbours are -1 -1.0."""
    pairs = F.flatten(F.zip_with("neighbors", "dists", lambda n, d: F.array(n.cast("string"), d.cast("string"))))
    write_text(padded.select("query_id", pairs.alias("pairs")), path, "query_id", ["query_id", "pairs"])


def clustered_lines(model: Model) -> DataFrame:
    """The clustered table as text lines: header, `# NEWCLUSTER id frame anchor`, `frame cluster data`."""
    text = lambda c: F.concat_ws(" ", F.transform(F.col(c), lambda v: v.cast("string")))
    head = model.anchors().select(F.col("anchor_id").alias("frame_id"), F.lit(0).alias("kind"), F.concat_ws(" ", F.lit("# NEWCLUSTER"), "cluster_id", "anchor_id", text("anchor")).alias("value"))
    rows = model.clustered().select("frame_id", F.lit(1).alias("kind"), F.concat_ws(" ", "frame_id", "cluster_id", text("data")).alias("value"))
    first = model.frames.sparkSession.createDataFrame([(-1, 0, f"# rlim {model.config.rlim}")], "frame_id long, kind int, value string")
    return first.unionByName(head).unionByName(rows)


def analysis_json(model: Model) -> DataFrame:
    """One JSON document: options, counters, entropy, topology, and what is known of each cluster and of the commonest moves."""
    m, c = model.membership, model.config
    life = A.lifetimes(m).select(F.col("cluster_id").alias("id"), "size", "birth_frame", "death_frame", "duty")
    moves = A.transitions(m)
    each = life.join(A.dwell(moves).select(F.col("src").alias("id"), "p_stay", "dwell"), "id", "left").join(A.spread(model.frames, m, model.anchors()).withColumnRenamed("cluster_id", "id"), "id", "left")
    clusters = each.agg(F.array_sort(F.collect_list(F.struct("id", "size", "birth_frame", "death_frame", "duty", "p_stay", "dwell", "mean_dist", "max_dist", "std_dist"))).alias("clusters"))
    top = moves.where("src <> dst").orderBy(F.desc("n"), "src", "dst").limit(5).agg(F.collect_list(F.struct("src", "dst", "n")).alias("top_transitions"))
    parts = [
        A.cluster_entropy(m).select(F.struct("k", "entropy", "evenness").alias("entropy")),
        model.telemetry().select(F.struct("*").alias("stats")), A.topology(model.dcc(), c.rlim).select(F.struct("*").alias("topology")), top, clusters,
    ]
    # one row each
    one = parts[0]
    for part in parts[1:]:
        one = one.crossJoin(part)
    params = F.struct(F.lit(c.rlim).alias("rlim"), F.lit(c.dprob).alias("dprob"), F.lit(c.maxcl).alias("maxcl"))
    return one.select(F.to_json(F.struct(params.alias("params"), "stats", "entropy", "topology", "top_transitions", "clusters")).alias("json"))


def render_spot(v: np.ndarray, size: int, alpha: float, default_third: float = 0.0) -> np.ndarray:
    """A vector as an image: a Gaussian spot at (v1, v2), as wide as v3, 255 at its centre."""
    third = v[2] if len(v) > 2 else default_third
    cx, cy, sigma = (v[0] + 1.5) / 3 * size, (1 - (v[1] + 1.5) / 3) * size, size * alpha * (third + 1.5) / 2
    yy, xx = np.mgrid[:size, :size]
    return 255 * np.exp(-((xx - cx) ** 2 + (yy - cy) ** 2) / (2 * sigma**2))
