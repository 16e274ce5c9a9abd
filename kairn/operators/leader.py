"""Exact leader clustering: a frame is an anchor if no earlier anchor is within rlim of it.

The anchors don't depend on the order in which a frame's candidates are probed, so they can be found
in blocks: a distributed filter drops the frames of a block that an anchor so far covers, and only
what is left is decided in order, on the driver. Work is frames x anchors, spread over the cluster;
what reaches the driver is bounded by max_anchors and the size of a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.metric import distances

#: Anchors are held by the driver and sent to every task.
MAX_ANCHORS = 100_000
ANCHORS = T.StructType([T.StructField("cluster_id", T.LongType()), T.StructField("anchor_id", T.LongType()), T.StructField("anchor", T.ArrayType(T.DoubleType()))])


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as a matrix, one row for each list; all have one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _uncovered(frames: DataFrame, anchors: np.ndarray, rlim: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("data"))
                free = np.ones(len(x), bool)
                for a in anchors:
                    at = np.flatnonzero(free)
                    if not len(at):
                        break
                    d = x[at] - a
                    free[at[np.sqrt(np.einsum("ij,ij->i", d, d)) < rlim]] = False
                yield batch.filter(pa.array(free))

    return frames.mapInArrow(run, frames.schema) if len(anchors) else frames


def leader_anchors(frames: DataFrame, rlim: float, block: int = 20_000, max_anchors: int = MAX_ANCHORS) -> DataFrame:
    """(cluster_id, anchor_id, anchor) in order of discovery. A match is a distance under rlim.

    Blocks are ranges of frame_id that grow while few frames of a block are left uncovered. More
    than max_anchors anchors are refused rather than collected.
    """
    spark = frames.sparkSession
    frames = frames.select("frame_id", "data").where("data IS NOT NULL")
    low, high = frames.agg(F.min("frame_id"), F.max("frame_id")).first()
    found: list[tuple[int, np.ndarray]] = []
    while low is not None and low <= high:
        part = frames.where((F.col("frame_id") >= low) & (F.col("frame_id") < low + block))
        left = _uncovered(part, np.array([a for _, a in found]), rlim).orderBy("frame_id")
        own: list[np.ndarray] = []
        seen = 0
        for r in left.toLocalIterator():
            seen += 1
            x = np.array(r["data"])
            if not own or not (np.sqrt(((np.array(own) - x) ** 2).sum(axis=1)) < rlim).any():
                own.append(x)
                found.append((r["frame_id"], x))
                if len(found) > max_anchors:
                    raise ValueError(f"more than {max_anchors} anchors; use a larger radius")
        low += block
        if 4 * seen < block:
            block *= 2
    return spark.createDataFrame([(k, i, a.tolist()) for k, (i, a) in enumerate(found)], ANCHORS)


def assign(frames: DataFrame, anchors: DataFrame, rlim: float | None = None, how: str = "nearest") -> DataFrame:
    """(frame_id, cluster_id, dist): each frame with its nearest anchor, or its `first` one under rlim.

    Anchors go to all tasks: they are at most MAX_ANCHORS rows. With rlim, frames without an anchor
    under it get cluster -1 and no distance. Ties go to the lowest cluster id.
    """
    rows = anchors.orderBy("cluster_id").limit(MAX_ANCHORS + 1).collect()
    if len(rows) > MAX_ANCHORS:
        raise ValueError(f"more than {MAX_ANCHORS} anchors")
    ids, points = np.array([r["cluster_id"] for r in rows]), np.array([r["anchor"] for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = distances(matrix(batch.column("data")), points)
            inside = d < rlim if rlim is not None else np.ones(d.shape, bool)
            best = np.where(inside, d, np.inf).argmin(axis=1) if how == "nearest" else inside.argmax(axis=1)
            hit = inside[np.arange(len(d)), best]
            dist = d[np.arange(len(d)), best]
            yield pa.RecordBatch.from_arrays(
                [batch.column("frame_id"), pa.array(np.where(hit, ids[best], -1)), pa.array(dist, mask=~hit)], names=["frame_id", "cluster_id", "dist"]
            )

    return frames.select("frame_id", "data").mapInArrow(run, "frame_id long, cluster_id long, dist double")
