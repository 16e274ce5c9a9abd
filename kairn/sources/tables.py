"""Frames from tables: (frame_id, data), ordered by frame_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metric import doubles


def vector_frames(df: DataFrame, order: str, vector: str, by: list[str] | None = None) -> DataFrame:
    """Frames from an array column. Float elements are widened to doubles."""
    return df.select(*(by or []), F.col(order).cast("long").alias("frame_id"), doubles(vector).alias("data"))


def column_frames(df: DataFrame, order: Column, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Frames from scalar columns."""
    return df.select(*(by or []), order.cast("long").alias("frame_id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("data"))


def first_frames(frames: DataFrame, n: int) -> DataFrame:
    """The first n frames by order."""
    return frames.where(F.col("frame_id") < n)
