"""Seeded synthetic sequences as DataFrames (frame_id, data)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TAU = 2 * math.pi


def _indexed(spark: SparkSession, n: int, *data: Column) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "frame_id").select("frame_id", F.array(*[c.cast("double") for c in data]).alias("data"))


def uniform(seed: int, key: str = "frame_id") -> Column:
    """Uniform in [0, 1) from a hash of the row's key: however rows are dealt, a seed gives the same data."""
    return (F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed)), 11) / F.lit(float(1 << 53))).cast("double")


def normal(seed: int, key: str = "frame_id") -> Column:
    """Standard normal values, by the Box-Muller transform of two uniforms."""
    return F.sqrt(-2 * F.log(1 - uniform(2 * seed, key))) * F.cos(TAU * uniform(2 * seed + 1, key))


def circle(spark: SparkSession, n: int, period: float | None = None) -> DataFrame:
    """Points of the unit circle, one turn in `period` frames (all of them by default)."""
    angle = F.lit(TAU) * F.col("frame_id") / F.lit(float(period or n))
    return _indexed(spark, n, F.cos(angle), F.sin(angle))


def spiral(spark: SparkSession, n: int, loops: float = 2, dims: int = 2) -> DataFrame:
    """r = t at angle 2 pi loops t; in three dimensions a cone, turned by 60 and 30 degrees."""
    t = F.col("frame_id") / F.lit(float(n))
    angle = F.lit(TAU * loops) * t
    x, y = t * F.cos(angle), t * F.sin(angle)
    if dims == 2:
        return _indexed(spark, n, x, y)
    # a thin cone along z from -1 to 1, turned about y and then about x
    along = 2 * t - 1
    x, y = 0.15 * x, 0.15 * y
    about_y, about_x = math.radians(60), math.radians(30)
    side = along * math.cos(about_y) - x * math.sin(about_y)
    return _indexed(
        spark, n, x * math.cos(about_y) + along * math.sin(about_y), y * math.cos(about_x) - side * math.sin(about_x), y * math.sin(about_x) + side * math.cos(about_x)
    )


def random_ball(spark: SparkSession, n: int, dims: int, seed: int) -> DataFrame:
    """Uniform in the unit disc (2) or ball (3); in the cube [-1, 1] for other dimensions."""
    if dims not in (2, 3):
        return _indexed(spark, n, *[2 * uniform(seed + k) - 1 for k in range(dims)])
    angle = TAU * uniform(seed + 1)
    if dims == 2:
        r = F.sqrt(uniform(seed))
        return _indexed(spark, n, r * F.cos(angle), r * F.sin(angle))
    r, z = F.cbrt(uniform(seed)), 2 * uniform(seed + 2) - 1
    base = spark.range(n).withColumnRenamed("id", "frame_id").select("frame_id", r.alias("r"), angle.alias("a"), z.alias("z"))
    flat = F.col("r") * F.sqrt(1 - F.col("z") * F.col("z"))
    return base.select("frame_id", F.array(flat * F.cos("a"), flat * F.sin("a"), F.col("r") * F.col("z")).alias("data"))


def random_gauss(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """A normal cloud in three dimensions that has 1% of its peak density at radius 1, cut off there."""
    sigma = 1 / math.sqrt(-2 * math.log(0.01))
    raw = spark.range(2 * n + 1000).select("id", *[(normal(seed + k, "id") * sigma).alias(f"x{k}") for k in range(3)])
    inside = raw.where("x0 * x0 + x1 * x1 + x2 * x2 <= 1").orderBy("id").limit(n)
    return renumbered(inside.select(F.col("id").alias("frame_id"), F.array("x0", "x1", "x2").alias("data")))


def sphere(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """Uniform on the unit sphere."""
    base = spark.range(n).select(F.col("id").alias("frame_id"), (2 * uniform(seed, "id") - 1).alias("z"), (TAU * uniform(seed + 1, "id")).alias("a"))
    flat = F.sqrt(1 - F.col("z") * F.col("z"))
    return base.select("frame_id", F.array(flat * F.cos("a"), flat * F.sin("a"), F.col("z")).alias("data"))


def fibonacci_sphere(spark: SparkSession, n: int) -> DataFrame:
    z = 1 - (2 * F.col("frame_id") + 1) / F.lit(float(n))
    angle = F.col("frame_id") * (math.pi * (3 - math.sqrt(5)))
    return _indexed(spark, n, F.sqrt(1 - z * z) * F.cos(angle), F.sqrt(1 - z * z) * F.sin(angle), z)


def star(spark: SparkSession, n: int, nodes: int = 20) -> DataFrame:
    """Frames cycle through nodes: the origin, then golden-angle directions at radii 1.5, 2, 2.5, ..."""
    k = (F.col("frame_id") % nodes).cast("double")
    z = 1 - 2 * k / nodes
    flat, turn = F.sqrt(1 - z * z), k * (math.pi * (1 + math.sqrt(5)))
    radius = F.when(k == 0, F.lit(0.0)).otherwise(1 + 0.5 * k)
    return _indexed(spark, n, radius * flat * F.cos(turn), radius * flat * F.sin(turn), radius * z)


def concentric(spark: SparkSession, n: int, shells: int = 5, nodes: int = 10) -> DataFrame:
    """Frames cycle through the origin and rings of `nodes` points at radii 1.5, 2.5, ... in the plane z = 0."""
    k = F.col("frame_id") % (shells * nodes + 1) - 1
    radius = F.when(k < 0, F.lit(0.0)).otherwise(1.5 + F.floor(k / nodes))
    turn = F.lit(TAU) * F.pmod(k, F.lit(nodes)) / nodes
    return _indexed(spark, n, radius * F.cos(turn), radius * F.sin(turn), F.lit(0.0))


def tree(spark: SparkSession, n: int, depth: int = 5, every: int = 100) -> DataFrame:
    """Leaves of a binary tree in turn, a bit of the leaf in each dimension as -2 or 2.

    Every 100th frame is an inner node, these also in turn: the bits of its path, -1 in the next
    dimension, 0 in the rest.
    """
    i = F.col("frame_id")
    node = F.floor(i / every) % (2**depth - 1) + 1
    level = F.floor(F.log2(node.cast("double")) + 1e-9)
    inner = i % every == 0
    bits, value = F.when(inner, level).otherwise(depth), F.when(inner, node - F.pow(F.lit(2), level).cast("long")).otherwise(i % 2**depth)
    cells = []
    for k in range(depth):
        bit = F.floor(value / F.pow(F.lit(2.0), bits - 1 - k)) % 2
        cells.append(F.when(F.lit(k) < bits, 4 * bit - 2).when(F.lit(k) == bits, -1).otherwise(0))
    return _indexed(spark, n, *cells)


def lissajous(spark: SparkSession, n: int, a: int = 3, b: int = 2) -> DataFrame:
    t = F.lit(TAU) * F.col("frame_id") / F.lit(float(n))
    return _indexed(spark, n, F.sin(a * t), F.sin(b * t))


def torus(spark: SparkSession, n: int, p: int = 3, q: int = 7, ring: float = 1.0, tube: float = 0.4) -> DataFrame:
    """A (p, q) knot on a torus."""
    t = F.lit(TAU) * F.col("frame_id") / F.lit(float(n))
    r = ring + tube * F.cos(q * t)
    return _indexed(spark, n, r * F.cos(p * t), r * F.sin(p * t), tube * F.sin(q * t))


def _ordered(spark: SparkSession, rows: Iterator[np.ndarray], n: int) -> DataFrame:
    """A sequence in which each frame follows from the one before: one task, one stream of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            source = rows()
            for a in range(0, n, 4096):
                part = [next(source) for _ in range(min(4096, n - a))]
                yield pa.RecordBatch.from_arrays([pa.array(range(a, a + len(part)), pa.int64()), pa.array([p.tolist() for p in part], pa.list_(pa.float64()))], names=["frame_id", "data"])

    return spark.range(0, 1, 1, 1).mapInArrow(run, "frame_id long, data array<double>")


def walk(spark: SparkSession, n: int, dims: int, step: float = 0.1, seed: int = 0, tries: int = 100) -> DataFrame:
    """A random walk in [-1, 1]; a step that leaves it is drawn again, up to `tries` times."""

    def rows() -> Iterator[np.ndarray]:
        rng, x = np.random.default_rng(seed), np.zeros(dims)
        while True:
            yield x
            for _ in range(tries):
                new = x + rng.uniform(-step, step, dims)
                if (np.abs(new) <= 1).all():
                    x = new
                    break

    return _ordered(spark, rows, n)


def lorenz(spark: SparkSession, n: int, dt: float = 0.01) -> DataFrame:
    """The Lorenz system (10, 28, 8/3) by Euler steps."""

    def rows() -> Iterator[np.ndarray]:
        x = np.array([1.0, 1.0, 1.0])
        while True:
            yield x
            x = x + dt * np.array([10 * (x[1] - x[0]), x[0] * (28 - x[2]) - x[1], x[0] * x[1] - 8 / 3 * x[2]])

    return _ordered(spark, rows, n)


def bouncing_balls(spark: SparkSession, n: int, size: int = 32, balls: int = 1, radius: float = 5, seed: int = 42, collide: bool = False) -> DataFrame:
    """size x size images of soft discs that reflect off the walls, and off each other if collide."""

    def rows() -> Iterator[np.ndarray]:
        rng = np.random.default_rng(seed)
        at, speed = rng.uniform(radius, size - radius, (balls, 2)), rng.uniform(-1.5, 1.5, (balls, 2))
        yy, xx = np.mgrid[:size, :size] + 0.5
        core = 2 * radius / 3
        while True:
            far = np.sqrt((xx[None] - at[:, 0, None, None]) ** 2 + (yy[None] - at[:, 1, None, None]) ** 2)
            yield np.clip((radius - far) / (radius - core), 0, 1).sum(axis=0).ravel()
            at = at + speed
            low, high = at < radius, at > size - radius
            speed = np.where(low, np.abs(speed), np.where(high, -np.abs(speed), speed))
            for i in range(balls if collide else 0):
                for j in range(i):
                    gap = at[i] - at[j]
                    d = np.hypot(*gap)
                    if 0 < d < 2 * radius and (speed[i] - speed[j]) @ gap < 0:
                        push = ((speed[i] - speed[j]) @ gap) / (d * d) * gap
                        speed[i], speed[j] = speed[i] - push, speed[j] + push

    return _ordered(spark, rows, n)


def prototype_images(spark: SparkSession, n: int, side: int = 10, prototypes: int = 5, seed: int = 0) -> DataFrame:
    """(frame_id, data, label): prototypes, uniform in [0, 100], in turn, with N(0, 2) noise."""
    base = np.random.default_rng(seed).uniform(0, 100, (prototypes, side * side))
    table = spark.createDataFrame([(k, b.tolist()) for k, b in enumerate(base)], "label int, base array<double>")
    px = spark.range(n).select(F.col("id").alias("frame_id"), (F.col("id") % prototypes).cast("int").alias("label")).join(F.broadcast(table), "label")
    px = px.select("frame_id", "label", F.posexplode("base").alias("pos", "v")).withColumn("cell", F.col("frame_id") * (side * side) + F.col("pos")).withColumn("v", F.col("v") + 2 * normal(seed, "cell"))
    return px.groupBy("frame_id", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("data")).select("frame_id", "data", "label")


def earth(spark: SparkSession, n: int, size: int = 32) -> DataFrame:
    """Frames of a turning disc with a terminator and drifting bands, values in [0.05, 1]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yy, xx = (np.mgrid[:size, :size] + 0.5) / size * 2 - 1
        z2 = 1 - xx**2 - yy**2
        disc, z = z2 > 0, np.sqrt(np.maximum(z2, 0))
        for batch in batches:
            ids = batch.column("id").to_numpy()
            out = []
            for i in ids:
                a = TAU * i / 96
                light = np.clip(xx * np.sin(a) + z * np.cos(a), 0, 1)
                bands = 0.6 + 0.4 * np.sin(6 * yy + 3 * np.arctan2(xx, z + 1e-9) + a)
                out.append(np.where(disc, 0.05 + 0.95 * light * bands, 0.05).ravel().tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(out, pa.list_(pa.float64()))], names=["frame_id", "data"])

    return spark.range(n).mapInArrow(run, "frame_id long, data array<double>")


# Changes to sequences


def repeated(frames: DataFrame, times: int) -> DataFrame:
    """The sequence `times` times in a row, renumbered. Ids have to be 0 .. n - 1."""
    n = frames.count()
    again = frames.sparkSession.range(times).select(F.col("id").alias("_turn"))
    return frames.crossJoin(F.broadcast(again)).withColumn("frame_id", F.col("frame_id") + F.col("_turn") * n).drop("_turn")


def noisy(frames: DataFrame, radius: float, seed: int) -> DataFrame:
    """Uniform noise in [-radius, radius] on every value."""
    h = F.pmod(F.xxhash64("frame_id", F.lit(seed), F.col("pos")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    px = frames.select("frame_id", F.posexplode("data").alias("pos", "v")).withColumn("v", F.col("v") + radius * (2 * h - 1))
    return px.groupBy("frame_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("data"))


def renumbered(frames: DataFrame, order: Column | None = None) -> DataFrame:
    """frame_id 0, 1, ... in order of `order` (frame_id by default), by ranges: no task sees all rows."""
    from .ordered import SPAN

    key = frames.withColumn("_o", order if order is not None else F.col("frame_id"))
    low, high, n = key.agg(F.min("_o"), F.max("_o"), F.count("*")).first()
    if not n:
        return frames
    width = max(1, (high - low + 1) // max(1, n // SPAN))
    spans = key.withColumn("_s", F.floor((F.col("_o") - low) / F.lit(width)))
    from pyspark.sql.window import Window

    before = spans.groupBy("_s").agg(F.count("*").alias("_n")).select("_s", F.coalesce(F.sum("_n").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    w = Window.partitionBy("_s").orderBy("_o", "frame_id")
    return spans.join(before, "_s").withColumn("frame_id", F.col("_b") + F.row_number().over(w) - 1).drop("_o", "_s", "_b")


def shuffled(frames: DataFrame, seed: int) -> DataFrame:
    """A seeded random order, renumbered."""
    return renumbered(frames, F.pmod(F.xxhash64("frame_id", F.lit(seed)), F.lit(1 << 40)))
