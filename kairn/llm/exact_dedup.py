"""Exact dedup by 128-bit content hash with a comparison of bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import Sieve, core, group_back, stash

_REMOVE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """text without ASCII white space; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), _REMOVE, "")


def exact_dedup(docs: DataFrame, content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after deleting ASCII white space (null: empty). Of equal texts the
    row with the most code points, then the smallest doc_id, stays (a null doc_id only where there is
    no other). Rows repeated with one doc_id count each; of those that tie with the row that stays,
    all have its doc_id and are kept. Texts are hashed and compared whole, however long.

    1. One scan makes a small table: id, length, 128-bit hash, SHA-256. Only this is grouped, by hash
       and salt, then by hash.
    2. Texts whose hash may occur twice, by a sieve, are read again, and each hash group's smallest and
       largest text are found by hash and salt, then by hash. Where these differ, texts collided in
       the hash. Other texts are never shuffled, and no task holds a large group's texts.
    3. Colliding groups (none, in practice) are grouped by the text itself.
    """
    docs = core(docs, "doc_id", "text")
    norm = normalised(F.col("text"))
    small = stash(
        docs.select(
            "doc_id",
            F.length(F.coalesce("text", F.lit(""))).cast("long").alias("points"),
            content_hash(norm).alias("hash"),
            F.sha2(norm, 256).alias("text_sha256"),
        ),
        "exact",
    )
    best = F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"))
    keep = {"group_size": (F.count("*"), "sum"), "best": (F.min(best), "min")}
    out = ["doc_id", F.col("best.i").alias("keep_id"), "group_size", (F.col("doc_id").eqNullSafe(F.col("best.i")) & (F.col("best.p") == -F.col("points"))).alias("kept"), "text_sha256"]

    twice = stash(small.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select(F.xxhash64("hash").alias("key")), "twice")
    again = docs.select(F.xxhash64("doc_id").alias("spread"), content_hash(norm).alias("hash"), norm.alias("norm"))
    with Sieve(twice) as may:
        bytes_of = (
            again.where(may(F.xxhash64("hash")))
            .groupBy("hash", F.pmod("spread", F.lit(64)).alias("salt"))
            .agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
            .groupBy("hash")
            .agg(F.min("low").alias("low"), F.max("high").alias("high"))
        )
        collided = stash(bytes_of.where("low <> high").select("hash"), "collided")
    if collided.isEmpty():
        return group_back(small, ["hash"], keep, F.col("doc_id")).select(*out)
    plain = group_back(small.join(collided, "hash", "left_anti"), ["hash"], keep, F.col("doc_id")).select(*out)
    texts = docs.select(
        "doc_id",
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("points"),
        content_hash(norm).alias("hash"),
        norm.alias("norm"),
        F.sha2(norm, 256).alias("text_sha256"),
    ).join(collided, "hash", "left_semi")
    return plain.unionByName(group_back(texts, ["hash", "norm"], keep, F.col("doc_id")).select(*out))
