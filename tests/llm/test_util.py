"""Filters of fixed size, and aggregates carried back to their rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairn.llm.util import Repeats, Sieve, group_back, shared_dir, stash


def test_sieve(spark):
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
    s = Sieve(spark.createDataFrame([(int(k),) for k in keys], "k long"))
    assert s.has(keys).all()
    assert s.has(np.arange(10_000)).mean() < 0.01
    df = spark.createDataFrame([(int(k),) for k in keys[:50]] + [(i,) for i in range(50)], "k long")
    assert df.where(s(F.col("k"))).count() >= 50
    assert not Sieve(spark.createDataFrame([], "k long")).has(keys).any()


def test_repeats(spark):
    keys = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 3000)
    df = spark.createDataFrame([(int(k),) for k in [*keys, *keys[:500]]], "k long").repartition(3)
    r = Repeats(df, lambda batch: batch.column("k").to_numpy().view(np.uint64))
    assert r.may(keys[:500].view(np.uint64)).all()
    assert r.may(keys[500:].view(np.uint64)).mean() < 0.01


@pytest.mark.parametrize("salts", [1, 64])
def test_group_back(spark, salts):
    rows = [(k % 3 if k < 900 else 7, k) for k in range(905)] + [(None, 1)]
    df = spark.createDataFrame(rows, "k long, v long")
    got = group_back(df, ["k"], {"n": (F.count("*"), "sum"), "low": (F.min("v"), "min")}, F.col("v"), salts, F.expr("n > 5"))
    out = {(r.k, r.v): (r.n, r.low) for r in got.collect()}
    assert out == {(k % 3, k): (300, k % 3) for k in range(900)}


def test_stash(spark):
    df = stash(spark.range(10).selectExpr("id", "cast(null as string) t"), "t")
    assert df.count() == 10 and shared_dir(spark)
    assert stash(spark.range(0), "none").count() == 0
