"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import discard, group_back, lean, stash


#: Edges that one task finishes by itself; more go through distributed rounds.
FEW = 100_000
#: Rows of one side of a block of pairs, and rows of blocks that are on disk at once, for each task.
SQUARE, CELL_ROWS = 1000, 1 << 14


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (a, b) of a partition reduced to a star for each of its components, smallest node first."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    rows = [(root(x), x) for x in list(parent)]
    rows = [r for r in rows if r[0] != r[1]]
    for i in range(0, len(rows), 50_000):
        a, b = zip(*rows[i : i + 50_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _renamed(label: DataFrame | None, parent: DataFrame) -> DataFrame:
    """label with components replaced by their parents (node, up); the parents alone at first."""
    if label is None:
        return parent.select("node", F.col("up").alias("component"))
    top = parent.select(F.col("node").alias("component"), F.col("up").alias("top"))
    return label.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b), long ids; component is the smallest id reachable.

    Rounds of contraction: each root takes the smallest neighbouring root as parent, parents are
    followed to their ends by doubling, and edges are renamed to roots. Every component that has an
    edge left at least halves in roots, so rounds are logarithmic. All tables stay distributed.
    """
    edges = stash(edges.where("a <> b").select("a", "b").mapInArrow(lean(_forest), "a long, b long").distinct(), "edges")
    label = None
    while n := edges.count():
        if n <= FEW:
            star = edges.repartition(1).mapInArrow(lean(_forest), "a long, b long")
            star = star.select(F.col("b").alias("node"), F.col("a").alias("up"))
            star = stash(star.unionByName(star.select(F.col("up").alias("node"), "up").distinct()), "star")
            return _renamed(label, star)
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stash(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up")), "parent")
        while True:
            up = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            parent = stash(parent.join(up, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "parent")
            if parent.where("moved").isEmpty():
                break
        parent = parent.select("node", "up")
        label = stash(_renamed(label, parent), "labels")
        one = parent.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        two = parent.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        edges = edges.join(one, "a").join(two, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        edges = stash(edges.where("a <> b").mapInArrow(lean(_forest), "a long, b long").distinct(), "edges")
    if label is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return label


def cells_of_pairs(rest: DataFrame, tasks: int) -> Iterator[DataFrame]:
    """Rows of lists (key, id, component, ...) dealt into cells (key, i, j) of SQUARE rows of either side.

    `top` is the component of a row by hash, likely the list's largest. Every row outside it (side 1)
    meets all rows (side 2) of its list in one cell, so that pairs within `top` cost nothing. A row is
    in as many cells as its list has rows by SQUARE: cells are dealt in turns, each of about CELL_ROWS
    rows a task, and a turn has to be over before the next one is asked for.
    """
    by_hash = F.struct(F.xxhash64("id", "key", F.lit(3)).alias("o"), "component")
    rest = group_back(rest, ["key"], {"by": (F.min(by_hash), "min")}, F.col("id")).withColumn("top", F.col("by.component")).drop("by")
    counts = {"n": (F.count("*"), "sum"), "odd": (F.sum(F.expr("CAST(component <> top AS BIGINT)")), "sum")}
    rest = group_back(rest, ["key"], counts, F.col("id"), having=F.expr("odd > 0"))
    rest = rest.withColumn("rows", F.expr(f"(n - 1) div {SQUARE} + 1")).withColumn("odds", F.expr(f"(odd - 1) div {SQUARE} + 1"))
    rest = stash(rest, "cells")
    in_all = rest.agg(F.sum(F.expr("IF(component <> top, rows, 0L) + odds"))).first()[0] or 0
    turns = max(1, -(-in_all // (CELL_ROWS * tasks)))
    x = rest.where("component <> top").withColumn("i", F.expr("pmod(xxhash64(id, 6), odds)"))
    y = rest.withColumn("j", F.expr("pmod(xxhash64(id, 5), rows)"))
    drop = ["n", "odd", "rows", "odds"]
    for turn in range(turns if in_all else 0):
        # a turn has every `turns`-th i of a list, from another one in each list
        own = x.where(f"pmod(pmod(xxhash64(key, 9), {turns}L) + i, {turns}L) = {turn}").withColumn("j", F.explode(F.expr("sequence(0L, rows - 1)")))
        first = f"pmod({turn}L - pmod(xxhash64(key, 9), {turns}L), {turns}L)"
        met = y.withColumn("i", F.explode(F.expr(f"IF({first} < odds, sequence({first}, greatest(odds - 1, {first}), {turns}L), NULL)")))
        yield own.withColumn("side", F.lit(1)).drop(*drop).unionByName(met.withColumn("side", F.lit(2)).drop(*drop))
    discard(rest)
