"""Mixing sources to target weights, by blocks of words drawn from per-source permutations.

The words of a source, its documents in a fixed hashed order, are blocks of BLOCK words. The mix is a
sequence of slots, cut into shards; a slot takes one block. Each shard draws how many of its slots a
source gets, so that the shards' sums are what is due; slot i of a source is block perm(i mod blocks),
with another keyed permutation for each pass; blocks join the documents by index.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import kernels as K
from .util import SPACE, core, lean, packed, stash

#: Words in a block, the unit that is drawn.
BLOCK = 64
#: Output slots in a shard, about.
SHARD_SLOTS = 1 << 16
#: The source table is planned on the driver; more sources than this are refused.
MAX_SOURCES = 1_000_000
#: Documents in a bucket of the order, about, and buckets that are summed up in one window.
BUCKET, WINDOW = 128, 4096
#: Copies of one row that are dealt together.
COPIES = 1024


def fill_targets(sizes: Sequence[int], weights: Sequence[float], share: float, most: float) -> np.ndarray:
    """Targets by weight that sum to share * sum(sizes), none above most * its size.

    What lies above a cap is shared again among the others by weight until nothing does.
    """
    size, weight = np.asarray(sizes, float), np.asarray(weights, float)
    target, open_ = np.zeros(len(size)), size > 0
    left = share * size.sum()
    while open_.any():
        give = left * weight / weight[open_].sum()
        over = open_ & (give > most * size)
        if not over.any():
            target[open_] = give[open_]
            break
        target[over] = most * size[over]
        left -= target[over].sum()
        open_ &= ~over
    return target


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a keyed permutation of range(n) puts x: a four-round Feistel network, walked until inside."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = K.mix(np.arange(4, dtype=np.uint64) + np.uint64(key & (2**64 - 1)))

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & mask
        for k in keys:
            left, right = right, left ^ (K.mix(right ^ k) & mask)
        return (left << np.uint64(half)) | right

    out = once(x.astype(np.uint64))
    while (outside := out >= n).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


class Shards:
    """How many slots each source has in each shard, and its slots before.

    Shards are the leaves of a binary tree. A node's slots are dealt to its halves by a binomial draw
    for each source, seeded by the node, whose sum is then brought to the half's size: so counts are
    multinomial draws on the condition that the sources' sums are what is due. A shard needs only
    the nodes above it, whichever task asks for it.
    """

    def __init__(self, slots: Sequence[int], seed: int):
        self.slots, self.seed = np.asarray(slots, np.int64), seed
        self.total = int(self.slots.sum())
        self.n = max(1, -(-self.total // SHARD_SLOTS))
        self._path: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def start(self, shard: int) -> int:
        return self.total * shard // self.n

    def _half(self, due: np.ndarray, low: int, middle: int, high: int) -> np.ndarray:
        """What the shards low to middle have of what the shards low to high have."""
        size, rng = self.start(middle) - self.start(low), np.random.default_rng([self.seed, low, high])
        got = rng.binomial(due, size / max(1, int(due.sum())))
        wrong = int(got.sum()) - size
        for s in rng.permutation(len(due)) if wrong else ():
            step = min(wrong, int(got[s])) if wrong > 0 else -min(-wrong, int(due[s] - got[s]))
            got[s] -= step
            wrong -= step
            if not wrong:
                break
        return got

    def __call__(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """(slots before the shard, slots in it) of each source."""
        low, high, first, due, path = 0, self.n, np.zeros_like(self.slots), self.slots, {}
        while high - low > 1:
            middle = (low + high) // 2
            left = self._path[low, high][0] if (low, high) in self._path else self._half(due, low, middle, high)
            path[low, high] = (left, due)
            if shard < middle:
                high, due = middle, left
            else:
                low, first, due = middle, first + left, due - left
        self._path = path
        return first, due


def _weights(names: list[str | None], weights: Sequence[float]) -> list[tuple[str | None, float]]:
    ordered = sorted((n for n in names if n is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in names)
    return [(n, weights[i % len(weights)]) for i, n in enumerate(ordered)]


def draw(sized: DataFrame, weights: Sequence[float], share: float, most: float, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From (key, source, size, copies): pieces of documents in blocks, the mix's slots, and the sources.

    pieces: key, source, source_no, block, start (word in the row's copies), n (words). slots: shard,
    slot, source_no, block, pass. sources: source, source_no, source_size, target.
    """
    spark = sized.sparkSession
    width = F.col("size") * F.col("copies")
    table = sized.groupBy("source").agg(F.sum(width).alias("size"), F.count("*").alias("docs")).limit(MAX_SOURCES + 1).collect()
    if len(table) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    by_name = {r["source"]: r for r in table}
    named = _weights(list(by_name), weights)
    sizes = [int(by_name[n]["size"]) for n, _ in named]
    targets = fill_targets(sizes, [w for _, w in named], share, most)
    blocks = [-(-s // BLOCK) for s in sizes]
    slots = [min(int(most * b), round(t / s * b)) if s else 0 for b, s, t in zip(blocks, sizes, targets, strict=True)]
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("source_no", T.IntegerType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    sources = spark.createDataFrame([(n, i, sizes[i], float(targets[i])) for i, (n, _) in enumerate(named)], schema)

    # Where each document's words begin in its source: sums by stretch of buckets, by bucket, and within
    # the bucket. The number of buckets follows the number of documents, so a hot source fills many
    # small windows.
    n_buckets = max(1, sum(int(r["docs"]) for r in table) // BUCKET)
    dealt = sized.where("size > 0").withColumn("bucket", F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(n_buckets))).withColumn("width", width)

    def before(*by: str, order: str) -> Window:
        return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    def up_to(value: str, window: Window) -> Column:
        return F.coalesce(F.sum(value).over(window), F.lit(0))

    sums = dealt.groupBy("source", "bucket").agg(F.sum("width").alias("in_bucket")).withColumn("stretch", F.expr(f"bucket div {WINDOW}"))
    wide = sums.groupBy("source", "stretch").agg(F.sum("in_bucket").alias("in_stretch"))
    wide = wide.select("source", "stretch", up_to("in_stretch", before("source", order="stretch")).alias("far")).alias("w")
    sums = sums.select("source", "stretch", "bucket", up_to("in_bucket", before("source", "stretch", order="bucket")).alias("near")).alias("b")
    sums = sums.join(wide, F.expr("b.source <=> w.source AND b.stretch = w.stretch")).select("b.source", "b.bucket", (F.col("far") + F.col("near")).alias("base")).alias("b")
    placed = dealt.withColumn("inner", up_to("width", before("source", "bucket", order="key"))).alias("d")
    placed = placed.join(sums, F.expr("d.source <=> b.source AND d.bucket = b.bucket")).select(
        "d.key", "d.source", "d.size", "d.copies", (F.col("base") + F.col("inner")).alias("at")
    )
    some = F.least(F.lit(COPIES), F.col("copies") - F.col("run") * COPIES)
    placed = placed.withColumn("run", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})"))).select(
        "key", "source", (F.col("at") + F.col("run") * COPIES * F.col("size")).alias("at"), (F.col("run") * COPIES * F.col("size")).alias("skip"), (some * F.col("size")).alias("size")
    )
    pieces = (
        placed.join(F.broadcast(sources.select(F.col("source").alias("s"), "source_no")), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("block", F.explode(F.expr(f"sequence(at div {BLOCK}, (at + size - 1) div {BLOCK})")))
        .withColumn("low", F.greatest(F.col("at"), F.col("block") * BLOCK))
        .select("key", "source", "source_no", "block", (F.col("skip") + F.col("low") - F.col("at")).alias("start"), (F.least(F.expr("at + size"), (F.col("block") + 1) * BLOCK) - F.col("low")).alias("n"))
    )
    shards = Shards(slots, seed)

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                first, count = shards(shard)
                n = int(count.sum())
                source = np.repeat(np.arange(len(count)), count)
                own = np.arange(n) - np.repeat(np.cumsum(count) - count, count) + first[source]
                block, turn = np.empty(n, np.int64), own // np.maximum(1, np.array(blocks))[source]
                ends = np.append(0, np.cumsum(count))
                for s in np.flatnonzero(count):
                    at = slice(ends[s], ends[s + 1])
                    for t in np.unique(turn[at]):
                        hit = np.flatnonzero(turn[at] == t) + ends[s]
                        block[hit] = permuted(own[hit] % blocks[s], blocks[s], seed * 1_000_003 + int(s) * 8191 + int(t))
                # within the shard, sources are mixed by one more permutation
                slot = permuted(np.arange(n), n, seed * 1_000_033 + shard) if n else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, shard)), pa.array(slot), pa.array(source.astype(np.int32)), pa.array(block), pa.array(turn.astype(np.int32))], names=["shard", "slot", "source_no", "block", "pass"]
                )

    tasks = max(1, min(shards.n, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    drawn = spark.range(0, shards.n, 1, tasks).mapInArrow(lean(filled), "shard long, slot long, source_no int, block long, pass int")
    return pieces, drawn, sources


def _sized(docs: DataFrame) -> DataFrame:
    """key, source, size, copies: equal rows (by id, text and source) are one, with their number."""
    size = F.coalesce(F.regexp_count("text", F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")
    each = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"), "source", size.alias("size"))
    return each.groupBy("key", "source").agg(F.max("size").alias("size"), F.count("*").alias("copies"))


def _joined(pieces: DataFrame, drawn: DataFrame) -> DataFrame:
    """The pieces of all that is drawn. What is drawn is made from a few numbers: never broadcast it by its estimate."""
    return pieces.join(drawn.hint("merge"), ["source_no", "block"])


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2, seed: int = 7
) -> DataFrame:
    """What a mix takes of each document: doc_id, size, source_size, target, taken.

    A size is a number of words. Sources in code point order, null last, have the weights in turn;
    they share `share` of all words, none over `most` times its own size. Taken words, those of the
    mix that mix_shards returns, are within a block of the target, and no document is taken over
    `most` times. Reruns agree.

    Null or empty texts have size 0 and taken 0. Rows repeated with one id and text count one by one
    towards sizes, and share what is taken of them evenly, to a word. Null ids are ordinary ids. A
    very long text is many blocks; only its size is held.
    """
    small = stash(_sized(core(docs, "doc_id", "text", "source")), "sizes")
    pieces, drawn, sources = draw(small, weights, share, most, seed)
    copies = drawn.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    taken = _joined(pieces, copies).groupBy("key", "source").agg(F.sum(F.col("n") * F.col("times")).alias("all"))
    rows = small.alias("d").join(taken.alias("t"), F.expr("d.key <=> t.key AND d.source <=> t.source"), "left")
    rows = rows.join(F.broadcast(sources.alias("s")), F.expr("d.source <=> s.source")).select("d.*", "s.source_size", "s.target", F.coalesce("t.all", F.lit(0)).alias("all"))
    rows = rows.withColumn("run", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})")))
    rows = rows.withColumn("nth", F.explode(F.expr(f"sequence(run * {COPIES}, least(copies, (run + 1) * {COPIES}) - 1)")))
    share_of = F.expr("`all` div copies + CAST(nth < `all` % copies AS BIGINT)").cast("long")
    return rows.select("key.doc_id", "size", "source_size", "target", share_of.alias("taken"), "source")


def mix_shards(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2, seed: int = 7) -> DataFrame:
    """The mix as a sequence: shard, slot, start, doc_id, source, n.

    A slot takes one block: n words from word `start` of a document, and of the next ones in the
    source's order where a block goes on there (repeated rows are one document of all their words).
    Written in the order of shard, slot and doc_id, this is the order of the mixed corpus.
    """
    pieces, drawn, _ = draw(stash(_sized(core(docs, "doc_id", "text", "source")), "sizes"), weights, share, most, seed)
    return _joined(pieces, drawn).select("shard", "slot", "start", "key.doc_id", "source", "n")


def mix_documents(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2, seed: int = 7
) -> DataFrame:
    """The mix by document: a row for each document and pass that takes words of it.

    Its text has the words of the taken blocks in order, joined by one space; n_chars, where it is a
    column, follows. A document of which nothing is taken has no row. Sizes and nulls as in
    mix_sources; rows repeated with one id and text count once, and what is taken is taken of each.
    """
    rows = packed(docs)
    small = stash(_sized(rows).withColumn("copies", F.lit(1).cast("long")), "sizes")
    pieces, drawn, _ = draw(small, weights, share, most, seed)
    spans = _joined(pieces, drawn).groupBy("key", "source", "pass").agg(F.array_distinct(F.array_sort(F.collect_list(F.struct("start", "n")))).alias("spans"))
    full = rows.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"), "source", "text", "row").alias("d")

    def taken(words: Column) -> Column:
        return F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(words, (s["start"] + 1).cast("int"), s["n"].cast("int")))), " ")

    # the words are the variable of an outer function, so that a text is split once and not for each span
    words = F.regexp_extract_all("text", F.lit(f"([^{SPACE}]+)"), F.lit(1))
    out = full.join(spans.alias("s"), F.expr("d.key <=> s.key AND d.source <=> s.source")).select("row", F.transform(F.array(words), taken)[0].alias("text"))
    return with_text(out, docs.columns)


def with_text(out: DataFrame, columns: list[str]) -> DataFrame:
    """The struct `row` as columns again, with the column `text` in place of its text."""
    new = F.col("text")

    def pick(c: str):
        if c == "text":
            return new.alias(c)
        if c == "n_chars":
            return F.length(new).cast("long").alias(c)
        return F.col(f"row.`{c}`").alias(c)

    return out.select(*[pick(c) for c in columns])
