"""Substring dedup with a compressed full-text index per shard.

Every window of WINDOW consecutive words belongs to its minimizer: the smallest hash of the GRAM-word
grams in it. Runs of windows with one minimizer are cut out as stretches, so that equal windows always
meet in the shard of their minimizer, and a document meets only shards it shares something with.
Stretches whose minimizer is in one document only are dropped. Each shard gets an FM-index (wavelet
matrix over the Burrows-Wheeler transform of its distinct stretches); stretches are streamed through
it by backward search, and matching statistics above the threshold report, for each window, the
smallest document that has it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .util import Repeats, core, group_back, stash

WINDOW, GRAM = 50, 8
#: Words in a shard at least, unless the partition ends before.
SHARD_WORDS = 200_000
#: A minimizer with more distinct stretches is dealt window by window instead.
HOT = 1024
_LAST = np.int64(2**63 - 1)


class WaveletMatrix:
    """rank over a sequence of codes, one bit vector for each bit of a code."""

    def __init__(self, codes: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.levels, seq, n = [], codes.astype(np.int64), len(codes)
        for b in range(self.bits - 1, -1, -1):
            bit = ((seq >> b) & 1).astype(bool)
            packed = np.packbits(np.pad(bit, (0, -n % 64 + 64)), bitorder="little").view(np.uint64)
            before = np.zeros(len(packed), np.int32)
            np.cumsum(np.bitwise_count(packed)[:-1], out=before[1:])
            self.levels.append((b, packed, before, int(n - bit.sum())))
            seq = np.concatenate([seq[~bit], seq[bit]])
        self.base = self.walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def walk(self, code: np.ndarray, i: np.ndarray) -> np.ndarray:
        for b, packed, before, zeros in self.levels:
            word = i >> 6
            low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[word] + np.bitwise_count(packed[word] & low)
            i = np.where((code >> b) & 1, zeros + ones, i - ones)
        return i

    def rank(self, code: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often code stands before position i."""
        return self.walk(code, i) - self.base[code]


def _sorted_suffixes(symbols: np.ndarray, end: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes by their first `depth` symbols within their stretch, and the ranks by 1, 2, 4, ... symbols."""
    n = len(symbols)
    rank, width, levels = symbols.astype(np.int64), 1, []
    at = np.arange(n)
    while True:
        levels.append(rank)
        if width >= depth:
            return np.argsort(rank, kind="stable"), levels
        nxt = at + width
        second = np.where(nxt < end, rank[np.minimum(nxt, n - 1)] + 1, 0)
        pair = rank * (n + 2) + second
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        width *= 2


class FMIndex:
    """Full-text index of stretches of words (codes from 1), each with an owner."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, owners: np.ndarray, window: int):
        # each stretch is closed by code 0
        symbols, lengths = np.insert(symbols, starts + lengths, 0), lengths + 1
        starts = np.cumsum(lengths) - lengths
        self.window, n = window, len(symbols)
        end = np.repeat(starts + lengths, lengths)
        sa, levels = _sorted_suffixes(symbols, end, window)
        bwt = symbols[sa - 1]
        sigma = int(symbols.max()) + 1
        self.wavelet = WaveletMatrix(bwt, sigma)
        self.count = np.searchsorted(symbols[sa], np.arange(sigma + 1))
        lcp = np.zeros(n, np.int64)
        a, b = sa[:-1].copy(), sa[1:].copy()
        ea, eb = end[a], end[b]
        got = np.zeros(max(n - 1, 0), np.int64)
        for j in range(len(levels) - 1, -1, -1):
            ok = (a < ea) & (b < eb)
            ok[ok] = levels[j][a[ok]] == levels[j][b[ok]]
            # equal ranks of suffixes that end early agree to their ends only
            step = np.minimum(np.int64(1 << j), np.minimum(ea - a, eb - b))
            got[ok] += step[ok]
            a[ok] += step[ok]
            b[ok] += step[ok]
        lcp[1:] = got
        self.low, self.high = self._blocks(lcp, window - 1)
        low, _ = self._blocks(lcp, window)
        owner = np.repeat(owners, lengths)[sa]
        cut = np.flatnonzero(low == np.arange(n))
        self.owner = np.repeat(np.minimum.reduceat(owner, cut), np.diff(np.append(cut, n))) if n else owner

    @staticmethod
    def _blocks(lcp: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row the interval of rows that share `depth` symbols with it."""
        n = len(lcp)
        cut = np.flatnonzero(lcp < depth)
        sizes = np.diff(np.append(cut, n))
        return np.repeat(cut, sizes), np.repeat(cut + sizes, sizes)

    def owners_of(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each symbol the smallest owner of the window that starts there; -1 where none is known.

        Backward search over all stretches in step. The interval is that of the current match; once
        the match has the window's length the interval is reported, and the match is shortened at its
        right end by one, which gives the interval of rows with a common prefix of window - 1.
        A match that cannot be extended ends, and begins again with the next symbol.
        """
        out = np.full(len(symbols), -1, np.int64)
        n = len(self.low)
        lo, hi, match = np.zeros(len(starts), np.int64), np.full(len(starts), n, np.int64), np.zeros(len(starts), np.int64)
        for step in range(int(lengths.max(initial=0))):
            on = np.flatnonzero(lengths > step)
            at = starts[on] + lengths[on] - 1 - step
            c = symbols[at]
            both = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([lo[on], hi[on]]))
            new_lo, new_hi = self.count[c] + both[: len(on)], self.count[c] + both[len(on) :]
            none = new_lo >= new_hi
            new_lo[none], new_hi[none] = self.count[c[none]], self.count[c[none] + 1]
            length = np.where(none, new_lo < new_hi, match[on] + 1)
            full = length == self.window
            out[at[full]] = self.owner[new_lo[full]]
            new_lo[full], new_hi[full] = self.low[new_lo[full]], self.high[new_lo[full]]
            empty = new_lo >= new_hi
            new_lo[empty], new_hi[empty] = 0, n
            lo[on], hi[on], match[on] = new_lo, new_hi, np.where(full, self.window - 1, length)
        return out


def minimizer_runs(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, number of windows, minimizer) of all runs of windows with one minimizer."""
    grams = K.ngram_hash(words, GRAM)
    span = WINDOW - GRAM + 1
    if len(grams) < span:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    # the smallest gram of each window, by doubling
    best, width = grams, 1
    while width * 2 <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    low = np.minimum(best[: len(grams) - span + 1], best[span - width : span - width + len(grams) - span + 1])
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = np.flatnonzero(np.arange(len(low)) + WINDOW <= at[1:][text[: len(low)]])
    if not len(inside):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    value, owner = low[inside], text[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    cut = np.flatnonzero(new)
    return owner[cut], inside[cut] - at[:-1][owner[cut]], np.diff(np.append(cut, len(inside))), value[cut].view(np.int64)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """did, h, text -> did, h, first, n, mz."""
    for batch in batches:
        for part in K.chunks(batch):
            t = K.Texts.of(part.column("text"))
            starts, ends, at = t.words()
            if not len(starts):
                continue
            text, first, n, mz = minimizer_runs(t.spans_hash(starts, ends), at)
            took = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [part.column("did").take(took), part.column("h").take(took), pa.array(first, pa.int32()), pa.array(n, pa.int32()), pa.array(mz)],
                names=["did", "h", "first", "n", "mz"],
            )


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """did, h, text, runs -> did, h, first, mz, words."""
    for batch in batches:
        for part in K.chunks(batch):
            rows = []
            for did, h, text, runs in zip(*[part.column(c).to_pylist() for c in ("did", "h", "text", "runs")], strict=True):
                words = text.encode().split()
                for r in runs:
                    a = r["first"]
                    rows.append((did, h, a, r["mz"], b" ".join(words[a : a + r["n"] + WINDOW - 1]).decode()))
            if rows:
                did, h, first, mz, words = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(did, pa.int64()), pa.array(h, pa.int64()), pa.array(first, pa.int32()), pa.array(mz, pa.int64()), pa.array(words)],
                    names=["did", "h", "first", "mz", "words"],
                )


def _window_hashes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of the stretches in a batch: row, number in the stretch, hash."""
    t = K.Texts.of(batch.column("words"))
    starts, ends, at = t.words()
    h = K.ngram_hash(t.spans_hash(starts, ends), WINDOW) if len(starts) else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(t.n), np.diff(at))[: len(h)]
    inside = np.arange(len(h)) + WINDOW <= at[1:][row]
    row = row[inside]
    return row, np.flatnonzero(inside) - at[:-1][row], h[inside]


def _windows(repeats: Repeats):
    """mz, sid, words, owner -> mz, sid, idx, words, owner of each window that may stand in two stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, idx, h = _window_hashes(batch)
            may = repeats.may(h)
            mz, sid, words, owner = (batch.column(c).to_pylist() for c in ("mz", "sid", "words", "owner"))
            rows = []
            for r, i in zip(row[may].tolist(), idx[may].tolist(), strict=True):
                rows.append((mz[r], sid[r], i, " ".join(words[r].split(" ")[i : i + WINDOW]), owner[r]))
                if len(rows) > 20_000:
                    yield _window_batch(rows)
                    rows = []
            if rows:
                yield _window_batch(rows)

    return run


def _window_batch(rows: list[tuple]) -> pa.RecordBatch:
    mz, sid, idx, words, owner = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(mz, pa.int64()), pa.array(sid, pa.int64()), pa.array(idx, pa.int32()), pa.array(words), pa.array(owner, pa.int64())],
        names=["mz", "sid", "idx", "words", "owner"],
    )


def search_shard(rows: pa.Table) -> pa.RecordBatch:
    """mz, sid, words, owner of one shard -> mz, sid, owners (of each window)."""
    t = K.Texts.of(rows.column("words").combine_chunks())
    starts, ends, at = t.words()
    symbols = np.unique(t.spans_hash(starts, ends), return_inverse=True)[1].astype(np.int64) + 1
    lengths = np.diff(at)
    index = FMIndex(symbols, at[:-1], lengths, rows.column("owner").to_numpy(), WINDOW)
    found = index.owners_of(symbols, at[:-1], lengths)
    n = lengths - WINDOW + 1
    inside = np.arange(len(symbols)) - np.repeat(at[:-1], lengths) < np.repeat(n, lengths)
    offsets = np.append(0, np.cumsum(n)).astype(np.int32)
    owners = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found[inside]))
    return pa.RecordBatch.from_arrays([rows.column("mz").combine_chunks(), rows.column("sid").combine_chunks(), owners], names=["mz", "sid", "owners"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by mz, cut into shards of about SHARD_WORDS words at changes of mz."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        mz = batch.column("mz").to_numpy()
        n_words = np.array([w.as_py().count(" ") + 1 for w in batch.column("words")], np.int64)
        total = size + np.cumsum(n_words)
        a = 0
        for i in np.flatnonzero(np.append(last is not None and mz[0] != last, mz[1:] != mz[:-1])) if len(mz) else []:
            if total[i - 1] >= SHARD_WORDS if i else size >= SHARD_WORDS:
                held.append(batch.slice(a, i - a))
                yield search_shard(pa.Table.from_batches(held))
                held, a = [], i
                total -= total[i - 1] if i else size
        held.append(batch.slice(a))
        if len(mz):
            size, last = int(total[-1]), mz[-1]
    table = pa.Table.from_batches(held) if held else None
    if table is not None and table.num_rows:
        yield search_shard(table)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, removed in zip(batch.column("text"), batch.column("removed"), strict=True):
            words = (text.as_py() or "").encode().split()
            n = len(words)
            if removed.is_valid and len(removed):
                hit = np.zeros(n + 1, np.int64)
                first = np.unique(np.asarray(removed.values))
                hit[first] += 1
                np.subtract.at(hit, first + WINDOW, 1)
                cover = (np.cumsum(hit[:-1]) > 0).tolist()
                words = [w for w, c in zip(words, cover, strict=True) if not c]
            rows.append((n, n - len(words), b" ".join(words)))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("row"),
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string()),
                pa.array([r[2].decode() for r in rows], pa.string()),
            ],
            names=["row", "n_words", "n_removed", "kept_sha256", "kept_text"],
        )


def substring_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept_text.

    A word is removed where a window of 50 words that covers it also starts in a document with a
    smaller doc_id; windows are judged on the input. Null or empty texts have no words; a text of
    under 50 words loses nothing. A null doc_id counts as larger than all others. Rows repeated with
    one id don't remove from each other, and each has its row.
    """
    rows = core(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(int(_LAST))).alias("did"), F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    texts = rows.select("did", "h", "text")
    runs = texts.mapInArrow(_stretches, "did long, h long, first int, n int, mz long")
    # the minimizer of a run must be in two documents
    shared = group_back(
        runs, ["mz"], {"low": (F.min("did"), "min"), "high": (F.max("did"), "max")}, F.col("did"), having=F.expr("low < high")
    )
    per_doc = shared.groupBy("did", "h").agg(F.collect_set(F.struct("first", "n", "mz")).alias("runs"))
    found = stash(
        texts.join(per_doc, ["did", "h"])
        .mapInArrow(_cut_out, "did long, h long, first int, mz long, words string")
        .withColumn("sid", F.xxhash64("words")),
        "stretches",
    )
    distinct = stash(found.groupBy("mz", "sid", "words").agg(F.min("did").alias("owner")), "distinct")
    hot = stash(distinct.groupBy("mz").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("mz"), "hot")
    any_hot = not hot.isEmpty()
    index = distinct
    if any_hot:
        crowded = distinct.join(hot, "mz", "left_semi")
        repeats = Repeats(crowded, lambda batch: _window_hashes(batch)[2])
        links = stash(
            crowded.mapInArrow(_windows(repeats), "mz long, sid long, idx int, words string, owner long")
            .withColumns({"wmz": F.xxhash64("words", F.lit(1)), "wsid": F.xxhash64("words", F.lit(2))}),
            "windows",
        )
        # a window that stands in one stretch alone belongs to that stretch's owner
        single = links.groupBy(F.col("wmz").alias("mz"), F.col("wsid").alias("sid"), "words").agg(F.min("owner").alias("owner"), F.count("*").alias("n"))
        index = distinct.join(hot, "mz", "left_anti").unionByName(single.where("n > 1").drop("n"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owners = (
        index.select("mz", "sid", "words", "owner").repartition(parts, "mz").sortWithinPartitions("mz", "sid")
        .mapInArrow(_search, "mz long, sid long, owners array<long>")
    )
    if any_hot:
        owners = stash(owners, "owners")
        of_window = (
            links.select("mz", "sid", "idx", "wmz", "wsid")
            .join(owners.select(F.col("mz").alias("wmz"), F.col("sid").alias("wsid"), F.col("owners")[0].alias("o")), ["wmz", "wsid"])
            .groupBy("mz", "sid")
            .agg(F.map_from_entries(F.collect_list(F.struct("idx", "o"))).alias("known"))
        )
        back = (
            crowded.select("mz", "sid", "owner", (F.size(F.split("words", " ")) - WINDOW).alias("last"))
            .join(of_window, ["mz", "sid"], "left")
            .select("mz", "sid", F.expr("transform(sequence(0, last), i -> coalesce(known[i], owner))").alias("owners"))
        )
        owners = owners.unionByName(back)
    removed = (
        found.select("did", "h", "first", "mz", "sid")
        .join(owners, ["mz", "sid"])
        .select("did", "h", F.expr("filter(transform(owners, (o, i) -> IF(o < did, first + i, -1)), p -> p >= 0)").alias("p"))
        .where("size(p) > 0")
        .groupBy("did", "h")
        .agg(F.flatten(F.collect_list("p")).alias("removed"))
    )
    out = "row bigint, n_words long, n_removed long, kept_sha256 string, kept_text string"
    return (
        rows.join(removed, ["did", "h"], "left")
        .select(F.col("doc_id").alias("row"), "text", "removed")
        .mapInArrow(_kept, out)
        .withColumnRenamed("row", "doc_id")
    )
