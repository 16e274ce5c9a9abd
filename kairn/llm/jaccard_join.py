"""N-gram Jaccard join, size-aware: subsets for light sets, inverted lists for heavy ones.

A document's set holds the hashes of its distinct n-word shingles. Documents with equal sets form a
class; one set a class is joined. Links need shared >= t * union, so two linked sets of at most m
elements share ceil(t * m) of them.

* A light set (size up to the boundary) enumerates its subsets of that fixed size; linked light sets
  have one in common.
* A heavy set scans the inverted lists of its rarest elements: of n it takes n - ceil(t * n) + 1,
  ordered by a corpus-wide sketch of frequencies, and linked sets have one of these in common. Light
  sets that can link to a heavy one are in the lists too.
* The boundary is the size with the smallest cost: rows enumerated, plus rows and expected list
  lengths for the heavy sets, from the histogram of sizes.

Rows of a list are near by size and by 256-bit parity bitmaps (their distance bounds the symmetric
difference from below, so no link is lost); near pairs are checked by bitmaps as long as the sets,
then exactly on the sets. Only connectivity is wanted: each set meets the nearest before it in its
lists, then near pairs of different components meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .graph import components
from .lists import PARTS, Dealer, Facts, Nearness, link, nearest_rows, tasks_of
from .util import Sieve, core, discard, group_back, lean, packed, stash

#: Slots of the frequency sketch, and slots in one row of it.
SKETCH, ROW = 1 << 21, 1 << 14
MAP_WORDS = 4
#: Light sets are at most this large: beyond it, subsets outnumber prefix elements by far.
MOST_LIGHT = 24


def shingle_sets(t: K.Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and their offsets. A text of under n words is one shingle."""
    t = K.lowered(t)
    starts, ends, at = t.words()
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(t.n + 1, np.int64)
    w = t.spans_hash(starts, ends)
    text = np.repeat(np.arange(t.n), np.diff(at))
    grams = K.ngram_hash(w, n)
    inside = np.arange(len(grams)) + n <= at[1:][text[: len(grams)]]
    owner, value = text[: len(grams)][inside], grams[inside]
    for size in range(1, n):
        short = np.flatnonzero(np.diff(at) == size)
        if len(short):
            whole = K.ngram_hash(w[at[short][:, None] + np.arange(size)].ravel(), size)[::size]
            owner, value = np.append(owner, short), np.append(value, whole ^ np.uint64(size))
    if t.n < 1 << 20:  # by text and the upper bits of the hash, in one number
        order = np.argsort((owner.astype(np.uint64) << np.uint64(44)) | (value >> np.uint64(20)))
    else:
        order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    owner, value = owner[new], value[new]
    return value, np.searchsorted(owner, np.arange(t.n + 1))


def _sketch(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sizes = np.zeros(SKETCH, np.int32), np.zeros(ROW, np.int32)
        for batch in batches:
            for part in K.chunks(batch):
                value, at = shingle_sets(K.Texts.of(part.column("text")), n)
                np.add.at(counts, (value >> np.uint64(43)).astype(np.int64), 1)
                sizes += np.bincount(np.minimum(np.diff(at), ROW - 1), minlength=ROW).astype(np.int32)
        rows = [*counts.reshape(-1, ROW), sizes]
        part = pa.array([TaskContext.get().partitionId() % 256] * len(rows), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), part, pa.array([r.tobytes() for r in rows])], names=["slot", "part", "counts"])

    return run


def _sum_sketch(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    width = [np.frombuffer(b.as_py(), np.int32 if len(b.as_py()) == 4 * ROW else np.int64) for b in table.column("counts")]
    total = np.sum(width, axis=0, dtype=np.int64)
    return pa.table({"slot": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([0], pa.int32()), "counts": pa.array([total.tobytes()])})


def corpus_sketch(texts: DataFrame, n: int) -> tuple[np.ndarray, dict[int, int]]:
    """A rarity level for each slot of the sketch (0: as rare as any), and how many sets have each size.

    Both have a fixed size, whatever the corpus: SKETCH bytes, and ROW sizes (the last: or larger).
    """
    kind = "slot int, part int, counts binary"
    summed = texts.mapInArrow(lean(_sketch(n)), kind).groupBy("slot", "part").applyInArrow(_sum_sketch, kind)
    rows = summed.groupBy("slot").applyInArrow(_sum_sketch, kind).collect()
    counts = np.zeros(SKETCH + ROW, np.int64)
    for r in rows:
        counts[r["slot"] * ROW : (r["slot"] + 1) * ROW] = np.frombuffer(r["counts"], np.int64)
    counts, sizes = counts[:SKETCH], counts[SKETCH:]
    usual = np.median(counts)
    above = np.maximum(0, counts - usual - 4 * math.sqrt(usual + 1))
    return np.ceil(np.log2(above + 1)).astype(np.uint8), {int(s): int(sizes[s]) for s in np.flatnonzero(sizes) if s}


def need(size: int, percent: int) -> int:
    """The least number of elements that a linked set shares with one of `size`: ceil(percent * size / 100)."""
    return -(-percent * size // 100)


def partner_sizes(size: int, percent: int) -> range:
    """Sizes of the larger set of a link whose smaller one has `size`."""
    return range(size, 100 * size // percent + 1)


def subset_rows(size: int, percent: int) -> int:
    return sum(math.comb(size, need(m, percent)) for m in partner_sizes(size, percent))


def boundary(sizes: dict[int, int], percent: int, list_length: float) -> int:
    """The largest light size, by cost in rows made and scanned."""
    most = min(max(sizes, default=0), MOST_LIGHT)
    heavy = {s: c * (s - need(s, percent) + 1) * (1 + list_length) for s, c in sizes.items()}
    costs = []
    for x in range(most + 1):
        light = sum(c * subset_rows(s, percent) for s, c in sizes.items() if s <= x)
        lists = sum(cost for s, cost in heavy.items() if s > x or 100 * s >= percent * (x + 1))
        costs.append((light + lists, x))
    return min(costs)[1] if costs else 0


def subset_keys(own: np.ndarray, percent: int, largest: int) -> list[int]:
    """Keys of the fixed-size subsets of a light set, for each size its larger partner can have."""
    e, n, out = K.mix(own ^ np.uint64(0x5851F42D4C957F2D)), len(own), []
    total = e.sum(dtype=np.uint64)
    for m in partner_sizes(n, percent):
        c = need(m, percent)
        if m > largest or c > n:
            continue
        left_out = np.array([e[list(x)].sum(dtype=np.uint64) for x in combinations(range(n), n - c)], np.uint64)
        out.append(K.mix(total - left_out + np.uint64(m)))
    return np.concatenate(out).view(np.int64).tolist() if out else []


def _digest(value: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """For each set: two 64-bit digests, then MAP_WORDS words of its parity bitmap."""
    n, filled = len(at) - 1, np.flatnonzero(np.diff(at))
    out = [np.zeros(n, np.uint64) for _ in range(2 + MAP_WORDS)]
    if len(filled):
        starts = at[:-1][filled]
        out[0][filled] = np.add.reduceat(K.mix(value), starts)
        out[1][filled] = np.add.reduceat(K.mix(value * np.uint64(0xD1342543DE82EF95)), starts)
        place = K.mix(value ^ np.uint64(0xC2B2AE3D27D4EB4F))
        for j in range(MAP_WORDS):
            bit = np.where((place >> np.uint64(6)) % np.uint64(MAP_WORDS) == j, np.uint64(1) << (place & np.uint64(63)), np.uint64(0))
            out[2 + j][filled] = np.bitwise_xor.reduceat(bit, starts)
    return [x.view(np.int64) for x in out]


_BITS = [f"b{j}" for j in range(MAP_WORDS)]


def _long_bitmaps(value: np.ndarray, at: np.ndarray) -> list[bytes]:
    """A parity bitmap of each set with as many bits as elements or more: a power of two, 256 at least."""
    place, out = K.mix(value ^ np.uint64(0x165667B19E3779F9)).astype(np.int64), []
    for a, b in zip(at, at[1:], strict=False):
        bits = 1 << max(8, int(b - a - 1).bit_length())
        out.append(np.packbits(np.bincount(place[a:b] & (bits - 1), minlength=bits) & 1, bitorder="little").tobytes())
    return out


def _bitmaps_close(percent: int):
    """Pairs (a, b, na, nb, ma, mb) whose bitmaps leave room for a link; the longer bitmap is folded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (n, m, x, y) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("na", "nb", "ma", "mb")], strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                while len(x) > len(y):
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                while len(y) > len(x):
                    y = y[: len(y) // 2] ^ y[len(y) // 2 :]
                if int(np.bitwise_count(x ^ y).sum()) * (100 + percent) <= (n + m) * (100 - percent):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def rarest(value: np.ndarray, at: np.ndarray, level: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, element) of the `count` rarest elements of each set: by level, then by hash."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((value, level, owner)) if len(at) > 1 << 20 else np.argsort((owner.astype(np.uint64) << np.uint64(44)) | (level.astype(np.uint64) << np.uint64(38)) | (value >> np.uint64(26)))
    take = order[np.arange(len(order)) - at[:-1][owner] < count[owner]]
    return owner[take], value[take]


def _class_rows(n: int, percent: int, levels: np.ndarray, limit: int):
    """doc_id, text -> doc_id, size, k1, k2, bitmap, keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.chunks(batch):
                value, at = shingle_sets(K.Texts.of(part.column("text")), n)
                size = np.diff(at)
                listed = (size > limit) | (100 * size >= percent * (limit + 1))
                owner, key = rarest(value, at, levels[(value >> np.uint64(43)).astype(np.int64)], np.where(listed, size + percent * size // -100 + 1, 0))
                light = [(i, subset_keys(value[at[i] : at[i + 1]], percent, limit)) for i in np.flatnonzero((size > 0) & (size <= limit))]
                owner = np.concatenate([owner, *[np.full(len(k), i) for i, k in light]]).astype(np.int64)
                key = np.concatenate([key.view(np.int64), *[np.array(k, np.int64) for _, k in light]])
                order = np.argsort(owner, kind="stable")
                ends = np.append(0, np.cumsum(np.bincount(owner, minlength=len(size)))).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(key[order]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(size, pa.int64()), *[pa.array(x) for x in _digest(value, at)], keys, pa.array(_long_bitmaps(value, at), pa.binary())],
                    names=["doc_id", "size", "k1", "k2", *_BITS, "keys", "bitmap"],
                )

    return run


def nearness(percent: int) -> Nearness:
    """Sets that may link, by size and by the lower bound of their symmetric difference that the parity bitmaps give."""

    def apart(f: Facts, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return sum(np.bitwise_count(f[b][i] ^ f[b][j]).astype(np.int64) for b in _BITS)

    def near(f: Facts, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        one, two = f["size"][i].astype(np.int64), f["size"][j].astype(np.int64)
        return (100 * np.minimum(one, two) >= percent * np.maximum(one, two)) & (apart(f, i, j) * (100 + percent) <= (one + two) * (100 - percent))

    return Nearness({"size": "<i4"} | dict.fromkeys(_BITS, "<u8"), near, apart)


def _dealt(kind: Nearness, parts: int):
    """id, size, bitmap, keys -> the keys, dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(kind, parts)
        for batch in batches:
            n = np.diff(batch.column("keys").offsets.to_numpy())
            row = np.repeat(np.arange(len(n)), n)
            facts = {c: batch.column(c).to_numpy()[row] for c in kind.facts}
            # the rarest elements are those with the smallest hashes of their level: mixed, they spread over all parts
            keys = K.mix(batch.column("keys").flatten().to_numpy().view(np.uint64))
            yield from dealer.add(keys, batch.column("id").to_numpy()[row], kind.numpy(facts))
        yield from dealer.finish()

    return run


#: Bytes of a shingle's hash where sets are compared.
ELEMENT = 6


def _full_sets(n: int, wanted: Sieve):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(wanted.has(batch.column("doc_id").fill_null(0).to_numpy())))
            for part in K.chunks(batch):
                value, at = shingle_sets(K.Texts.of(part.column("text")), n)
                short = value.view(np.uint8).reshape(-1, 8)[:, 8 - ELEMENT :]
                sets = [short[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], names=["id", "elements"])

    return run


def _elements(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // ELEMENT, 8), np.uint8)
    out[:, 8 - ELEMENT :] = np.frombuffer(raw, np.uint8).reshape(-1, ELEMENT)
    return out.view(np.uint64).ravel()


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (one, two) in enumerate(zip(batch.column("sa"), batch.column("sb"), strict=True)):
                both = np.sort(np.concatenate([_elements(one.as_py()), _elements(two.as_py())]))
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def jaccard_components(docs: DataFrame, shingle: int = 3, percent: int = 90) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Documents link where 100 * shared >= percent * union of their shingle sets (words of lower-cased
    ASCII letters; a text of fewer words is one shingle). A null or empty text has an empty set and
    links with nothing. Rows repeated with one doc_id are one document: its sets all belong to it. A
    null doc_id has component null and links with nothing.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent has to be over 50 and at most 100")
    texts = core(docs, "doc_id", "text")
    levels, sizes = corpus_sketch(texts.select("text"), shingle)
    limit = boundary(sizes, percent, float((levels > 0).mean()))
    schema = f"doc_id long, size long, k1 long, k2 long, {', '.join(f'{b} long' for b in _BITS)}, keys array<long>, bitmap binary"
    sets = stash(texts.mapInArrow(lean(_class_rows(shingle, percent, levels, limit)), schema), "sets")
    known = sets.where("size > 0 AND doc_id IS NOT NULL")

    # One class for equal sets; its id is its smallest document.
    with_class = stash(
        group_back(known.select("doc_id", "size", "k1", "k2"), ["k1", "k2", "size"], {"class": (F.min("doc_id"), "min")}, F.col("doc_id"))
        .select("doc_id", "class", "size", "k1", "k2"),
        "classes",
    )
    # a document that is repeated with other texts can stand for several sets: the set's digest is part of the class
    first = with_class.where("doc_id = class").select("doc_id", "size", "k1", "k2").distinct()
    classes = stash(known.join(first, ["doc_id", "size", "k1", "k2"]).dropDuplicates(["doc_id", "k1", "k2"]), "class-sets")
    kind = nearness(percent)
    rows = classes.select(F.col("doc_id").alias("id"), F.col("size").cast("int").alias("size"), *_BITS, "keys")
    shared = nearest_rows(rows.mapInArrow(lean(_dealt(kind, PARTS * tasks_of(docs))), Dealer.KIND), kind)

    spent: list[DataFrame] = []

    def verify(pairs: DataFrame) -> DataFrame:
        """The pairs that link: by long bitmaps first, then by full sets.

        The sets are made again from the texts of just the documents that are left.
        """
        one, two = (classes.select(F.col("doc_id").alias(x), F.col("size").alias(f"n{x}"), F.col("bitmap").alias(f"m{x}")) for x in "ab")
        both = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ma", "mb")
        pairs = stash(both.mapInArrow(lean(_bitmaps_close(percent)), "a long, b long").distinct(), "close")
        spent.append(pairs)
        ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
        with Sieve(ids) as wanted:
            full = stash(texts.mapInArrow(lean(_full_sets(shingle, wanted)), "id long, elements binary"), "elements")
        spent.append(full)
        one, two = (full.select(F.col("id").alias(x), F.col("elements").alias(f"s{x}")) for x in "ab")
        both = pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb")
        return both.mapInArrow(lean(_verified(percent)), "a long, b long").distinct()

    # a copy's link to its class, and a class's to its component
    copies = with_class.where("doc_id <> class").select(F.col("doc_id").alias("a"), F.col("class").alias("b"))
    groups = link(shared, kind, verify)
    discard(shared, classes, *spent)
    groups = groups.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    found = components(copies.unionByName(groups))
    ids = found.alias("f")
    return sets.alias("s").join(ids, F.col("s.doc_id") == F.col("f.node"), "left").select(
        "s.doc_id", F.col("s.size").alias("n_shingles"), F.coalesce("f.component", "s.doc_id").alias("component_id")
    )


def drop_near_copies(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each linked group, the one with the smallest doc_id.

    All rows of the document that stays are kept, and so are documents without an id or without words.
    """
    component = jaccard_components(docs, shingle, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    kept = packed(docs).join(component, F.col("doc_id") == F.col("_gone"), "left_anti")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
