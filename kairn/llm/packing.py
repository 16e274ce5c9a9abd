"""Packing along a space-filling curve.

Documents become hashed vectors of their words, are projected to a few dimensions and get the
Hilbert key of their cell. The curve is cut into ranges of about equal bytes; each task sorts one by
key, tokenises it and cuts it into sequences, so that neighbours in a sequence are neighbours on the
curve.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .util import core, lean

SEQUENCE, END_ID = 2048, 1
DIMS, BITS = 3, 10
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SPECIAL = "<|endoftext|>"
#: Stretches of the curve whose bytes are counted, bytes of text in a range, and ranges at most (they grow beyond).
BINS, RANGE_BYTES, MAX_RANGES = 1 << 12, 16 << 20, 50_000


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points, shape (n, dims), each coordinate under 2**bits (Skilling, 2004)."""
    x = cells.astype(np.int64).T.copy()
    dims, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(dims):
            hit = (x[i] & q) != 0
            t = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = top
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def curve_keys(t: K.Texts) -> np.ndarray:
    """Hilbert keys of texts: signed word hashes summed in DIMS directions, scaled by text length.

    Summing a random sign of each word for each direction is the hashed bag of words times a random
    sign projection. Divided by the root of the number of words it is about normal; its distribution
    function gives the cell, so the scale needs no pass over the corpus.
    """
    starts, ends, at = t.words()
    n = np.maximum(np.diff(at), 1)
    cells = np.zeros((t.n, DIMS), np.int64)
    if len(starts):
        h = t.spans_hash(starts, ends)
        for d in range(DIMS):
            signs = ((h >> np.uint64(7 * d + 3)) & np.uint64(1)).astype(np.int64) * 2 - 1
            z = K.per_text_sum(signs, at) / np.sqrt(n)
            u = 1 / (1 + np.exp(-1.702 * z / 4))
            cells[:, d] = np.minimum((u * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
    return hilbert_key(cells, BITS)


def tokenizer(path: str, ranks_path: str | None = None, pattern: str | None = None) -> Callable[[str], np.ndarray]:
    """text -> uint32 ids of the tokenizers file at path, add_special_tokens=False.

    With the same vocabulary as ranks, tiktoken does the work, several times faster and with equal
    ids (tests compare them). Texts with the special token's string go to tokenizers, which reads it
    as that token, and so do those that tiktoken's pattern can't match (very long runs of blanks).
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)

    def by_file(text: str) -> np.ndarray:
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    if not ranks_path:
        return by_file
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if SPECIAL not in text:
            try:
                return fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # its regular expression ran out of stack
                pass
        return by_file(text)

    return encode


def _bytes_by_bin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> bin of the curve, bytes of the texts in it."""
    total = np.zeros(BINS, np.int64)
    for batch in batches:
        for part in K.chunks(batch):
            t = K.Texts.of(part.column("text"))
            np.add.at(total, curve_keys(t) >> (DIMS * BITS - 12), np.diff(t.at) + 1)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["bin", "bytes"])


def ranges(total: np.ndarray, size: int, most: int = MAX_RANGES) -> tuple[np.ndarray, np.ndarray]:
    """For each bin its first range and the number of ranges it is dealt over, so that ranges have about `size` bytes.

    Small neighbouring bins share a range; a bin over `size` (many copies of one text) has ranges of its own.
    """
    size = max(size, -(-int(total.sum()) * 2 // most))
    first, dealt, at, room = np.zeros(len(total), np.int64), np.ones(len(total), np.int64), 0, size
    for b, n in enumerate(total.tolist()):
        if n > room and room < size:
            at, room = at + 1, size
        first[b] = at
        if n > size:
            dealt[b] = -(-n // size)
            at += int(dealt[b])
        else:
            room -= n
    return first, dealt


def tail_lengths(n: int) -> list[int]:
    """n under SEQUENCE as powers of two, largest first: sequences of these lengths have no padding."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Cutter:
    """Cuts a run of documents into sequences of SEQUENCE ids; what is left, into powers of two."""

    def __init__(self, first_sequence: int):
        self.sequence, self.room, self.offset = first_sequence, SEQUENCE, 0
        self.open: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        at, n = 0, len(ids)
        while at < n:
            length = min(n - at, self.room)
            self.open.append((doc_id, at, ids[at : at + length], n))
            at, self.room = at + length, self.room - length
            if not self.room:
                yield from self.close([SEQUENCE])

    def close(self, lengths: list[int]) -> Iterator[tuple]:
        """Deal the open pieces to sequences of the given lengths."""
        lengths = iter(lengths)
        size, offset = next(lengths, 0), 0
        for doc_id, start, ids, n in self.open:
            while len(ids):
                own = ids[: size - offset]
                yield doc_id, start, len(own), zlib.crc32(own.astype("<u4").tobytes()), n, self.sequence, offset
                start, ids, offset = start + len(own), ids[len(own) :], offset + len(own)
                if offset == size:
                    self.sequence, size, offset = self.sequence + 1, next(lengths, 0), 0
        self.open, self.room = [], SEQUENCE

    def finish(self) -> Iterator[tuple]:
        yield from self.close(tail_lengths(SEQUENCE - self.room))


def pack(docs: DataFrame, path: str, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids, without padding.

    A document is its ids and then id 1; a null or empty text is that id alone. Returns doc_id,
    start, length, ids_crc32, doc_tokens, sequence_id, offset. A first scan counts bytes along the
    curve, BINS sums in all; ranges of RANGE_BYTES follow from them, and a bin that holds more is dealt
    by id. Texts are shuffled once, to their range, sorted by curve key and id (which splits ties and
    copies), and tokenised there. Each range ends in sequences with lengths of powers of two. Repeated
    rows and null ids are documents of their own. A very long text is one task's, and is tokenised whole.
    """
    texts = core(docs, "doc_id", "text")
    counted = texts.select("text").mapInArrow(lean(_bytes_by_bin), "bin int, bytes long").groupBy("bin").agg(F.sum("bytes").alias("bytes")).collect()
    total = np.zeros(BINS, np.int64)
    for r in counted:
        total[r["bin"]] = r["bytes"]
    first, dealt = ranges(total, RANGE_BYTES)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.chunks(batch):
                key, ids = curve_keys(K.Texts.of(part.column("text"))), part.column("doc_id").fill_null(-1).to_numpy()
                at = key >> (DIMS * BITS - 12)
                where = first[at] + (K.mix(ids.view(np.uint64)) % dealt[at].astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(key), pa.array(where, pa.int32())], names=["doc_id", "text", "key", "part"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = tokenizer(path, ranks_path, pattern)
        cutter, rows = Cutter(TaskContext.get().partitionId() << 40), []
        names, kinds = [c.split()[0] for c in SCHEMA.split(", ")], [pa.int64()] * 7

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                rows.extend(cutter.add(doc_id, np.append(encode(text.as_py() or ""), np.uint32(END_ID))))
                if len(rows) >= 20_000:
                    yield made(rows)
                    rows = []
        rows.extend(cutter.finish())
        if rows:
            yield made(rows)

    keyed = texts.mapInArrow(lean(keys), "doc_id long, text string, key long, part int")
    dealt_rows = keyed.repartitionById(int((first + dealt).max()), F.col("part"))
    return dealt_rows.sortWithinPartitions("key", "doc_id").select("doc_id", "text").mapInArrow(lean(cut), SCHEMA)
