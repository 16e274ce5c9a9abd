"""Array kernels over batches of texts: words, 64-bit hashes, n-grams, lines.

Texts are handled as UTF-8 bytes taken from Arrow buffers. All separators are ASCII, so bytes and
code points give the same words. Hashes mix eight bytes at a time; those of long spans and of n-grams
are polynomials modulo 2**64, mixed at the end. They depend on the bytes alone, never on the process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_CODES = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.int64).astype(U64) | U64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_WORD_BASE = 0xD6E8FEB86659FD93
_WORD_BASE_INV = pow(_WORD_BASE, -1, 2**64)
#: Texts of this many bytes are worked on together; a longer text is worked on alone and whole.
CHUNK = 1 << 19
#: Spans of more bytes are hashed by running sums over all bytes.
LONG = 64
#: The lowest k bytes of eight.
_LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)

IS_WORD = np.ones(256, bool)
IS_WORD[[32, 9, 10, 11, 12, 13]] = False

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1024)
        have = np.empty(size, U64)
        have[0] = 1
        have[1:] = U64(base)
        np.multiply.accumulate(have, out=have)
        if size <= 4 * CHUNK:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def order_of(x: np.ndarray) -> np.ndarray:
    """An order that sorts unsigned 64-bit x. Values with their places in the lower bits are sorted, which
    is several times faster than argsort; what is equal in the upper bits is then sorted by all bits."""
    n = len(x)
    if n < 2:
        return np.arange(n)
    places = (1 << (n - 1).bit_length()) - 1
    packed = np.sort(((x << U64(64 - max(1, int(x.max()).bit_length()))) & ~U64(places)) | np.arange(n, dtype=U64))
    order, same = (packed & U64(places)).astype(np.int64), (packed[1:] ^ packed[:-1]) <= U64(places)
    ties = np.flatnonzero(np.append(same, False) | np.append(False, same))
    order[ties] = order[ties][np.argsort(x[order[ties]], kind="stable")]
    return order


class Texts:
    """Some texts as one byte array; text i is data[at[i]:at[i + 1]]."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at = data, at
        self.n = len(at) - 1
        self._sums: np.ndarray | None = None
        self._eight: np.ndarray | None = None

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        """From an Arrow string array; null is the empty text."""
        column = pc.fill_null(column, "")
        if not pa.types.is_large_string(column.type):
            column = column.cast(pa.large_string())
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        return cls(whole[at[0] : at[-1]], at - at[0])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and where each text's words begin (n + 1 offsets)."""
        if not len(self.data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(self.n + 1, np.int64)
        w = IS_WORD[self.data]
        before = np.empty_like(w)
        before[0], before[1:] = False, w[:-1]
        inner = self.at[:-1][self.at[:-1] < len(w)]
        before[inner] = False
        after = np.empty_like(w)
        after[-1], after[:-1] = False, w[1:]
        ends = self.at[1:]
        after[ends[ends > 0] - 1] = False
        starts = np.flatnonzero(w & ~before)
        return starts, np.flatnonzero(w & ~after) + 1, np.searchsorted(starts, self.at)

    def spans_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of the bytes of each span: eight bytes at a time, long spans from running sums."""
        size = ends - starts
        if len(size) and size.max() > LONG:
            out, long = np.empty(len(size), U64), size > LONG
            out[long] = self._long_hash(starts[long], ends[long])
            out[~long] = self._short_hash(starts[~long], size[~long])
            return out
        return self._short_hash(starts, size)

    def _short_hash(self, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        if self._eight is None:
            padded = np.append(self.data, np.zeros(8, np.uint8))
            self._eight = np.ndarray(len(self.data) + 1, "<u8", padded, 0, (1,))
        out = mix(left.astype(U64) ^ (self._eight[at] & _LOWEST[np.minimum(left, 8)]))
        more = np.flatnonzero(left > 8)
        at, left = at[more] + 8, left[more] - 8
        while len(more):
            out[more] = mix(out[more] ^ (self._eight[at] & _LOWEST[np.minimum(left, 8)]))
            on = left > 8
            more, at, left = more[on], at[on] + 8, left[on] - 8
        return out

    def _long_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self._sums is None:
            n = len(self.data)
            self._sums = np.zeros(n + 1, U64)
            np.cumsum(_CODES[self.data] * powers(_BASE, n), out=self._sums[1:])
        inverse = powers(_BASE_INV, len(self.data) + 1)
        raw = (self._sums[ends] - self._sums[starts]) * inverse[starts]
        return mix(raw ^ ((ends - starts).astype(U64) * U64(0xA24BAED4963EE407)))


def lowered(t: Texts) -> Texts:
    """A-Z in lower case, nothing else changed."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return Texts(table[t.data], t.at)


def ngram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n consecutive words; the result has max(0, len - n + 1) values."""
    m = len(words)
    if m < n:
        return np.zeros(0, U64)
    sums = np.zeros(m + 1, U64)
    np.cumsum(words * powers(_WORD_BASE, m), out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * powers(_WORD_BASE_INV, m)[: m - n + 1])


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """batch in slices whose texts have about `size` bytes; each text stays whole."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(lengths, dtype=np.int64) // size
    cut = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def per_text_sum(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of values[at[i]:at[i + 1]] for each i, also where that is empty."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]
