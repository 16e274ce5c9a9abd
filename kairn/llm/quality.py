"""Quality rules: repetition from suffix arrays, beside plain counts.

Method: the words of a batch of texts get one suffix array, sorted by prefix doubling; suffixes of
different texts never compare equal. Intervals of the longest common prefixes are the repeated
substrings; those that no word before them extends are maximal. The union of their spans is the
covered part, counted in characters, and the longest of them the longest repeat; both have limits
below those of the base rule, which counts repeated windows of five words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .util import core, lean

SYMBOLS = "#*$%&|<>"
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_repeats long, covered_words long, covered_chars long, longest_repeat long"
)


def suffix_array(symbols: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and longest common prefixes of several sequences at once.

    symbols: dense codes from 0 that differ between sequences; end: for each position where its
    sequence ends. Returns sa and lcp, where lcp[t] belongs to sa[t - 1] and sa[t] (lcp[0] = 0).
    Memory is a few numbers for each symbol, whatever repeats.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sa = np.argsort(symbols, kind="stable")
    ordered = symbols[sa]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    width = 1
    while True:
        alone = new & np.append(new[1:], True)
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        at = sa[slots]
        nxt = at + width
        inside = nxt < end[at]
        second = np.where(inside, rank[np.minimum(nxt, n - 1)] + 1, 0)
        order = np.lexsort((second, rank[at]))
        at, first, second = at[order], rank[at][order], second[order]
        sa[slots] = at
        fresh = np.ones(len(slots), bool)
        fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        new[slots] = fresh
        rank[at] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        width *= 2
    return sa, common_prefixes(symbols, sa, end)


def common_prefixes(symbols: np.ndarray, sa: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For neighbours in sa the length of their common prefix, by bisection over hashes of substrings."""
    n = len(symbols)
    lcp, codes = np.zeros(n, np.int64), K.mix(symbols.astype(np.uint64))
    pairs = np.flatnonzero(symbols[sa[1:]] == symbols[sa[:-1]]) + 1
    if not len(pairs):
        return lcp
    sums, back = np.zeros(n + 1, np.uint64), K.powers(K._WORD_BASE_INV, n + 1)
    np.cumsum(codes * K.powers(K._WORD_BASE, n), out=sums[1:])
    a, b = sa[pairs - 1], sa[pairs]
    low, high = np.ones(len(pairs), np.int64), np.minimum(end[a] - a, end[b] - b)
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = (sums[a + middle] - sums[a]) * back[a] == (sums[b + middle] - sums[b]) * back[b]
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    lcp[pairs] = low
    return lcp


def intervals(lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(left, right, length) of the intervals of the suffix array whose suffixes share `length` >= least words, and no more."""
    out: list[tuple[int, int, int]] = []
    inside = np.flatnonzero(lcp >= least)
    if not len(inside):
        return out
    cut = np.flatnonzero(np.diff(inside) > 1) + 1
    for run in np.split(inside, cut):
        stack: list[tuple[int, int]] = []
        for t, value in zip([*run.tolist(), int(run[-1]) + 1], [*lcp[run].tolist(), 0], strict=True):
            left = t - 1
            while stack and stack[-1][1] > value:
                left, length = stack.pop()
                out.append((left, t - 1, length))
            if value and (not stack or stack[-1][1] < value):
                stack.append((left, value))
    return out


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in one of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def suffixes(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array and common prefixes of the words of some texts, and the codes they were made from."""
    n = len(hashes)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(n, bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    symbols = np.empty(n, np.int64)
    symbols[order] = np.cumsum(new) - 1
    return *suffix_array(symbols, at[1:][text]), symbols


def maximal_repeats(sa: np.ndarray, lcp: np.ndarray, symbols: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """(place, length) of each maximal repeated substring: one of its occurrences, and its words.

    An interval is maximal if its occurrences differ in the word before them; a text's first word,
    which `starts` marks, has none before it.
    """
    found = np.array(intervals(lcp, least), np.int64).reshape(-1, 3)
    before = np.where(starts[sa], -1 - sa, symbols[sa - 1])
    changes = np.append(0, np.cumsum(before[1:] != before[:-1]))
    found = found[changes[found[:, 1]] > changes[found[:, 0]]] if len(found) else found
    return np.stack([sa[found[:, 0]], found[:, 2]], axis=1)


def measure(t: K.Texts, min_repeat: int) -> dict[str, np.ndarray]:
    starts, ends, at = t.words()
    n_words = np.diff(at)
    lead = (t.data & 0xC0) != 0x80
    points = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum(lead, out=points[1:])
    word_chars = K.per_text_sum(points[ends] - points[starts], at)
    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOLS.encode())] = True
    n_symbols = K.per_text_sum(is_symbol[t.data], t.at)

    # Lines: cut at \n and at the ends of texts.
    breaks = np.flatnonzero(t.data == 10)
    line_start = np.sort(np.concatenate([t.at[:-1], breaks + 1]), kind="stable")
    owner = np.searchsorted(t.at[1:], np.concatenate([breaks]), side="right")
    per_text = np.bincount(owner, minlength=t.n) + 1
    line_text = np.repeat(np.arange(t.n), per_text)
    # a break at a text's end and the next text's start fall on one place, in that order
    first_line = np.zeros(t.n + 1, np.int64)
    np.cumsum(per_text, out=first_line[1:])
    line_end = np.empty(len(line_start), np.int64)
    line_end[:-1] = line_start[1:] - 1
    line_end[first_line[1:] - 1] = t.at[1:]
    has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_text = line_start[has_word], line_end[has_word], line_text[has_word]
    line_hash = t.spans_hash(line_start, line_end) if len(line_start) else np.zeros(0, np.uint64)
    order = np.lexsort((line_hash, line_text))
    h, o = line_hash[order], line_text[order]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (o[1:] == o[:-1])
    n_dup_lines = np.bincount(o[again], minlength=t.n)

    sa, lcp, symbols = suffixes(t.spans_hash(starts, ends) if len(starts) else np.zeros(0, np.uint64), at)
    n = len(sa)
    longest = np.zeros(n, np.int64)
    longest[sa] = np.maximum(lcp, np.append(lcp[1:], 0)) if n else 0
    five = np.flatnonzero(longest >= 5)
    n_repeat_words = K.per_text_sum(covered(five, np.full(len(five), 5), n), at)

    head = np.zeros(n, bool)
    head[at[:-1][n_words > 0]] = True
    place, length = maximal_repeats(sa, lcp, symbols, head, min_repeat).T
    owner = np.searchsorted(at, place, side="right") - 1
    longest_repeat = np.zeros(t.n, np.int64)
    np.maximum.at(longest_repeat, owner, length)
    # of the maximal repeats that occur at a word, the longest one's span holds the others'
    long = np.flatnonzero(longest >= min_repeat)
    hidden = covered(long, longest[long], n)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words,
        "n_repeats": np.bincount(owner, minlength=t.n),
        "covered_words": K.per_text_sum(hidden, at), "covered_chars": K.per_text_sum(hidden * (points[ends] - points[starts]), at), "longest_repeat": longest_repeat,
    }


#: Limits of the method: words of a repeat that counts, share of the characters they may cover, and
#: words and share of all words that the longest repeat may have.
MIN_REPEAT, MAX_COVERED, LONGEST_WORDS, LONGEST_SHARE = 10, 0.1, 50, 0.05


def quality_rules(
    docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, longest_words: int = LONGEST_WORDS, longest_share: float = LONGEST_SHARE
) -> DataFrame:
    """One row per document with its counts and the verdict `kept`; reads whole texts, no shuffle.

    base_failed: under 10 words, or over 20% of the words in 5-word windows that occur twice or more.
    The method fails a document where maximal repeats of min_repeat words or more (n_repeats of them)
    cover over max_covered of the characters of its words, or where the longest of them has over
    longest_words words and over longest_share of them all. A null or empty text has no words and
    fails the base rule; repeated rows and null ids get a row each. A very long text is worked on
    alone, whole, with memory of some 200 bytes a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.chunks(batch):
                m = measure(K.Texts.of(part.column("text")), min_repeat)
                n = m["n_words"]
                failed = (n < 10) | (100 * m["n_repeat_words"] > 20 * n)
                bad = (m["covered_chars"] > max_covered * m["word_chars"]) | ((m["longest_repeat"] > longest_words) & (m["longest_repeat"] > longest_share * n))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        *[pa.array(m[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                        pa.array(failed), pa.array(~failed & ~bad),
                        *[pa.array(m[k], pa.int64()) for k in ("n_repeats", "covered_words", "covered_chars", "longest_repeat")],
                    ],
                    names=[c.split()[0] for c in SCHEMA.split(", ")],
                )

    return core(docs, "doc_id", "text").mapInArrow(lean(run), SCHEMA)
