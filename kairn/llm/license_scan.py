"""License scans: short notices found with a bounded number of edits.

A phrase of at most k edits, cut into k + 1 parts, has one part unchanged. Exact search for the
parts locates candidates in the normalised text; the regex library then matches the whole phrase
there with up to k errors and reports spans.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import kernels as K
from .util import core, lean

# fixed values: the contract's phrases and their labels
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices that only the fuzzy search looks for.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "creative commons attribution": "cc-by",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "all rights reserved": "reserved",
}
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:int,end:int,edits:int>>"
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def edits_allowed(phrase: str) -> int:
    """One error for each ten characters, three at most; phrases under eight are exact."""
    return min(3, len(phrase) // 10) if len(phrase) >= 8 else 0


class Notice:
    def __init__(self, phrase: str, label: str):
        self.phrase, self.label, self.k = phrase, label, edits_allowed(phrase)
        n = len(phrase)
        cuts = [n * i // (self.k + 1) for i in range(self.k + 2)]
        self.parts = [(a, phrase[a:b].encode()) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.pattern = regex.compile(rf"(?b)(?<= )(?:{regex.escape(phrase)}){{e<={self.k}}}(?= )") if self.k else None

    def find(self, text: bytes) -> list[tuple[int, int, int]]:
        """(start, end, edits) of matches in normalised words joined by one space, with a space at both ends.

        Each seed has a window of its own, as wide as a match around it can be; the best match in it
        counts. Of matches that overlap, those with the fewest edits stay, then the first.
        """
        if not self.k:
            whole, at, exact = b" " + self.parts[0][1] + b" ", -1, []
            while (at := text.find(whole, at + 1)) >= 0:
                exact.append((at + 1, at + len(whole) - 1, 0))
            return exact
        found, wide = set(), 4 * self.k + 1  # an inserted character has four bytes at most
        for offset, part in self.parts:
            at = -1
            while (at := text.find(part, at + 1)) >= 0:
                low = max(0, at - offset - wide)
                # bytes of a character that the window cuts stand for themselves
                window = text[low : at - offset + len(self.phrase) + wide].decode("utf-8", "surrogateescape")
                if m := self.pattern.search(window):
                    start = low + len(window[: m.start()].encode("utf-8", "surrogateescape"))
                    found.add((sum(m.fuzzy_counts), start, start + len(m.group().encode("utf-8", "surrogateescape"))))
        kept: list[tuple[int, int, int]] = []
        for edits, start, end in sorted(found):
            i = bisect.bisect(kept, (start, end, edits))
            if (i == 0 or kept[i - 1][1] <= start) and (i == len(kept) or end <= kept[i][0]):
                kept.insert(i, (start, end, edits))
        return kept


def scan(raw: bytes, base: list[Notice], all_: list[Notice]) -> tuple:
    clean = raw.translate(_TABLE)
    words = clean.split()
    row = [len(words), 0, None, None, "", "", 0.0, []]
    text = b" " + b" ".join(words) + b" "
    if not any(part in text for n in all_ for _, part in n.parts):
        return tuple(row)
    blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    labels, places, spans, score = set(), [], [], 0.0
    for n in base:
        whole, at = b" " + n.phrase.encode() + b" ", -1
        while (at := text.find(whole, at + 1)) >= 0:
            places.append(at)
            labels.add(n.label)
    every = set(labels)
    for n in all_:
        for start, end, edits in n.find(text):
            every.add(n.label)
            first, last = np.searchsorted(blanks, (start, end))
            spans.append({"label": n.label, "start": int(first) - 1, "end": int(last), "edits": edits})
            score = max(score, 1 - edits / len(n.phrase))
    if places:
        # a place is the blank before a phrase: as many words stand before it as blanks
        row[1:4] = [len(places), *np.searchsorted(blanks, (min(places), max(places))).tolist()]
        score = 1.0
    row[4:] = [",".join(sorted(labels)), ",".join(sorted(every)), score, spans]
    return tuple(row)


def license_scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, notices: Mapping[str, str] = NOTICES) -> DataFrame:
    """One row per document: exact places of `phrases`, and labels and spans of the fuzzy search.

    A-Z counts as lower case; words are runs of ASCII letters, digits and all non-ASCII characters.
    n_base counts all places where a phrase's words stand consecutively; spans (word positions, end
    exclusive, and edits) come from the fuzzy search over phrases and notices. score is the best
    similarity found, 1 for an exact phrase, 0 for none. Null or empty texts have no words and empty
    labels; repeated rows and null ids get a row each. Reads whole texts, no shuffle; time grows with a
    text's length and the places found in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = [Notice(p, label) for p, label in phrases.items()]
        all_ = base + [Notice(p, label) for p, label in notices.items()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for part in K.chunks(batch):
                t = K.Texts.of(part.column("text"))
                data, at = t.data.tobytes(), t.at.tolist()
                rows = [scan(data[a:b], base, all_) for a, b in zip(at, at[1:], strict=False)]
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)]], names=names)

    return core(docs, "doc_id", "text").mapInArrow(lean(run), SCHEMA)
