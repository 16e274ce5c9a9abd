"""Substring dedup against brute force over all windows."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from kairn.llm import substring_dedup as S

from .cases import awkward, frame, prose, sf


def brute(rows):
    first = {}
    docs = [(2**63 - 1 if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, words in docs:
        for k in range(len(words) - 49):
            w = tuple(words[k : k + 50])
            first[w] = min(first.get(w, i), i)
    out = []
    for i, words in docs:
        hit = set()
        for k in range(len(words) - 49):
            if first[tuple(words[k : k + 50])] < i:
                hit |= set(range(k, k + 50))
        kept = b" ".join(w for k, w in enumerate(words) if k not in hit)
        out.append((i, len(words), len(hit), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check(df):
    got = [(2**63 - 1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in S.substring_dedup(df).collect()]
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    assert sorted(got) == want
    return sum(r[2] for r in want)


def test_awkward(spark):
    assert check(frame(spark)) > 0
    assert S.substring_dedup(frame(spark, [])).count() == 0


def test_table(spark):
    assert check(spark.read.parquet(f"{sf('sf0.01')}/documents.parquet")) > 0


@pytest.mark.parametrize("hot", [3, 1024])
def test_planted(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    rng = random.Random(5)
    passages = [prose(rng, n, 50) for n in (50, 51, 60, 120)]
    rows = [(i, f"{prose(rng, rng.randrange(0, 60), 50)} {rng.choice(passages)} {prose(rng, rng.randrange(0, 60), 3)}", *[None] * 6) for i in range(60)]
    rows += [(100 + i, "x " * (45 + 3 * i), *[None] * 6) for i in range(6)] + awkward()[:3]
    assert check(frame(spark, rows)) > 1000


def test_fm_index():
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = rng.integers(1, 40, rng.integers(1, 12))
        starts = np.append(0, np.cumsum(lengths))[:-1]
        symbols = rng.integers(1, 4, lengths.sum())
        owners = rng.integers(0, 100, len(lengths))
        got = S.FMIndex(symbols, starts, lengths, owners, 5).owners_of(symbols, starts, lengths)
        best = defaultdict(lambda: 1000)
        own = {}
        for s, n, o in zip(starts, lengths, owners, strict=True):
            for k in range(s, s + n - 4):
                own[k] = tuple(symbols[k : k + 5])
                best[own[k]] = min(best[own[k]], o)
        assert [got[k] for k in own] == [best[w] for w in own.values()]


def test_wavelet():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 37, 500)
    w = S.WaveletMatrix(codes, 37)
    i = np.arange(501)
    for c in range(37):
        assert (w.rank(np.full(501, c), i) == np.append(0, np.cumsum(codes == c))).all()
