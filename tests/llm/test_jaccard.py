"""The Jaccard join against brute force over all pairs, and components against union-find."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from kairn.llm import graph, lists
from kairn.llm import jaccard_join as J

from .cases import awkward, frame, prose, sf


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if 0 < len(words) < n:
        return {tuple(words)}
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}


def brute(rows, n, percent):
    sets = [(i, shingles(t, n)) for i, t in rows]
    by = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            by[x].append(k)
    edges = []
    for k, (i, s) in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in by[x]:
                shared[j] += j < k
        for j, c in shared.items():
            if i is not None and sets[j][0] is not None and c and 100 * c >= percent * (len(s) + len(sets[j][1]) - c):
                edges.append((i, sets[j][0]))
    comp = roots({i for i, _ in sets if i is not None}, edges)
    return sorted(((i, len(s), comp.get(i)) for i, s in sets), key=str)


def check(df, n=3, percent=90):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(df, n, percent).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in df.collect()], n, percent)
    return len({c for *_, c in got})


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_awkward(spark, n, percent):
    check(frame(spark), n, percent)
    assert J.jaccard_components(frame(spark, [])).count() == 0


@pytest.mark.parametrize("few", [0, 100_000])
def test_table(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    if few < 100:
        # all lists go through the rounds
        monkeypatch.setattr(lists, "FEW", 1)
        monkeypatch.setattr(lists, "SHORT", 3)
        monkeypatch.setattr(lists, "LIST", 9)
    check(spark.read.parquet(f"{sf('sf0.01')}/documents.parquet"))


def test_near_groups(spark):
    rng = random.Random(9)
    rows = []
    for size in (4, 9, 10, 11, 12, 19, 20, 21, 22, 25, 60, 200):
        base = prose(rng, size + 2, 5000).split()
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randrange(0, 3)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.4:
                words += prose(rng, rng.randrange(1, 4)).split()
            rows.append((len(rows), " ".join(words), *[None] * 6))
    assert check(frame(spark, rows)) < len(rows)
    assert check(frame(spark, rows), 5, 80) < len(rows)


def test_light_and_heavy_agree():
    """Every link has a common key for any boundary."""
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 24))
        base = rng.integers(1, 2**62, n + 2).astype(np.uint64)
        a, b = np.unique(base[: n + rng.integers(0, 2)]), np.unique(np.append(base[:n], rng.integers(1, 2**62, rng.integers(0, 3)).astype(np.uint64)))
        shared = len(np.intersect1d(a, b))
        if 100 * shared < 90 * (len(a) + len(b) - shared):
            continue
        for limit in (0, 5, 10, 19, 24):
            keys = []
            for own in (a, b):
                size, mine = len(own), []
                if size <= limit:
                    mine += J.subset_keys(own, 90, limit)
                if size > limit or 100 * size >= 90 * (limit + 1):
                    mine += np.sort(own)[: size - J.need(size, 90) + 1].view(np.int64).tolist()
                keys.append(set(mine))
            assert keys[0] & keys[1]


@pytest.mark.parametrize("few", [0, 100_000])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(200, 300)] + [(rng.randrange(150), rng.randrange(150)) for _ in range(90)]
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = roots({x for e in edges if e[0] != e[1] for x in e}, edges)
    assert {r.node: r.component for r in got} == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
