"""Language identification: gradients, held-out accuracy, awkward rows."""

import zlib

import numpy as np

from kairn.llm import langid as L

from .cases import frame, sf


def test_gradient():
    rng = np.random.default_rng(0)
    net = L.GatedNetwork(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(60, 70, (6, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    mask = rng.random((6, 5)) < 0.8
    g, _ = net.gradient(x, mask, y)
    for k, w in net.p.items():
        for _ in range(4):
            i = tuple(rng.integers(0, n) for n in w.shape) if not k.startswith("E") else (int(rng.integers(60, 70)), int(rng.integers(0, L.HIDDEN)))
            old, eps = w[i], 1e-4
            w[i] = old + eps
            up = net.gradient(x, mask, y)[1]
            w[i] = old - eps
            down = net.gradient(x, mask, y)[1]
            w[i] = old
            assert abs((up - down) / (2 * eps) - g[k][i]) < 1e-4 + 1e-2 * abs(g[k][i]), k


def test_fast_pass_is_the_trained_one():
    net = L.GatedNetwork(["a", "b"])
    x = np.random.default_rng(1).integers(0, 256, (L.WINDOW, 7)).astype(np.uint8)
    out = net.position_scores(x)
    e = np.exp(out) / np.exp(out).sum(axis=2, keepdims=True)
    y = np.zeros(7, int)
    loss = net.gradient(x, np.ones(x.shape, bool), y)[1]
    assert abs(-np.log(e[:, :, 0]).mean() - loss) < 1e-4


def test_accuracy(spark):
    df = spark.read.parquet(f"{sf('sf0.01')}/documents.parquet")
    lang = {r.doc_id: r.lang for r in df.collect()}
    got = L.language_id(df).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out and r.lang_pred != "und"]
    assert np.mean(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    kept = L.keep_known_languages(df)
    assert kept.columns == df.columns and kept.count() >= 0.97 * len(lang)


def test_awkward(spark):
    df = frame(spark)
    got = L.language_id(df)
    assert got.count() == df.count()
    texts = {r.doc_id: r.text for r in df.collect() if r.doc_id is not None}
    for r in got.collect():
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or ""))
    assert L.language_id(frame(spark, [])).count() == 0
    assert L.keep_known_languages(df).columns == df.columns


def test_positions():
    net = L.GatedNetwork(["a", "b"])
    assert len(net.label_positions("é" * 200)) == 400 and net.label_positions("") == []
