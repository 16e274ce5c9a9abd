"""Language identification with a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time. A text is read in windows of WINDOW bytes; every
byte gets label probabilities from the state before and behind it in its window, and a document's
probabilities are the mean over its letters.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .util import core, packed

WINDOW, HIDDEN, BATCH = 128, 8, 2048
#: The training sample: about this many documents of each language, and windows of each document.
SAMPLE_DOCS, SAMPLE_WINDOWS = 400, 6
#: More languages than this are refused, so the sample is bounded.
MAX_LANGUAGES = 500
#: Updates, windows in each, and the first learning rate.
UPDATES, STEP, RATE = 200, 256, 0.02
UND = "und"
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class GatedNetwork:
    """Two gated recurrent layers, one for each direction, and a softmax over languages.

    z, r = sigmoid(E[byte] + h U); n = tanh(En[byte] + r * (h Un + bn)); h = n + z * (h - n).
    """

    def __init__(self, languages: Sequence[str], seed: int = 11):
        rng, self.languages, c = np.random.default_rng(seed), list(languages), len(languages)
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            for gate in "zrn":
                self.p[f"E{gate}{d}"] = rng.normal(0, 0.3, (256, HIDDEN)).astype(np.float32)
                self.p[f"U{gate}{d}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, HIDDEN)).astype(np.float32)
            self.p[f"bn{d}"] = np.zeros(HIDDEN, np.float32)
            self.p[f"W{d}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, c)).astype(np.float32)
        self.p["b"] = np.zeros(c, np.float32)

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Gradient of the mean cross-entropy of all unmasked positions. x: bytes (time, rows)."""
        p, (steps, rows) = self.p, x.shape
        tape: dict[str, list] = {}
        out = np.broadcast_to(p["b"], (steps, rows, len(p["b"]))).copy()
        for d in "fb":
            h, tape[d] = np.zeros((rows, HIDDEN), np.float32), []
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                z = _sigmoid(p[f"Ez{d}"][x[t]] + h @ p[f"Uz{d}"])
                r = _sigmoid(p[f"Er{d}"][x[t]] + h @ p[f"Ur{d}"])
                q = h @ p[f"Un{d}"] + p[f"bn{d}"]
                n = np.tanh(p[f"En{d}"][x[t]] + r * q)
                new = n + z * (h - n)
                tape[d].append((t, h, z, r, q, n, new))
                out[t] += new @ p[f"W{d}"]
                h = new
        e = np.exp(out - out.max(axis=2, keepdims=True))
        e /= e.sum(axis=2, keepdims=True)
        total = max(1, int(mask.sum()))
        hit = np.arange(rows)
        loss = float(-(np.log(e[:, hit, y] + 1e-9) * mask).sum() / total)
        e[:, hit, y] -= 1
        e *= (mask / total)[:, :, None]
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["b"] = e.sum(axis=(0, 1))
        flat = x.reshape(-1)
        order = np.argsort(flat, kind="stable")
        values, cuts = np.unique(flat[order], return_index=True)
        for d in "fb":
            dh = np.zeros((rows, HIDDEN), np.float32)
            da = {gate: np.zeros((steps, rows, HIDDEN), np.float32) for gate in "zrn"}
            for t, h, z, r, q, n, new in reversed(tape[d]):
                g[f"W{d}"] += new.T @ e[t]
                dh = dh + e[t] @ p[f"W{d}"].T
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dq, dr = dn * r, dn * q * r * (1 - r)
                g[f"Uz{d}"] += h.T @ dz
                g[f"Ur{d}"] += h.T @ dr
                g[f"Un{d}"] += h.T @ dq
                g[f"bn{d}"] += dq.sum(axis=0)
                da["z"][t], da["r"][t], da["n"][t] = dz, dr, dn
                dh = dh * z + dz @ p[f"Uz{d}"].T + dr @ p[f"Ur{d}"].T + dq @ p[f"Un{d}"].T
            for gate in "zrn":
                g[f"E{gate}{d}"][values] = np.add.reduceat(da[gate].reshape(-1, HIDDEN)[order], cuts, axis=0)
        return g, loss

    def fit(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, seed: int = 12) -> None:
        """Adam over shuffled batches. x, mask: (windows, WINDOW); y: language numbers."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        order = np.concatenate([rng.permutation(len(x)) for _ in range(-(-UPDATES * STEP // len(x)))])
        for step in range(UPDATES):
            own = order[step * STEP : (step + 1) * STEP]
            g, _ = self.gradient(np.ascontiguousarray(x[own].T), np.ascontiguousarray(mask[own].T), y[own])
            rate = RATE * (1 - step / UPDATES) * np.sqrt(1 - 0.999 ** (step + 1)) / (1 - 0.9 ** (step + 1))
            for k, w in self.p.items():
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] * g[k] - v[k])
                w -= rate * m[k] / (np.sqrt(v[k]) + 1e-8)

    def position_scores(self, x: np.ndarray) -> np.ndarray:
        """Scores before softmax for every position. x: bytes (time, rows)."""
        p, (steps, rows) = self.p, x.shape
        out = np.empty((steps, rows, len(self.languages)), np.float32)
        f32 = np.float32
        tz, tr, n, q, a, own = (np.empty((rows, HIDDEN), f32) for _ in range(6))
        part = np.empty((rows, len(self.languages)), f32)
        for d in "fb":
            # sigmoid(v) = (tanh(v / 2) + 1) / 2: halves go into the weights
            ez, er, en = 0.5 * p[f"Ez{d}"], 0.5 * p[f"Er{d}"], p[f"En{d}"]
            uz, ur, un, bn, w = 0.5 * p[f"Uz{d}"], 0.5 * p[f"Ur{d}"], 0.5 * p[f"Un{d}"], 0.5 * p[f"bn{d}"], p[f"W{d}"]
            h = np.zeros((rows, HIDDEN), f32)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                c = x[t]
                np.take(ez, c, axis=0, out=tz, mode="clip")
                np.dot(h, uz, out=a)
                tz += a
                np.tanh(tz, out=tz)
                np.take(er, c, axis=0, out=tr, mode="clip")
                np.dot(h, ur, out=a)
                tr += a
                np.tanh(tr, out=tr)
                np.dot(h, un, out=q)
                q += bn
                tr += 1
                tr *= q
                np.take(en, c, axis=0, out=n, mode="clip")
                n += tr
                np.tanh(n, out=n)
                tz += 1
                tz *= 0.5
                np.subtract(h, n, out=own)
                own *= tz
                np.add(n, own, out=h)
                if d == "f":
                    np.dot(h, w, out=out[t])
                else:
                    np.dot(h, w, out=part)
                    out[t] += part
        out += p["b"]
        return out

    def texts(self, t: K.Texts) -> np.ndarray:
        """Mean label probabilities over the letters of each text, (texts, languages); 0 without letters."""
        starts, owner = windows(t)
        pooled = np.zeros((t.n, len(self.languages)))
        for a in range(0, len(starts), BATCH):
            x, mask = window_bytes(t, starts[a : a + BATCH], t.at[owner[a : a + BATCH] + 1])
            mask &= _LETTER[x]
            e = self.position_scores(np.ascontiguousarray(x.T))
            np.exp(e, out=e)
            weight = mask.T / e.sum(axis=2)
            np.add.at(pooled, owner[a : a + BATCH], np.einsum("twc,tw->wc", e, weight.astype(np.float32)))
        letters = K.per_text_sum(_LETTER[t.data], t.at)
        return pooled / np.maximum(letters, 1)[:, None]

    def label_positions(self, text: str) -> list[str]:
        """The language of every byte of a text."""
        t = K.Texts.of(pa.array([text]))
        starts, owner = windows(t)
        if not len(starts):
            return []
        x, mask = window_bytes(t, starts, t.at[owner + 1])
        best = self.position_scores(np.ascontiguousarray(x.T)).argmax(axis=2).T
        return [self.languages[i] for i in best[mask]]


def windows(t: K.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows, and their texts."""
    each = -(-np.diff(t.at) // WINDOW)
    owner = np.repeat(np.arange(t.n), each)
    first = np.cumsum(each) - each
    return t.at[:-1][owner] + (np.arange(len(owner)) - first[owner]) * WINDOW, owner


def window_bytes(t: K.Texts, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of windows, 0 behind the text's end, and which positions are text."""
    at = starts[:, None] + np.arange(WINDOW)
    mask = at < ends[:, None]
    return np.where(mask, t.data[np.minimum(at, len(t.data) - 1)], 0).astype(np.uint8), mask


def held_out():
    """Whether crc32 of doc_id as text is 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame) -> GatedNetwork:
    """A network for the languages of documents that are not held out.

    The fitting sample is bounded: about SAMPLE_DOCS documents of each language, by a hash of the id,
    and SAMPLE_WINDOWS windows of each. Only their text and lang are used.
    """
    rows = core(docs, "doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(counts)
    if not languages:
        return GatedNetwork([UND])
    spark = docs.sparkSession
    shares = spark.createDataFrame([(k, min(1.0, SAMPLE_DOCS / counts[k])) for k in languages], "lang string, share double")
    some = (
        rows.join(F.broadcast(shares), "lang")
        .where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < F.col("share") * 1_000_000)
        # one text of an id, then the first by hash: repeated rows neither crowd the sample nor change it
        .groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
        .orderBy(F.xxhash64("doc_id", "lang"), "doc_id", "lang").limit(2 * SAMPLE_DOCS * len(languages))
        .select("doc_id", "lang", "text").mapInArrow(_some_windows, "doc_id long, lang string, bytes binary, n int")
    )
    got = sorted(some.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["lang"], bytes(r["bytes"])))
    net = GatedNetwork(languages)
    if len(languages) > 1 and got:
        x = np.stack([np.frombuffer(r["bytes"], np.uint8) for r in got])
        mask = np.arange(WINDOW) < np.array([r["n"] for r in got])[:, None]
        net.fit(x, mask & _LETTER[x], np.array([languages.index(r["lang"]) for r in got]))
    return net


def _some_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t = K.Texts.of(batch.column("text"))
        starts, owner = windows(t)
        x, mask = window_bytes(t, starts, t.at[owner + 1]) if len(starts) else (np.zeros((0, WINDOW), np.uint8), np.zeros((0, WINDOW), bool))
        # evenly spread windows of each text
        each = np.bincount(owner, minlength=t.n)
        first = np.cumsum(each) - each
        take = np.unique(np.concatenate([first[i] + np.arange(SAMPLE_WINDOWS) * each[i] // SAMPLE_WINDOWS for i in range(t.n) if each[i]] or [np.zeros(0, int)])).astype(int)
        who = pa.array(owner[take])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(who), batch.column("lang").take(who), pa.array([r.tobytes() for r in x[take]], pa.binary()), pa.array(mask[take].sum(axis=1), pa.int32())],
            names=["doc_id", "lang", "bytes", "n"],
        )


_ASCII_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def predict(rows: DataFrame, net: GatedNetwork) -> DataFrame:
    """rows with lang_pred and score beside them; reads the column text."""
    names = rows.columns
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.chunks(batch):
                texts = part.column("text")
                pooled = net.texts(K.Texts.of(texts))
                best, score = pooled.argmax(axis=1), pooled.max(axis=1)
                # a look at the characters is only needed where there is no ASCII letter
                t = K.Texts.of(texts)
                letter = K.per_text_sum(_ASCII_LETTER[t.data], t.at) > 0
                for i in np.flatnonzero(~letter):
                    letter[i] = _has_letter(texts[int(i)].as_py())
                label = [net.languages[i] if ok else UND for i, ok in zip(best, letter, strict=True)]
                score = np.where(letter, np.clip(score, 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(label, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def language_id(docs: DataFrame, net: GatedNetwork | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    The network learns from text and lang of rows that are not held out; a prediction sees the text
    alone. lang_pred is `und`, with score 0, for a null text or one without a letter, and where no
    row has a language to learn. Repeated rows and null ids get a row each.
    """
    net = net or train(docs)
    out = predict(core(docs, "doc_id", "text"), net)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known_languages(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """docs without those whose language isn't recognised: `und`, or a score under `least`."""
    out = predict(packed(docs).select("text", "row"), train(docs))
    out = out.where((F.col("lang_pred") != UND) & (F.col("score") >= least))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
