"""Operators 1, 3, 5, 8 and 10 against brute force on small and awkward documents."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from kairn.llm import kernels as K
from kairn.llm import queries as Q
from kairn.llm.exact_dedup import exact_dedup
from kairn.llm.license_scan import NOTICES, PHRASES, Notice, license_scan
from kairn.llm.mix import fill_targets, mix_documents, mix_shards, mix_sources, permuted
from kairn.llm.packing import SEQUENCE, hilbert_key, pack, ranges, tokenizer
from kairn.llm.quality import quality_rules, suffix_array

from .cases import COLUMNS, awkward, frame, sf

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, name="sf0.001"):
    return [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf(name)}/documents.parquet").collect()]


def key(row):
    return tuple((x is None, x) for x in row)


def test_permutation_is_one():
    for n in (1, 2, 3, 17, 1000):
        assert sorted(permuted(np.arange(n), n, 5)) == list(range(n))


def test_targets():
    t = fill_targets([100, 10, 50], [3, 1, 2], 1.5, 2)
    assert abs(t.sum() - 240) < 1e-9 and t[1] == 20 and (t <= [200, 20, 100]).all()


@pytest.mark.parametrize("rows", ["awkward", "table", "empty"])
def test_mix(spark, rows):
    data = {"awkward": awkward(), "empty": []}.get(rows)
    df = frame(spark, data) if data is not None else spark.read.parquet(f"{sf()}/documents.parquet")
    got = mix_sources(df).collect()
    assert len(got) == df.count()
    assert sorted(map(key, got)) == sorted(map(key, mix_sources(df).collect()))
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert 0 <= r.taken <= 2 * r.size
    for own in by.values():
        assert sum(r.size for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 * 64
    if rows == "table":
        want = {i: len(WORD.findall(t or "")) for i, t, _, _ in docs_of(spark)}
        assert {r.doc_id: r.size for r in got} == want
        total = sum(want.values())
        assert abs(sum(r.taken for r in got) - 1.5 * total) < 0.02 * total


def test_mixed_documents(spark):
    df = spark.read.parquet(f"{sf()}/documents.parquet")
    out = mix_documents(df)
    assert out.columns == df.columns
    taken = Counter()
    for r in out.collect():
        taken[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert dict(taken) == {r.doc_id: r.taken for r in mix_sources(df).collect() if r.taken}
    assert mix_documents(frame(spark)).columns == [c.split()[0] for c in COLUMNS.split(", ")]
    assert mix_documents(frame(spark)).count() > 0


@pytest.mark.parametrize("rows", ["awkward", "table"])
def test_mixed_sequence(spark, rows):
    """Slots hold blocks by their permutations; what op1 takes is what the sequence holds."""
    from kairn.llm import mix as M

    data = awkward() + [awkward()[10]] * 5 if rows == "awkward" else None
    df = frame(spark, data) if data else spark.read.parquet(f"{sf('sf0.01')}/documents.parquet")
    mixed, total = mix_shards(df).collect(), Counter()
    assert sorted(mixed) == sorted(mix_shards(df).collect())
    for r in mixed:
        total[r.doc_id, r.source] += r.n
    taken = Counter()
    for r in mix_sources(df).collect():
        taken[r.doc_id, r.source] += r.taken
    assert {k: n for k, n in taken.items() if n} == dict(total)
    slots = defaultdict(int)
    for r in mixed:
        slots[r.shard, r.slot] += r.n
    shards = {s for s, _ in slots}
    assert all(sorted(t for s, t in slots if s == k) == list(range(sum(s == k for s, _ in slots))) for k in shards)
    assert max(slots.values()) <= M.BLOCK and sum(n == M.BLOCK for n in slots.values()) >= len(slots) - 2 * len({r.source for r in mixed})


def test_shards_draw_what_is_due():
    from kairn.llm.mix import SHARD_SLOTS, Shards

    slots = [5 * SHARD_SLOTS, 1234, 0, 3 * SHARD_SLOTS + 77]
    s, before = Shards(slots, 5), np.zeros(4, np.int64)
    for k in range(s.n):
        first, n = s(k)
        assert (first == before).all() and (n >= 0).all() and n.sum() == s.start(k + 1) - s.start(k)
        assert (Shards(slots, 5)(k)[1] == n).all()
        before = before + n
    assert before.tolist() == slots and np.std([s(k)[1][0] for k in range(s.n)]) > 10


def test_repeated_rows_share_evenly(spark):
    rows = [(1, "a b c d e f g " * 30, None, "x", *[None] * 4)] * 7 + [(2, "h i j " * 50, None, "y", *[None] * 4)] * 3
    got = [(r.doc_id, r.taken) for r in mix_sources(frame(spark, rows)).collect()]
    for i, n, size in ((1, 7, 210), (2, 3, 150)):
        own = [t for d, t in got if d == i]
        assert len(own) == n and max(own) - min(own) <= 1 and max(own) <= 2 * size


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for own in groups.values():
        best = min(own)
        out += [(i, best[3], len(own), (n, i) == (best[0], best[3])) for n, _, _, i in own]
    return sorted(out, key=key)


@pytest.mark.parametrize("digits", [32, 1])
def test_exact_dedup(spark, digits):
    from pyspark.sql import functions as F

    weak = lambda c: F.substring(F.md5(c), 1, digits)  # noqa: E731  one digit: most groups collide
    rows = awkward()
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(frame(spark), weak).collect()), key=key)
    assert got == brute_exact(rows)
    assert exact_dedup(frame(spark, [])).count() == 0


def test_license_base(spark):
    rows = awkward() + [(90, "The gnu General public LICENSE, and Apache-License 2. apache license", *[None] * 6)]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = license_scan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = []
    for i, t, *_ in rows:
        words = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, lab) for p, lab in PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        where = [k for k, _ in at]
        want.append((i, len(words), len(at), min(where, default=None), max(where, default=None), ",".join(sorted({x for _, x in at}))))
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_license_fuzzy():
    import regex

    for phrase, label in {**PHRASES, **NOTICES}.items():
        n = Notice(phrase, label)
        for cut in range(0, len(phrase), 3):
            for edited in (phrase[:cut] + phrase[cut + 1 :], phrase[:cut] + "q" + phrase[cut + 1 :]):
                text = f" some words {edited} and more ".encode()
                full = regex.search(rf"(?b)(?<![^ ])(?:{phrase}){{e<={n.k}}}(?![^ ])", text.decode())
                assert bool(n.find(text)) == bool(full if n.k else f" {phrase} " in text.decode()), (phrase, edited)


def test_license_neighbours():
    notice = Notice("apache license", "apache")
    assert notice.find(b" apache licence apache license ") == [(1, 15, 1), (16, 30, 0)]
    assert [e for _, _, e in notice.find(" ápache license apache lizense xapache licensex ".encode())] == [1, 1]
    assert notice.find(b"") == notice.find(b" ") == []


def test_license_edits(spark):
    """Planted notices with one edit are found by the query, at their places; clean neighbours aren't."""
    texts = ["under the apache licence of 2004", "gnu genral public license here", "the mozila public license", "apaches licensed nothing", "mit licence"]
    got = {r.doc_id: r for r in license_scan(frame(spark, [(i, t, *[None] * 6) for i, t in enumerate(texts)])).collect()}
    assert [(got[i].labels, got[i].base_labels, got[i].n_base) for i in range(4)] == [("apache", "", 0), ("gpl", "", 0), ("mpl", "", 0), ("", "", 0)]
    assert [(x.start, x.end, x.edits) for x in got[0].spans] == [(2, 4, 1)] and 0.9 < got[0].score < 1
    assert got[4].labels == "mit"


def test_license_of_very_long_texts(spark):
    texts = ["cc by " * 300_000, "apache licence " * 60_000, "license" * 200_000, " " * 2_000_000, "apache " * 200_000]
    got = {r.doc_id: r for r in license_scan(frame(spark, [(i, t, *[None] * 6) for i, t in enumerate(texts)])).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word) == (300_000, 0, 599_998)
    assert len(got[1].spans) == 60_000 and got[1].labels == "apache" and got[1].n_base == 0
    assert (got[2].labels, got[3].n_words, got[4].labels) == ("", 0, "")


def test_packing_of_very_long_texts(spark):
    vocabulary = Q.vocabulary()
    texts = ["x" + " " * 1_000_000 + "y", "again " * 300_000, "z" * 500_000]
    got = Counter()
    for r in pack(frame(spark, [(i, t, *[None] * 6) for i, t in enumerate(texts)]), **vocabulary).collect():
        got[r.doc_id] += r.length
    slow = tokenizer(vocabulary["path"])
    assert got == {i: len(slow(t)) + 1 for i, t in enumerate(texts)}


def test_packing_ranges():
    rng = np.random.default_rng(8)
    for total in (np.zeros(50, np.int64), np.full(50, 10), rng.integers(0, 30, 50), np.where(np.arange(50) == 20, 1000, 1)):
        first, dealt = ranges(total, 100)
        load = defaultdict(float)
        for b, n in enumerate(total):
            for k in range(dealt[b]):
                load[first[b] + k] += n / dealt[b]
        assert max(load.values()) <= 100 and (np.diff(first) >= 0).all()
        assert len(load) <= 1 + 3 * total.sum() / 100


def brute_quality(text):
    words = WORD.findall(text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for k in range(len(words) - 4):
        at[tuple(words[k : k + 5])].append(k)
    hit = {k + j for own in at.values() if len(own) > 1 for k in own for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def brute_repeats(text, least):
    """(maximal repeats, covered words, covered characters, longest repeat) of `least` words or more."""
    words = WORD.findall(text or "")
    n, found, hidden = len(words), 0, set()
    level = {tuple(words[i : i + least]): [] for i in range(n - least + 1)}
    for i in range(n - least + 1):
        level[tuple(words[i : i + least])].append(i)
    level, size, longest = [v for v in level.values() if len(v) > 1], least, 0
    while level:
        longest, deeper = size, []
        for own in level:
            hidden |= {k + j for k in own for j in range(size)}
            after = defaultdict(list)
            for k in own:
                after[words[k + size] if k + size < n else ("end", k)].append(k)
            before = {words[k - 1] if k else ("start", k) for k in own}
            found += len(before) > 1 and len(after) > 1
            deeper += [v for v in after.values() if len(v) > 1]
        level, size = deeper, size + 1
    return found, len(hidden), sum(len(words[k]) for k in hidden), longest


@pytest.mark.parametrize("table", [False, True])
def test_quality(spark, table):
    rows = awkward()
    rng = np.random.default_rng(6)
    for i in range(60):
        words = [f"w{k}" for k in rng.integers(0, 3 if i % 7 == 0 else 5000, rng.integers(20, 400))]
        for _ in range(rng.integers(0, 3)):
            a, m, b = rng.integers(0, len(words)), rng.integers(8, 60), rng.integers(0, len(words))
            words[b:b] = words[a : a + m]
        rows.append((1000 + i, " ".join(words), *[None] * 6))
    df = spark.read.parquet(f"{sf()}/documents.parquet") if table else frame(spark, rows)
    texts = defaultdict(list)
    for r in df.collect():
        texts[r.doc_id].append(brute_quality(r.text) + brute_repeats(r.text, 10))
    only = 0
    for r in quality_rules(df).collect():
        own = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_repeats, r.covered_words, r.covered_chars, r.longest_repeat)
        assert own in texts[r.doc_id]
        assert r.base_failed == (own[0] < 10 or 100 * own[4] > 20 * own[0])
        bad = own[7] > 0.1 * own[1] or own[8] > 50 and own[8] > 0.05 * own[0]
        assert r.kept == (not r.base_failed and not bad)
        only += bad and not r.base_failed
    assert table or only > 3


def test_quality_of_very_long_texts(spark):
    rng = np.random.default_rng(7)
    plain = [f"w{k}" for k in rng.integers(0, 10**6, 200_000)]
    texts = ["again and " * 200_000, "x" * 2_000_000, " " * 2_000_000, " ".join(plain), " ".join(plain[:60] + plain[:1000])]
    got = {r.doc_id: r for r in quality_rules(frame(spark, [(i, t, *[None] * 6) for i, t in enumerate(texts)])).collect()}
    assert got[0].longest_repeat == 399_998 and got[0].n_repeat_words == 400_000 and not got[0].kept
    assert (got[1].n_words, got[2].n_words, got[3].kept) == (1, 0, True)
    # a passage of 60 words that comes twice: under 20% of the words, over 5% in one repeat
    assert not got[4].base_failed and not got[4].kept and got[4].longest_repeat == 60


def test_suffix_array():
    rng = np.random.default_rng(3)
    for _ in range(30):
        parts = [rng.integers(0, 3, rng.integers(1, 40)) for _ in range(rng.integers(1, 4))]
        symbols = np.concatenate([p + 3 * i for i, p in enumerate(parts)])
        end = np.repeat(np.cumsum([len(p) for p in parts]), [len(p) for p in parts])
        sa, lcp = suffix_array(symbols, end)
        suffixes = [tuple(symbols[i : end[i]]) for i in sa]
        assert suffixes == sorted(suffixes)
        for t in range(1, len(sa)):
            n = 0
            while n < min(len(suffixes[t]), len(suffixes[t - 1])) and suffixes[t][n] == suffixes[t - 1][n]:
                n += 1
            assert lcp[t] == n


def test_hilbert_neighbours():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    order = cells[np.argsort(hilbert_key(cells, 3))]
    assert len(set(hilbert_key(cells, 3))) == 512
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("table", [False, True])
def test_packing_round_trip(spark, table):
    vocabulary = Q.vocabulary()
    df = spark.read.parquet(f"{sf()}/documents.parquet") if table else frame(spark, [*awkward(), (77, "a <|endoftext|> b", *[None] * 6)])
    slow = tokenizer(vocabulary["path"])
    want = Counter()
    got, sequences = defaultdict(list), defaultdict(list)
    for r in pack(df, **vocabulary).collect():
        got[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    texts = defaultdict(list)
    for r in df.collect():
        ids = np.append(slow(r.text or ""), np.uint32(1)).astype("<u4")
        texts[r.doc_id].append(ids)
        want[r.doc_id] += len(ids)
    assert {i: sum(r.length for r in own) for i, own in got.items()} == dict(want)
    for i, own in got.items():
        for r in own:
            assert any(len(ids) == r.doc_tokens and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for ids in texts[i])
    padding = 0
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        n = sum(r.length for r in own)
        assert n <= SEQUENCE
        padding += 0 if n & (n - 1) == 0 else SEQUENCE - n
    assert padding == 0


def test_empty_and_kernels(spark):
    for f in (quality_rules, license_scan, lambda d: pack(d, **Q.vocabulary())):
        assert f(frame(spark, [])).count() == 0
    import pyarrow as pa

    texts = [t for _, t, *_ in awkward()]
    t = K.Texts.of(pa.array(texts))
    starts, ends, at = t.words()
    assert [[bytes(t.data[a:b]).decode() for a, b in zip(starts[x:y], ends[x:y], strict=True)] for x, y in zip(at, at[1:], strict=False)] == [WORD.findall(x or "") for x in texts]
    h, seen = t.spans_hash(starts, ends), {}
    for a, b, x in zip(starts, ends, h, strict=True):
        assert seen.setdefault(bytes(t.data[a:b]), x) == x
    assert len(set(seen.values())) == len(seen)


def test_span_hashes():
    """Equal bytes have equal hashes wherever they stand, different ones don't, short and long."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    parts = [bytes(rng.integers(97, 100, n).astype(np.uint8)).decode() for n in [*range(0, 80), 200, 1000] * 4]
    texts = parts + parts[::-1] + ["a" * n for n in range(70)]
    t = K.Texts.of(pa.array(texts))
    h = t.spans_hash(t.at[:-1], t.at[1:])
    seen = {}
    for x, v in zip(texts, h, strict=True):
        assert seen.setdefault(x, v) == v
    assert len(set(seen.values())) == len(seen)
    assert len(K.Texts.of(pa.array([], pa.string())).spans_hash(np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0
