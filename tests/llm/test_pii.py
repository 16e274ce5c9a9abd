"""Pseudonyms: formats, checks, links, and the round trip through the inverse permutation."""

import datetime
import hashlib
import random
import re

from kairn.llm.pii import ROUNDS, pseudonyms

from .cases import frame, sf


def digest(*parts):
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def number(key, *parts):
    return int(digest(digest("outer", key), digest(digest("inner", key), *parts))[:12], 16)


def undo(value, kind, key):
    """The inverse of the character network."""
    half = len(value) // 2
    left, right = value[:half], value[half:]
    for i in range(ROUNDS, 0, -1):
        right, left = left, right
        out = ""
        for j, c in enumerate(left):
            low, n = (48, 10) if c.isdigit() else (97, 26) if c.islower() else (65, 26)
            out += chr(low + (ord(c) - low - number(key, kind, i, right, j)) % n) if c.isascii() and c.isalnum() else c
        left, right = right, out
        left, right = right, left
    return left + right


def luhn(d):
    return sum(sum(divmod(int(c) * (2 if k % 2 else 1), 10)) for k, c in enumerate(reversed(d))) % 10


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in sorted(pseudonyms(df, "k").collect(), key=lambda r: r.doc_id)]


def test_cards(spark):
    rng = random.Random(1)
    cards = []
    for n in range(13, 20):
        for _ in range(6):
            d = "".join(rng.choice("0123456789") for _ in range(n - 1))
            cards.append(d + str((10 - luhn(d + "0")) % 10))
    out = [r.text for r in run(spark, [f"a {c} b" for c in cards])]
    new = [t[2:-2] for t in out]
    assert len(set(new)) == len(set(cards)) and not set(new) & set(cards)
    for c, n in zip(cards, new, strict=True):
        assert len(c) == len(n) and luhn(n) == 0
        # split at the halves' lengths after an even number of rounds
        assert undo(n[:-1], "card", "k") == c[:-1]


def test_formats(spark):
    texts = [
        "4785 3805 9239 1139", "4785380592391139", "+1 (017) 555-7713", "0175557713 is 017-555-7713", "10.0.0.1 10.0.0.1 300.1.1.1",
        "1980-02-29 29.02.1980 02/29/1980 1981-02-29", "DE89370400440532013000 DE89 3704 0044 0532 0130 00 NL91ABNA0417164301",
        "a.b@c.org, a.b@c.org", "clean text 12 345", "",
    ]
    r = run(spark, texts)
    assert r[0].text.replace(" ", "") == r[1].text and re.fullmatch(r"(\d{4} ){3}\d{4}", r[0].text)
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", r[2].text) and r[2].text[-4:] == r[3].text[-4:] and r[2].kinds == "phone"
    a, b, c = r[4].text.split()
    assert a == b != "10.0.0.1" and c == "300.1.1.1" and all(0 <= int(x) < 256 for x in a.split("."))
    days = r[5].text.split()
    day = datetime.date.fromisoformat(days[0])
    assert days[1] == day.strftime("%d.%m.%Y") and days[2] == day.strftime("%m/%d/%Y") and days[3] == "1981-02-29"
    assert 1601 <= day.year <= 2000
    iban, bad = r[6].text.split()[0], r[6].text.split()[-1]
    assert int("".join(str(int(x, 36)) for x in iban[4:] + iban[:4])) % 97 == 1 and bad == "NL91ABNA0417164301"
    assert r[7].text.split(", ")[0] == r[7].text.split(", ")[1] != "a.b@c.org"
    assert (r[8].text, r[8].n_values, r[9].text) == (texts[8], 0, "")


def test_dates_are_permuted(spark):
    days = [datetime.date(1990, 1, 1) + datetime.timedelta(i) for i in range(2000)]
    new = " ".join(r.text for r in run(spark, [" ".join(map(str, days[i::10])) for i in range(10)])).split()
    assert len(set(new)) == len(days)
    assert all(datetime.date.fromisoformat(d) for d in new)


def test_dates_of_all_years(spark):
    """Each era's dates are permuted among themselves, the first and the last included."""
    first, rng = datetime.date(1, 1, 1), random.Random(4)
    for low, high in ((1, 400), (1601, 2000), (2001, 2400), (9601, 9999)):
        a, b = datetime.date(low, 1, 1), datetime.date(high, 12, 31)
        days = {a, b} | {a + datetime.timedelta(rng.randrange((b - a).days)) for _ in range(300)}
        days = sorted(days)
        new = " ".join(r.text for r in run(spark, [" ".join(d.isoformat() for d in days)])).split()
        assert len(set(new)) == len(days) and all(low <= datetime.date.fromisoformat(d).year <= high for d in new)
    assert first.isoformat() == "0001-01-01"


def test_more_formats(spark):
    r = run(spark, ["25/12/1990 12/25/1990", "1/2/1990 and 3.4.2001", "32/13/1990 13/13/1990", "020 7946 0958 or +44 20 7946 0958", "call 6175557713 now", "id 1234567890"])
    a, b = r[0].text.split()
    day = datetime.datetime.strptime(b, "%m/%d/%Y")
    assert a == day.strftime("%d/%m/%Y") and r[0].kinds == "day_first,slashed_day"
    one, two = r[1].text.split(" and ")
    assert re.fullmatch(r"\d{1,2}/\d{1,2}/\d{4}", one) and re.fullmatch(r"\d{1,2}\.\d{1,2}\.\d{4}", two) and (one, two) != ("1/2/1990", "3.4.2001")
    assert r[2].text == "32/13/1990 13/13/1990" and r[5].text == "id 1234567890"
    a, b = r[3].text.split(" or ")
    assert re.fullmatch(r"0\d\d \d{4} \d{4}", a) and b == "+44 " + a[1:] and a != "020 7946 0958"
    assert re.fullmatch(r"call \d{10} now", r[4].text) and "6175557713" not in r[4].text


def test_values_stay_different(spark):
    """Many values of each kind have as many pseudonyms, of their format."""
    rng, made = random.Random(6), {}
    made["email"] = [f"u{k}@mail{k % 7}.org" for k in range(500)]
    made["ip"] = [f"10.{k % 256}.{k // 256}.{k % 200}" for k in range(500)]
    made["ssn"] = [f"{100 + k // 50:03d}-{10 + k % 50:02d}-{rng.randrange(10000):04d}" for k in range(500)]
    made["phone"] = [f"(617) {200 + k // 100:03d}-{5000 + k % 100:04d}" for k in range(500)]
    made["secret"] = [f"sk_{rng.randrange(16**30):030x}a1" for _ in range(500)]
    made["iban"] = []
    for k in range(300):
        bban = f"37040044{k:010d}"
        check = 98 - int("".join(str(int(c, 36)) for c in bban + "DE00")) % 97
        made["iban"].append(f"DE{check:02d}{bban}")
    for kind, values in made.items():
        (r,) = run(spark, ["\n".join(values)])
        new = r.text.split("\n")
        assert r.kinds == kind and len(set(new)) == len(set(values)) and not set(new) & set(values), kind
        assert all(len(a) == len(b) or kind == "ip" for a, b in zip(values, new, strict=True))
        if kind == "iban":
            assert all(int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1 for v in new)


def test_the_plan_hides_the_key(spark):
    df = spark.read.parquet(f"{sf()}/documents.parquet")
    out = pseudonyms(df, "top secret key")
    shown = out._jdf.queryExecution().toString()
    for part in ("inner", "outer"):
        assert hashlib.sha256(f"{part}|top secret key".encode()).hexdigest() not in shown
    assert "top secret key" not in shown and "Python" not in shown and "Arrow" not in shown


def test_table_and_awkward(spark):
    df = spark.read.parquet(f"{sf('sf0.01')}/documents.parquet")
    value = re.compile(r"\S+@\S+\.com|(?<!\S)\d{16}(?!\S)|\b[0-9a-f]{40}\b|(?<!\S)\d+\.\d+\.\d+\.\d+(?!\S)|\+1 \(\d{3}\) \d{3}-\d{4}")
    old = {r.doc_id: r.text for r in df.collect()}
    hits = 0
    for r in pseudonyms(df, "k").collect():
        for v in value.findall(old[r.doc_id]):
            hits += 1
            assert v not in r.text, (r.doc_id, v)
        if not re.search(r"[\d@]", old[r.doc_id]):
            assert r.text == old[r.doc_id] and r.n_values == 0
    assert hits > 50
    odd = frame(spark)
    assert pseudonyms(odd, "k'").count() == odd.count() and pseudonyms(frame(spark, []), "k").count() == 0
