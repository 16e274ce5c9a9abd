"""Format-preserving pseudonyms for personal data, with DataFrame and SQL functions only.

A value that is found and validated (check digits, ranges, calendar) is replaced by another of the
same format under a keyed Feistel permutation. Being a permutation of the format, it maps different
values to different ones; being keyed by nothing but the key and the kind, it maps equal values of
all documents to the same one, so they stay linked. Round functions are keyed hashes of two passes
(HMAC's form). The key is a scalar subquery over a local table: plans, event logs and the user
interface name the subquery, not the key.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import packed

ROUNDS = 8
#: Dates are permuted within the 400 years (from 1, 401, ...) that they are in: days as left x right.
#: The last of these ends with the year 9999.
FIRST_DAY, ERA, LAST_ERA = "DATE'0001-01-01'", (189, 773), (93, 1567)

#: kind -> pattern, tried in this order at each place. Java syntax. Patterns have no groups of their own.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![A-Za-z0-9]|\.[0-9])",
    "day": r"(?<![A-Za-z0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![A-Za-z0-9]|-[0-9])",
    "dotted_day": r"(?<![A-Za-z0-9./])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![A-Za-z0-9]|\.[0-9])",
    "dotted_short": r"(?<![A-Za-z0-9./])[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}(?![A-Za-z0-9]|\.[0-9])",
    "slashed_day": r"(?<![A-Za-z0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![A-Za-z0-9/])",
    "slashed_short": r"(?<![A-Za-z0-9/])[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![A-Za-z0-9/])",
    "day_first": r"(?<![A-Za-z0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![A-Za-z0-9/])",
    "day_first_short": r"(?<![A-Za-z0-9/])[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![A-Za-z0-9/])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9]|-[0-9])",
    "card": r"(?<![A-Za-z0-9])(?<![0-9][.,-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![A-Za-z0-9])",
    "phone": r"(?<![A-Za-z0-9.-])(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9]|[.-][0-9])",
    "intl": r"\+[0-9](?:[ .-]?[0-9]){7,14}(?![A-Za-z0-9])",
    "national": r"(?<![A-Za-z0-9.+-])0[0-9]{2,4}[ -][0-9]{3,4}[ -]?[0-9]{3,4}(?![A-Za-z0-9]|[.-][0-9])",
    "ten_digits": r"(?<![A-Za-z0-9.-])[2-9][0-9]{2}[2-9][0-9]{6}(?![A-Za-z0-9]|[.-][0-9])",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{20,}(?![A-Za-z0-9_-])",
}
ANY = "|".join(f"(?:{p})" for p in dict.fromkeys(PATTERNS.values()))
DATES = {
    "day": "yyyy-MM-dd", "dotted_day": "dd.MM.yyyy", "dotted_short": "d.M.yyyy", "slashed_day": "MM/dd/yyyy",
    "slashed_short": "M/d/yyyy", "day_first": "dd/MM/yyyy", "day_first_short": "d/M/yyyy",
}


def _quoted(s: str) -> str:
    return "r'" + s.replace("'", "\\'") + "'"


def _number(key: str, *parts: str) -> str:
    """SQL for a keyed 48-bit number from the SQL strings in parts; key is a column with the inner and the outer key."""
    inner = f"sha2(concat_ws('|', {key}.inner, {', '.join(parts)}), 256)"
    return f"CAST(conv(substr(sha2(concat_ws('|', {key}.outer, {inner}), 256), 1, 12), 16, 10) AS BIGINT)"


def _hidden(spark: SparkSession, key: str) -> Column:
    """inner and outer, derived from the key, as a struct that a plan shows as a subquery."""
    keys = [hashlib.sha256(f"{part}|{key}".encode()).hexdigest() for part in ("inner", "outer")]
    jvm = spark.sparkContext._jvm
    local = jvm.java.util.ArrayList()
    local.add(" ".join(keys))
    table = DataFrame(spark._jsparkSession.createDataset(local, jvm.org.apache.spark.sql.Encoders.STRING()), spark)
    both = F.split("value", " ")
    return table.select(F.struct(both[0].alias("inner"), both[1].alias("outer"))).scalar()


def _chars(value: str, kind: str, key: str, alphabet: str | None = None) -> str:
    """SQL: the characters of `value` permuted, digits among digits, letters among letters of their case.

    A Feistel network over the two halves: each round moves the characters of one half within their
    class by keyed numbers that depend on the other half. With an alphabet, all characters are of it.
    """
    half = f"(length({value}) div 2)"
    h = _number(key, f"'{kind}'", "i", "a.r", "j")
    if alphabet:
        moved = f"substr('{alphabet}', CAST((locate(c, '{alphabet}') - 1 + {h}) % {len(alphabet)} + 1 AS INT), 1)"
    else:

        def shift(low: int, n: int) -> str:
            return f"chr({low} + (ascii(c) - {low} + {h}) % {n})"

        moved = (
            f"CASE WHEN c BETWEEN '0' AND '9' THEN {shift(48, 10)} WHEN c BETWEEN 'a' AND 'z' THEN {shift(97, 26)} "
            f"WHEN c BETWEEN 'A' AND 'Z' THEN {shift(65, 26)} ELSE c END"
        )
    step = f"named_struct('l', a.r, 'r', array_join(transform(filter(split(a.l, ''), c -> c <> ''), (c, j) -> {moved}), ''))"
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('l', substr({value}, 1, {half}), 'r', substr({value}, {half} + 1)), "
        f"(a, i) -> {step}, a -> concat(a.l, a.r))"
    )


def _pair(left: str, right: str, n: int, m: int, kind: str, key: str, done: str) -> str:
    """SQL: (left, right) of [0, n) x [0, m) permuted; `done` reads a.l and a.r."""
    f1, f2 = _number(key, f"'{kind}'", "i", "a.r"), _number(key, f"'{kind}b'", "i", "b")
    step = f"element_at(transform(array((a.l + {f1}) % {n}), b -> named_struct('l', b, 'r', (a.r + {f2}) % {m})), 1)"
    start = f"named_struct('l', CAST({left} AS BIGINT), 'r', CAST({right} AS BIGINT))"
    return f"aggregate(sequence(1, {ROUNDS // 2}), {start}, (a, i) -> {step}, a -> {done})"


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _refill(value: str, digits: str) -> str:
    """SQL: value with its digits replaced in order by those of `digits`."""
    at = f"length({_digits(f'substr({value}, 1, p)')})"
    return (
        f"element_at(transform(array({digits}), d -> array_join(transform(sequence(1, length({value})), "
        f"p -> IF(substr({value}, p, 1) BETWEEN '0' AND '9', substr(d, {at}, 1), substr({value}, p, 1))), '')), 1)"
    )


def _luhn(digits: str, extra: int) -> str:
    """SQL: Luhn sum modulo 10 of digits, the last of which is followed by `extra` more."""
    return (
        f"aggregate(transform(sequence(1, length({digits})), k -> element_at(transform(array(CAST(substr({digits}, k, 1) AS INT) * "
        f"IF((length({digits}) - k + {extra}) % 2 = 1, 2, 1)), v -> IF(v > 9, v - 9, v)), 1)), 0, (s, v) -> s + v, s -> s % 10)"
    )


def _mod97(text: str) -> str:
    """SQL: the number that letters and digits spell by the IBAN rule, modulo 97."""
    return (
        f"aggregate(filter(split({text}, ''), c -> c <> ''), 0, (s, c) -> "
        "IF(c BETWEEN '0' AND '9', (s * 10 + ascii(c) - 48) % 97, (s * 100 + ascii(c) - 55) % 97))"
    )


def _kind(m: str) -> str:
    """SQL: the kind of a match whose check holds, or null."""
    rules = []
    for kind, pattern in PATTERNS.items():
        is_it = f"{m} RLIKE {_quoted('^(?:' + pattern + ')$')}"
        if kind in DATES:
            is_it += f" AND try_to_date({m}, '{DATES[kind]}') IS NOT NULL"
        elif kind == "ip":
            is_it += f" AND forall(split({m}, '[.]'), o -> CAST(o AS INT) < 256 AND (o = '0' OR o NOT LIKE '0%'))"
        elif kind == "iban":
            flat = f"replace({m}, ' ', '')"
            is_it += f" AND {_mod97(f'concat(substr({flat}, 5), substr({flat}, 1, 4))')} = 1"
        rules.append(f"WHEN {is_it} THEN '{kind}'")
    return f"CASE {' '.join(rules)} END"


def _pseudonym(m: str, kind: str, key: str) -> str:
    """SQL: the pseudonym of a match of a kind; the match itself where the kind is null."""
    d = _digits(m)
    payload = f"substr({d}, 1, length({d}) - 1)"
    card = f"element_at(transform(array({_chars('pay', 'card', key)}), p -> concat(p, CAST((10 - {_luhn('p', 1)}) % 10 AS STRING))), 1)"
    plain = _chars("num", "number", key)
    with_pay = f"element_at(transform(array({payload}), pay -> {card}), 1)"
    with_num = f"element_at(transform(array({d}), num -> {plain}), 1)"
    last_ten = f"element_at(transform(array(right({d}, 10)), num -> concat(substr({d}, 1, length({d}) - 10), {_chars('num', 'phone', key)})), 1)"
    octets = f"split({m}, '[.]')"
    pair = lambda a, b: f"CAST({octets}[{a}] AS INT) * 256 + CAST({octets}[{b}] AS INT)"
    ip = _pair(pair(0, 1), pair(2, 3), 65536, 65536, "ip", key, "concat_ws('.', a.l div 256, a.l % 256, a.r div 256, a.r % 256)")
    rules = []
    for k, form in DATES.items():
        n = f"datediff(try_to_date({m}, '{form}'), {FIRST_DAY})"
        days = ERA[0] * ERA[1]

        def day(era: tuple[int, int], n: str = n, form: str = form, days: int = days) -> str:
            done = f"date_format(date_add({FIRST_DAY}, CAST({n} - {n} % {days} + a.l * {era[1]} + a.r AS INT)), '{form}')"
            return _pair(f"({n} % {days}) div {era[1]}", f"({n} % {days}) % {era[1]}", *era, "day", key, done)

        rules.append(f"WHEN {kind} = '{k}' THEN IF({n} div {days} < 24, {day(ERA)}, {day(LAST_ERA)})")
    flat = f"replace({m}, ' ', '')"
    bban = f"element_at(transform(array(substr({flat}, 5)), num -> {_chars('num', 'iban', key)}), 1)"
    check = _mod97(f"concat(b, substr({flat}, 1, 2), '00')")
    iban = f"element_at(transform(array({bban}), b -> concat(substr({flat}, 1, 2), lpad(CAST(98 - {check} AS STRING), 2, '0'), b)), 1)"
    spaced = f"element_at(transform(array({iban}), d -> array_join(transform(sequence(1, length({m})), p -> IF(substr({m}, p, 1) = ' ', ' ', substr(d, length(replace(substr({m}, 1, p), ' ', '')), 1))), '')), 1)"
    top = f"regexp_extract({m}, '[.][A-Za-z]+$', 0)"
    email = f"element_at(transform(array(substr({m}, 1, length({m}) - length({top}))), num -> concat({_chars('num', 'email', key)}, {top})), 1)"
    secret = f"element_at(transform(array({m}), num -> IF(num RLIKE '^[0-9a-f]+$', {_chars('num', 'hex', key, '0123456789abcdef')}, {_chars('num', 'secret', key)})), 1)"
    rules += [
        f"WHEN {kind} = 'email' THEN {email}",
        f"WHEN {kind} = 'ip' THEN {ip}",
        f"WHEN {kind} = 'iban' THEN {spaced}",
        f"WHEN {kind} = 'card' AND {_luhn(d, 0)} = 0 THEN {_refill(m, with_pay)}",
        f"WHEN {kind} IN ('card', 'ssn') THEN {_refill(m, with_num)}",
        f"WHEN {kind} IN ('phone', 'intl', 'national', 'ten_digits') THEN {_refill(m, last_ten)}",
        f"WHEN {kind} = 'secret' THEN {secret}",
    ]
    return f"CASE {' '.join(rules)} ELSE {m} END"


def pseudonyms(docs: DataFrame, key: str) -> DataFrame:
    """One row per document: the struct `row` of docs' columns, doc_id, the new text, n_values, kinds.

    Replaced are: e-mail addresses, IBANs with right check digits, IPv4 addresses, calendar dates
    (2024-02-29, 29.02.2024, 2/29/2024 and, where that is no date, 29/02/2024; a pseudonym is of the
    same 400 years), numbers of 13 to 19 digits (with right Luhn digits: so is the pseudonym), social
    security and phone numbers (a country code stays; the last ten digits are linked however they are
    written; without separators, ten digits that can be an area code and a number), and mixed tokens
    of 20 characters or more. kinds lists what was found, sorted and distinct. A null text stays null;
    a text without any is unchanged; repeated rows and null ids get a row each. Runs in the JVM in one
    pass over whole texts, without a shuffle.
    """
    may = F.col("text").rlike("[0-9]|@")
    found = packed(docs).select(
        "row", "doc_id", "text", _hidden(docs.sparkSession, key).alias("_key"),
        F.when(may, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.expr("array()").cast("array<string>")).alias("found"),
    )
    kinds = found.withColumn("values", F.expr(f"transform(found, m -> named_struct('m', m, 'k', {_kind('m')}))"))
    new = F.expr(f"transform(values, v -> {_pseudonym('v.m', 'v.k', '_key')})")
    gaps = F.split("text", ANY)
    joined = F.array_join(F.flatten(F.zip_with(gaps, "new", lambda g, n: F.array(g, F.coalesce(n, F.lit(""))))), "")
    out = kinds.withColumn("new", F.when(F.size("values") > 0, new).otherwise(F.expr("array()").cast("array<string>")))
    return out.select(
        "row", "doc_id",
        F.when(F.size("values") > 0, joined).otherwise(F.col("text")).alias("text"),
        F.expr("CAST(size(filter(values, v -> v.k IS NOT NULL)) AS BIGINT)").alias("n_values"),
        F.expr("array_join(array_sort(array_distinct(transform(filter(values, v -> v.k IS NOT NULL), v -> v.k))), ',')").alias("kinds"),
    )
