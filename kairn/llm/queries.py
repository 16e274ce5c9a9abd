"""Queries over the test tables that apply the corpus operators to whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_components
from .langid import language_id
from .license_scan import license_scan
from .line_dedup import line_dedup
from .mix import mix_sources
from .packing import pack
from .pii import pseudonyms
from .quality import quality_rules
from .substring_dedup import substring_dedup


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_docs(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_docs(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_docs(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_docs(spark, sf_dir))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_docs(spark, sf_dir)).drop("spans")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_docs(spark, sf_dir))


#: The queries' key. A real run passes a secret.
TEST_KEY = "not a secret"


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms(_docs(spark, sf_dir), TEST_KEY).drop("row")


def vocabulary() -> dict[str, str]:
    """Where the public vocabulary lies on this machine; the files are read, never copied."""
    import public_tokenizers as P

    return {"path": P.path("byte_bpe_50k.json"), "ranks_path": P.path("byte_bpe_50k.tiktoken"), "pattern": P.PATTERN}


def op8_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_docs(spark, sf_dir), **vocabulary())


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_docs(spark, sf_dir)).drop("kept_text")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_docs(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_line_dedup, op3_exact_dedup, op4_language_id, op5_license_scan, op6_jaccard_join, op7_pseudonyms, op8_curve_packing, op9_substring_dedup, op10_quality_rules)}


#: Text without white space, as DuckDB reads it.
_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

_WORDS = r"[^\x20\x09-\x0D]+"

ORACLE_SQL: dict[str, str] = {
    "op6_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
              ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
        SELECT r.a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY 1""",
    "op9_substring_dedup": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
        v AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d),
        x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM v),
        o AS (SELECT h, min(doc_id) AS o FROM x GROUP BY 1),
        c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM x JOIN o USING (h) WHERE o < doc_id),
        p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t, count(*) AS n FROM p ANTI JOIN c USING (doc_id, k) GROUP BY 1)
        SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op3_exact_dedup": f"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, {_NORM} AS norm FROM documents),
        g AS (SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
                     first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g""",
}
