"""Queries of the training-text operators over the tables of a directory, and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from bitik.llm import cooccurrence, language, leakage, lookalike, packing, quality, sentences
from bitik.session import table

#: Thresholds of a notable pair.
MIN_COUNT, MIN_LIFT = 30, 6.0


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cooccurrence.ordered_pairs(table(spark, sf_dir, "bigrams"))
    return cooccurrence.association(pairs, MIN_COUNT, MIN_LIFT).select("w1", "w2")


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cooccurrence.association(cooccurrence.ordered_pairs(table(spark, sf_dir, "bigrams")))
    return out.select("w1", "w2", "count", F.round("lift", 6).alias("lift"), F.round("pmi", 6).alias("pmi"))


def p1_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that stand together in orders: the pairs of two orders or more."""
    pairs = cooccurrence.basket_pairs(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")
    return cooccurrence.association(pairs, 2).select("w1", "w2", "count", F.round("lift", 6).alias("lift"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.prose_verdicts(table(spark, sf_dir, "uz_crawl")).where("NOT is_prose").select("crawl_id").distinct()


def p2_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.prose_verdicts(table(spark, sf_dir, "uz_crawl"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    crawl = table(spark, sf_dir, "uz_crawl")
    languages = language.document_languages(language.language_segments(crawl))
    return language.wrong_labels(crawl, languages, p2_found(spark, sf_dir))


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_segments(table(spark, sf_dir, "uz_crawl"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "uz_books_v2")).select("book_id", "end_pos").distinct()


def p4_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "uz_books_v2"))


def p5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), replaced=False)
    return found.where("verbatim > 0").select("doc_id", "item_id").distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.look_alike_pairs(table(spark, sf_dir, "documents"))


def p6_reparameterised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and items with a window that differs in numbers, names or units alone."""
    return p6_leaks(spark, sf_dir).where("reparameterised > 0").select("doc_id", "item_id", "reparameterised")


def p7_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.look_alike_classes(table(spark, sf_dir, "documents"))


def p7_caseless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of texts that are the same after full case folding too."""
    return lookalike.look_alike_classes(table(spark, sf_dir, "documents"), casefold=True)


def p7_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.canonical_table(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_pairs, p1_baskets, p2_found, p2_statistics, p3_found, p3_segments, p4_found, p4_sentences, p5_packing, p6_found, p6_leaks, p6_reparameterised, p7_found, p7_classes, p7_caseless, p7_canonical)
}

_PAIRS = """
WITH words AS (
  SELECT row_id, CAST("count" AS BIGINT) AS n,
    translate(lower(regexp_replace(w1, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), '''`´‘’ʻʼʽʿ′', 'ʼʼʼʼʼʼʼʼʼʼ') AS a,
    translate(lower(regexp_replace(w2, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), '''`´‘’ʻʼʽʿ′', 'ʼʼʼʼʼʼʼʼʼʼ') AS b
  FROM bigrams),
valid AS (SELECT row_id, least(a, b) AS w1, greatest(a, b) AS w2, n FROM words WHERE a <> '' AND b <> '' AND n >= 1 AND a <> b),
once AS (SELECT w1, w2, n FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY w1, w2, n) AS r FROM valid) WHERE r = 1 OR row_id IS NULL),
pairs AS (SELECT w1, w2, CAST(sum(n) AS BIGINT) AS c FROM once GROUP BY w1, w2),
margins AS (SELECT w, sum(c) AS n FROM (SELECT w1 AS w, c FROM pairs UNION ALL SELECT w2, c FROM pairs) GROUP BY w),
scored AS (
  SELECT w1, w2, c, CAST(c AS DOUBLE) * (SELECT CAST(sum(c) AS DOUBLE) FROM pairs) / (CAST(a.n AS DOUBLE) * CAST(b.n AS DOUBLE)) AS lift
  FROM pairs JOIN margins a ON a.w = w1 JOIN margins b ON b.w = w2)
"""

_BASKETS = """
WITH items AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS i FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL),
pairs AS (SELECT a.i AS w1, b.i AS w2, count(*) AS c FROM items a JOIN items b ON a.k = b.k AND a.i < b.i GROUP BY 1, 2),
margins AS (SELECT w, sum(c) AS n FROM (SELECT w1 AS w, c FROM pairs UNION ALL SELECT w2, c FROM pairs) GROUP BY w)
SELECT w1, w2, c AS "count", round(CAST(c AS DOUBLE) * (SELECT CAST(sum(c) AS DOUBLE) FROM pairs) / (CAST(a.n AS DOUBLE) * CAST(b.n AS DOUBLE)), 6) AS lift
FROM pairs JOIN margins a ON a.w = w1 JOIN margins b ON b.w = w2 WHERE c >= 2"""

ORACLE_SQL: dict[str, str] = {
    "p1_baskets": _BASKETS,
    "p1_found": _PAIRS + f"SELECT w1, w2 FROM scored WHERE c >= {MIN_COUNT} AND lift >= {MIN_LIFT}",
    "p1_pairs": _PAIRS + 'SELECT w1, w2, c AS "count", round(lift, 6) AS lift, round(log2(lift), 6) AS pmi FROM scored',
}
