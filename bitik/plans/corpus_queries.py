"""Corpus queries over the whole documents table: tokens, analysis, filter, classes, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bitik.functions import text as tx
from bitik.operators import corpus
from bitik.plans import sql as q
from bitik.session import table

_TOKS = f"WITH {q.tokens()}, {q.analysed()}, full_toks AS (SELECT t.*, f.canon, f.letter_case FROM toks t LEFT JOIN forms f USING (surface))"
_KINDS = "CASE WHEN surface IS NULL OR letter_case = 'mixed' THEN 'protected' WHEN canon IS NULL THEN 'outside' ELSE 'word' END"
_UNI = f"""{_TOKS}, uni AS (SELECT canon AS word,
  CAST(count(*) FILTER (register = 'books') AS BIGINT) AS books, CAST(count(*) FILTER (register = 'news') AS BIGINT) AS news, CAST(count(*) FILTER (register = 'telegram') AS BIGINT) AS telegram,
  CAST(count(*) FILTER (letter_case = 'title') AS BIGINT) AS title, CAST(count(*) FILTER (letter_case = 'lower') AS BIGINT) AS lower
  FROM full_toks WHERE canon IS NOT NULL AND register IS NOT NULL GROUP BY canon)"""
_DOCS = f"""{_TOKS}, per AS (SELECT doc_id, register, count(*) FILTER (k = 'word') AS words, count(*) FILTER (k = 'outside') AS outside,
    count(*) FILTER (k = 'word' AND length(surface) >= 2) AS w2, count(*) FILTER (k = 'outside' AND length(surface) >= 2) AS o2,
    count(*) FILTER (k = 'word' AND surface[1:1] >= 'Ѐ') AS cyr, coalesce(bool_or(k = 'word' AND surface[1:1] >= 'Ѐ' AND regexp_matches(surface, '[ўқғҳЎҚҒҲ]')), false) AS uzcyr,
    coalesce(bool_or(k = 'word' AND surface[1:1] < 'Ѐ' AND regexp_matches(canon, '[öğ]')), false) AS marked
  FROM (SELECT *, {_KINDS} AS k FROM full_toks) GROUP BY doc_id, register),
stats AS (SELECT doc_id, register, words, outside, w2 + o2 > 0 AND coalesce(o2 / nullif(w2 + o2, 0), 1) <= {corpus.MAX_OUTSIDE} AS keep,
    CASE WHEN words < 20 THEN 'short' WHEN 2 * cyr > words THEN CASE WHEN uzcyr THEN 'cyr_uz' ELSE 'cyr_ru_layout' END WHEN marked THEN 'latin_marked' ELSE 'latin_bare' END AS doc_class FROM per)"""


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.tokens(table(spark, sf_dir, "documents"), "doc_id")
    return rows.groupBy("doc_id").agg(F.count("surface").alias("tokens"), F.count_if(F.col("surface").isNull()).alias("glued"))


def segment_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of the corpus by kind of segment: white space, protected runs, other runs."""
    rows = corpus.scan(table(spark, sf_dir, "documents")).select(F.explode(tx.runs(tx.normalize(F.col("text")))).alias("r"))
    kind = F.when(F.col("r").rlike(f"^[{tx.JS_SPACE}]"), "space").when(tx.is_protected_run(F.col("r")), "protected").otherwise("text")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("runs"), F.sum(F.length("r")).alias("characters"))


def token_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct surface form with its script, case, kind and canonical form."""
    forms = corpus.analysed(corpus.surfaces(table(spark, sf_dir, "documents")))
    s = F.col("surface")
    return forms.select("surface", "n", tx.detect_script(F.lower(s)).alias("script"), "letter_case", tx.letter_count(s).cast("bigint").alias("letters"), "kind", "canon")


def case_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = corpus.surfaces(table(spark, sf_dir, "documents"))
    return forms.groupBy(tx.case_pattern(F.col("surface")).alias("letter_case"), tx.detect_script(F.lower(F.col("surface"))).alias("script")).agg(F.count("*").alias("forms"), F.sum("n").alias("tokens"))


def unigrams_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.unigrams(table(spark, sf_dir, "documents"), 2)


def telegram_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: surface forms of word tokens in telegram, seen twice or more."""
    forms = corpus.surfaces(table(spark, sf_dir, "documents").where("register = 'telegram'"))
    return corpus.analysed(forms).where("kind = 'word' AND n >= 2").select("surface", F.col("n").alias("count"))


def document_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.document_stats(table(spark, sf_dir, "documents"))


def source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: documents with a token, dropped ones, words seen and kept, and the characters of all texts, by register, with a total row."""
    docs = table(spark, sf_dir, "documents")
    stats = corpus.document_stats(docs)
    out = stats.rollup("register").agg(
        F.grouping("register").cast("int").alias("is_total"), F.count("*").alias("docs"), F.count_if(~F.col("keep")).alias("dropped"), F.sum("words").alias("words_seen"), F.sum(F.when(F.col("keep"), F.col("words")).otherwise(0)).alias("words_kept")
    )
    size = corpus.scan(docs, "register").rollup("register").agg(F.grouping("register").cast("int").alias("is_total"), F.sum(F.length("text")).alias("characters"))
    same = F.col("a.register").eqNullSafe(F.col("b.register")) & (F.col("a.is_total") == F.col("b.is_total"))
    return out.alias("a").join(size.alias("b"), same).select("a.*", "b.characters")


def doc_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = corpus.document_stats(table(spark, sf_dir, "documents"))
    return stats.where("keep").groupBy("register", "doc_class").agg(F.count("*").alias("docs"), F.sum("words").alias("words"))


def class_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical words of bare Latin and Russian-layout documents with their counts."""
    docs = table(spark, sf_dir, "documents")
    stats = corpus.document_stats(docs).where("keep AND doc_class IN ('latin_bare', 'cyr_ru_layout')").select("doc_id", "doc_class")
    forms = corpus.analysed(corpus.surfaces(docs, "doc_id").join(stats, "doc_id")).where("kind = 'word'")
    return forms.groupBy("doc_class", F.col("canon").alias("word")).agg(F.sum("n").alias("count"))


def neighbour_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word pairs inside sentences, seen twice or more."""
    return corpus.word_pairs(table(spark, sf_dir, "documents"), None, 2)


#: Words of the provisional vocabulary.
VOCABULARY = (1 << 21) - 1


def vocabulary_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of words of the provisional vocabulary."""
    docs = table(spark, sf_dir, "documents")
    return corpus.word_pairs(docs, corpus.vocabulary(docs, VOCABULARY), 2)


def provisional_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.vocabulary(table(spark, sf_dir, "documents"), VOCABULARY)


def vocabulary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word types, hapaxes and tokens."""
    total = F.col("books") + F.col("news") + F.col("telegram")
    return corpus.unigrams(table(spark, sf_dir, "documents")).agg(F.count("*").alias("types"), F.count_if(total == 1).alias("hapaxes"), F.sum(total).alias("tokens"))


def skeleton_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14, the flagship: from text to the index of all words by skeleton."""
    return corpus.skeleton_index(corpus.unigrams(table(spark, sf_dir, "documents"), 2))


def heldout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text falls into the held-out tenth, by register."""
    docs = corpus.scan(table(spark, sf_dir, "documents"), "register")
    return docs.groupBy("register", tx.heldout(F.col("text")).alias("held_out")).agg(F.count("*").alias("docs"))


QUERIES = {
    f.__name__: f
    for f in (token_counts, segment_kinds, token_forms, case_patterns, unigrams_by_source, telegram_surfaces, document_filter, source_report, doc_class, class_unigrams, neighbour_pairs, vocabulary_pairs, provisional_vocabulary, vocabulary_stats, skeleton_index, heldout_split)
}
_PAIRS = """, pairs AS (SELECT canon AS w1, lead(canon) OVER s AS w2 FROM full_toks WINDOW s AS (PARTITION BY doc_id, register, sent ORDER BY pos)),
counted AS (SELECT w1, w2, CAST(count(*) AS BIGINT) AS "count" FROM pairs WHERE w1 IS NOT NULL AND w2 IS NOT NULL GROUP BY w1, w2 HAVING count(*) >= 2)"""
_VOCAB = f", vocab AS (SELECT word, books + news + telegram AS total FROM uni WHERE books + news + telegram >= 2 ORDER BY total DESC, word LIMIT {VOCABULARY})"
ORACLE_SQL = {
    "token_counts": f"{_TOKS} SELECT doc_id, count(surface) AS tokens, count(*) - count(surface) AS glued FROM toks GROUP BY doc_id",
    "segment_kinds": f"WITH {q.tokens()} SELECT CASE WHEN regexp_matches(r, '^[{q.SPACE}]') THEN 'space' WHEN regexp_matches(r, '{q.ANCHOR}') THEN 'protected' ELSE 'text' END AS kind, count(*) AS runs, CAST(sum(length(r)) AS BIGINT) AS characters FROM (SELECT unnest(regexp_extract_all(t, '[{q.SPACE}]+|[^{q.SPACE}]+')) AS r FROM texts) GROUP BY 1",
    "token_forms": f"{_TOKS}, c AS (SELECT surface, count(*) AS n FROM toks WHERE surface IS NOT NULL GROUP BY surface) SELECT surface, n, {q.script('lower(surface)')} AS script, letter_case, length(translate(surface, '{q._APOS}', '')) AS letters, {_KINDS} AS kind, canon FROM c JOIN forms USING (surface)",
    "case_patterns": f"{_TOKS} SELECT letter_case, {q.script('lower(surface)')} AS script, count(DISTINCT surface) AS forms, count(*) AS tokens FROM full_toks WHERE surface IS NOT NULL GROUP BY 1, 2",
    "unigrams_by_source": f"{_UNI} SELECT * FROM uni WHERE books + news + telegram >= 2",
    "telegram_surfaces": f'{_TOKS} SELECT surface, count(*) AS "count" FROM full_toks WHERE register = \'telegram\' AND canon IS NOT NULL GROUP BY surface HAVING count(*) >= 2',
    "document_filter": f"{_DOCS} SELECT * FROM stats",
    "source_report": f"{_DOCS} SELECT register, CAST(grouping(register) AS INT) AS is_total, count(*) AS docs, count(*) FILTER (NOT keep) AS dropped, CAST(sum(words) AS BIGINT) AS words_seen, CAST(coalesce(sum(words) FILTER (keep), 0) AS BIGINT) AS words_kept, (SELECT CAST(sum(length(text)) AS BIGINT) FROM documents d WHERE text <> '' AND (grouping(s.register) = 1 OR d.register IS NOT DISTINCT FROM s.register)) AS characters FROM stats s GROUP BY ROLLUP (register)",
    "doc_class": f"{_DOCS} SELECT register, doc_class, count(*) AS docs, CAST(sum(words) AS BIGINT) AS words FROM stats WHERE keep GROUP BY 1, 2",
    "class_unigrams": f"{_DOCS} SELECT doc_class, canon AS word, count(*) AS \"count\" FROM full_toks JOIN stats USING (doc_id) WHERE keep AND doc_class IN ('latin_bare', 'cyr_ru_layout') AND canon IS NOT NULL GROUP BY 1, 2",
    "neighbour_pairs": f"{_TOKS}{_PAIRS} SELECT * FROM counted",
    "vocabulary_pairs": f"{_UNI}{_PAIRS}{_VOCAB} SELECT * FROM counted WHERE w1 IN (SELECT word FROM vocab) AND w2 IN (SELECT word FROM vocab)",
    "provisional_vocabulary": f"{_UNI}{_VOCAB} SELECT * FROM vocab",
    "vocabulary_stats": f"{_UNI} SELECT count(*) AS types, count(*) FILTER (books + news + telegram = 1) AS hapaxes, CAST(sum(books + news + telegram) AS BIGINT) AS tokens FROM uni",
    "skeleton_index": f"{_UNI} SELECT {q.key('word')} AS skeleton, string_agg(word, ' ' ORDER BY books + news + telegram DESC, word) AS candidates FROM uni WHERE books + news + telegram >= 2 GROUP BY 1",
    "heldout_split": "SELECT register, list_sum(list_transform(range(1, 41), lambda i: (instr('0123456789abcdef', sha1(text)[i:i]) - 1) * CASE WHEN i = 40 THEN 1 ELSE 6 END)) % 10 = 0 AS held_out, count(*) AS docs FROM documents WHERE text <> '' GROUP BY 1, 2",
}
