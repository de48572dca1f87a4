"""The engine over the chat updates, with the lexicon of the delivered counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bitik.functions import text as tx
from bitik.operators import correct, lexicon as lx, updates as up
from bitik.plans import lexicon_queries as lq, sql as q, update_queries as uq
from bitik.session import materialise, table

SIZE = 50_000


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lexicon, bigram scores and suffixes, each written once; the build size bounds the first."""
    admitted = materialise(lq._admitted(spark, sf_dir))
    words = materialise(lx.build(lx.merged_counts(admitted), SIZE))
    bigrams = materialise(correct.bigram_scores(materialise(lx.merged_bigrams(lq.directed_bigrams(spark, sf_dir), admitted))))
    suffixes = materialise(lx.suffix_chains(words.select("word", lx.total().alias("n")), 50, 5, 2))
    return materialise(correct.lexicon(words)), bigrams, suffixes


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return up.once(table(spark, sf_dir, "updates")).where("kind = 'message'").select(F.col("update_id").alias("id"), "text")


def autocorrect(spark, sf_dir):
    """Q1, Q14: every message corrected in new Latin."""
    return correct.autocorrect(messages(spark, sf_dir), *parts(spark, sf_dir))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unfinished last word of every inline query and the word before it."""
    rows = up.once(table(spark, sf_dir, "updates")).where("kind = 'inline_query'")
    word = tx.current_word(tx.blank_protected(tx.normalize(F.coalesce("text", F.lit("")))))
    return rows.select(F.col("update_id").alias("query_id"), word.alias("w"), F.col("from_id").alias("user")).select("query_id", "w.*", "user")


def current_words(spark, sf_dir):
    return asked(spark, sf_dir).drop("user")


def suggest(spark, sf_dir):
    """Suggestions for the last, unfinished word of every inline query."""
    lex, bigrams, _ = parts(spark, sf_dir)
    return correct.suggest(asked(spark, sf_dir).drop("user", "start"), lex, bigrams)


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4: the words every writer has used, with their bonus."""
    return materialise(correct.user_words(uq.user_models(spark, sf_dir)))


def personal_autocorrect(spark, sf_dir):
    """Q1, Q4: every message corrected with its writer's own words, stems corrected as well."""
    texts = up.once(table(spark, sf_dir, "updates")).where("kind = 'message'").select(F.col("update_id").alias("id"), "text", F.col("from_id").alias("user"))
    return correct.autocorrect(texts, *parts(spark, sf_dir), users=_users(spark, sf_dir), morphology="correct")


def personal_suggest(spark, sf_dir):
    """Q2, Q4: suggestions for every inline query with its writer's own words."""
    lex, bigrams, _ = parts(spark, sf_dir)
    return correct.suggest(asked(spark, sf_dir).drop("start"), lex, bigrams, users=_users(spark, sf_dir))


def correction_outcomes(spark, sf_dir):
    """Unigram words stripped to their ASCII form and corrected again: correct, wrong or missed."""
    lex, bigrams, suffixes = parts(spark, sf_dir)
    marked = lex.where(tx.is_marked(F.col("word"))).select(F.monotonically_increasing_id().alias("id"), "word", tx.ascii_form(F.col("word")).alias("text"))
    marked = materialise(marked)
    out = correct.autocorrect(marked.select("id", "text"), lex, bigrams, suffixes).join(marked, "id")
    kind = F.when(F.col("corrected") == F.col("word"), "correct").when(F.col("corrected") == F.col("text"), "missed").otherwise("wrong")
    return out.groupBy(kind.alias("outcome")).agg(F.count("*").alias("words"))


QUERIES = {f.__name__: f for f in (current_words, autocorrect, suggest, personal_autocorrect, personal_suggest, correction_outcomes)}
_ASKED = "(SELECT update_id, text FROM once WHERE kind = 'inline_query')"
ORACLE_SQL: dict[str, str] = {
    "current_words": f"""WITH {uq._ONCE}, {q.tokens(_ASKED, 'update_id')},
      blank AS (SELECT update_id, coalesce(t, '') AS t FROM {_ASKED} LEFT JOIN blanked USING (update_id)), words AS (SELECT update_id, list(surface ORDER BY sent, pos) FILTER (surface IS NOT NULL) AS w FROM toks GROUP BY 1),
      two AS (SELECT update_id, t, w[-1] AS last, w[-2] AS before, coalesce(t <> '' AND suffix(t, w[-1]), false) AS open FROM blank LEFT JOIN words USING (update_id))
      SELECT update_id AS query_id, CASE WHEN open THEN last ELSE '' END AS buffer, CAST(length(t) - CASE WHEN open THEN length(last) ELSE 0 END AS INT) AS start, CASE WHEN open THEN before ELSE last END AS prev FROM two""",
}
