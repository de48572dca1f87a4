"""From documents to counts: tokens, their analysis, document filter and class, unigrams and word pairs.

Columns of a corpus: doc_id, text, register (books, news or telegram; any other value counts in no register).
Null and empty texts have no tokens. No operator gathers a document's or a word's rows into one list other
than the tokens of one sentence, and counts are combined before each shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bitik.functions import text as tx, translit as tr
from bitik.functions.alphabet import TUTUQ
from bitik.session import spread

REGISTERS = ("books", "news", "telegram")
#: Largest share of tokens outside the alphabet in a document that is kept.
MAX_OUTSIDE = 0.05
MIN_TOKENS_FOR_CLASS = 20
# The letters of the Uzbek alphabets.
UZ_CYRILLIC = "абвгдеёжзийклмнопрстуфхцчшъьэюяўқғҳ"
UZ_LATIN = "abdefghijklmnopqrstuvxyzşçöğʼ"


def scan(docs: DataFrame, *keep: str) -> DataFrame:
    """The text column and the wanted keys, without null and empty texts."""
    return docs.select(*keep, "text").where("text <> ''")


def sentences(docs: DataFrame, *keep: str) -> DataFrame:
    """One row a sentence with its tokens in order; glued tokens are markers. Addresses are blanked."""
    # outer generators: the optimiser would put a size test, and with it the whole expression, below an inner one
    chunks = F.posexplode_outer(F.split(tx.blank_protected(tx.normalize(F.col("text"))), r"[.!?…\n]+")).alias("sent", "chunk")
    rows = spread(scan(docs, *keep)).select(*keep, chunks)
    return rows.select(*keep, "sent", tx.tokens_of(F.col("chunk")).alias("items"))


def tokens(docs: DataFrame, *keep: str) -> DataFrame:
    """One row a token: keys, sent, pos, surface; the surface of a glued token is null."""
    rows = sentences(docs, *keep).select(*keep, "sent", F.posexplode_outer("items").alias("pos", "item")).where("pos IS NOT NULL")
    return rows.select(*keep, "sent", "pos", F.nullif(F.col("item"), F.lit(tx.GLUED)).alias("surface"))


def with_canon(rows: DataFrame, surface: str = "surface", canon: str = "canon", letter_case: str = "letter_case") -> DataFrame:
    """`rows` with the letter case of a token column and its canonical new-Latin form.

    The form is null for tokens outside the alphabet or of mixed case. Each step is a column of its own, so
    that no rule is evaluated twice and the generated code stays small.
    """
    c = F.col
    out = rows.withColumn("_low", F.lower(c(surface))).withColumn("_letters", tx.letters_of(c(surface)))
    out = out.withColumn(letter_case, tx.case_of_letters(c("_letters"))).withColumn("_script", tx.script_of_letters(F.lower("_letters")))
    plain = c(letter_case) != "mixed"
    cyrillic = plain & (c("_script") == "cyrillic") & ~c("_low").rlike(f"[^{UZ_CYRILLIC}'`´‘’ʻʼʽʿ′]")
    out = out.withColumn("_read", F.when(cyrillic, tr.cyrillic_to_new(c("_low"))).when(plain & (c("_script") == "latin"), tr.old_to_new(c("_low"))))
    out = out.withColumn("_read", F.ltrim("_read", F.lit(TUTUQ)))
    # the partition id, which is never negative, keeps filters on the result from being pushed below this
    # step, where they would repeat every rule above once for each use
    inside = (c("_read") != "") & ~c("_read").rlike(f"[^{UZ_LATIN}]") & (F.spark_partition_id() >= 0)
    return out.withColumn(canon, F.when(inside, c("_read"))).drop("_low", "_letters", "_script", "_read")


def analysed(rows: DataFrame) -> DataFrame:
    """`rows` with kind (word, outside or protected), canon and letter_case of the column surface."""
    kind = F.when(F.col("surface").isNull() | (F.col("letter_case") == "mixed"), "protected").when(F.col("canon").isNull(), "outside").otherwise("word")
    return with_canon(rows).withColumn("kind", kind)


def document_stats(docs: DataFrame, max_outside: float = MAX_OUTSIDE) -> DataFrame:
    """doc_id, register, words, outside, keep, doc_class of every document with a token.

    keep: at most `max_outside` of its tokens of two letters or more lie outside the alphabet.
    doc_class: short, latin_marked, latin_bare, cyr_uz or cyr_ru_layout by its word tokens.
    """
    forms = tokens(docs, "doc_id", "register").groupBy("doc_id", "register", "surface").agg(F.count("*").alias("n"))
    seen = analysed(forms)
    word, long_ = F.col("kind") == "word", F.length("surface") >= 2
    cyrillic = word & F.col("surface").rlike(r"^[\x{0400}-\x{10ffff}]")
    per = seen.groupBy("doc_id", "register").agg(
        F.sum(F.when(word, F.col("n")).otherwise(0)).alias("words"),
        F.sum(F.when(F.col("kind") == "outside", F.col("n")).otherwise(0)).alias("outside"),
        F.sum(F.when(word & long_, F.col("n")).otherwise(0)).alias("words2"),
        F.sum(F.when((F.col("kind") == "outside") & long_, F.col("n")).otherwise(0)).alias("outside2"),
        F.sum(F.when(cyrillic, F.col("n")).otherwise(0)).alias("cyr"),
        F.coalesce(F.max(cyrillic & F.col("surface").rlike("[ўқғҳЎҚҒҲ]")), F.lit(False)).alias("uzcyr"),
        F.coalesce(F.max(word & ~F.col("surface").rlike(r"^[\x{0400}-\x{10ffff}]") & F.col("canon").rlike("[öğ]")), F.lit(False)).alias("marked"),
    )
    total = F.col("words2") + F.col("outside2")
    kind = (
        F.when(F.col("words") < MIN_TOKENS_FOR_CLASS, "short")
        .when(2 * F.col("cyr") > F.col("words"), F.when(F.col("uzcyr"), "cyr_uz").otherwise("cyr_ru_layout"))
        .otherwise(F.when(F.col("marked"), "latin_marked").otherwise("latin_bare"))
    )
    keep = (total > 0) & (F.col("outside2") / total <= max_outside)
    return per.select("doc_id", "register", "words", "outside", F.coalesce(keep, F.lit(False)).alias("keep"), kind.alias("doc_class"))


def surfaces(docs: DataFrame, *keep: str) -> DataFrame:
    """Distinct surface forms by the given keys with their counts: the table every count below starts from."""
    return tokens(docs, *keep).where(F.col("surface").isNotNull()).groupBy(*keep, "surface").agg(F.count("*").alias("n"))


def unigrams(docs: DataFrame, min_count: int = 1) -> DataFrame:
    """A1, A2, F2: word with its counts by register and by letter case, of the words seen `min_count` times."""
    rows = analysed(surfaces(docs, "register").where("register IS NOT NULL")).select("register", "letter_case", "canon", "n")
    n = F.col("n")
    by = [F.sum(F.when(F.col("register") == r, n).otherwise(0)).alias(r) for r in REGISTERS]
    cases = [F.sum(F.when(F.col("letter_case") == c, n).otherwise(0)).alias(c) for c in ("title", "lower")]
    # tested on an aggregate: a test of the word itself would be pushed down and analyse every form twice
    out = rows.groupBy(F.col("canon").alias("word")).agg(*by, *cases, F.count("canon").alias("forms"))
    return out.where((F.col("forms") > 0) & (F.col("books") + F.col("news") + F.col("telegram") >= min_count)).drop("forms")


def word_pairs(docs: DataFrame, vocabulary: DataFrame | None = None, min_count: int = 1) -> DataFrame:
    """w1, w2, count of neighbouring words inside a sentence.

    A chain breaks at a token that is no word. Neighbours are taken inside the sentence's own array and
    counted as typed, so that only distinct typed pairs are analysed. With a `vocabulary` (column word),
    pairs with another word fall out.
    """
    items = F.col("items")
    near = F.transform(F.sequence(F.lit(1), F.size(items) - 1), lambda i: F.struct(F.get(items, i - 1).alias("a"), F.get(items, i).alias("b")))
    typed = sentences(docs).select(F.explode_outer(F.when(F.size(items) > 1, near)).alias("p")).groupBy("p.a", "p.b").agg(F.count("p.a").alias("n"))
    typed = typed.where((F.col("n") > 0) & (F.col("a") != tx.GLUED) & (F.col("b") != tx.GLUED))
    named = with_canon(with_canon(typed, "a", "w1", "_case1"), "b", "w2", "_case2").select("w1", "w2", "n")
    counts = named.groupBy("w1", "w2").agg(F.sum("n").alias("count"), F.count("w1").alias("k1"), F.count("w2").alias("k2")).where("k1 > 0 AND k2 > 0")
    if vocabulary is not None:
        for side in ("w1", "w2"):
            counts = counts.join(vocabulary.select(F.col("word").alias(side)), side, "left_semi")
    return counts.select("w1", "w2", "count").where(F.col("count") >= min_count)


def vocabulary(docs: DataFrame, size: int, min_count: int = 2) -> DataFrame:
    """The most frequent words, by total and then by word."""
    counts = unigrams(docs, min_count).select("word", (F.col("books") + F.col("news") + F.col("telegram")).alias("total"))
    return counts.orderBy(F.desc("total"), "word").limit(size)


def skeleton_index(words: DataFrame) -> DataFrame:
    """Skeleton, candidates by falling count and then by word. At most a handful of words share a skeleton."""
    total = F.col("books") + F.col("news") + F.col("telegram")
    rows = words.select(tx.skeleton_key(F.col("word")).alias("skeleton"), F.struct((-total).alias("o"), F.col("word").alias("w")).alias("c"))
    lists = rows.groupBy("skeleton").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    return lists.select("skeleton", F.concat_ws(" ", "cs.w").alias("candidates"))
