"""Spelling variants of lexicon words and the reports built on them.

Variants are arrays made inside a row, with stated limits on how many one word may have, as the rules ask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bitik.functions import text as tx, translit as tr
from bitik.functions.alphabet import TUTUQ
from bitik.operators.lexicon import total

DOMINANCE = 10
KEYBOARD_LIMIT, COST_LIMIT = 512, 256


def _options(word: Column, pairs: dict[str, str]) -> Column:
    """For each letter its alternatives."""

    def of(c: Column) -> Column:
        out = None
        for letter, others in pairs.items():
            value = F.array(F.lit(letter), *[F.lit(o) for o in others])
            out = F.when(c == letter, value) if out is None else out.when(c == letter, value)
        return out.otherwise(F.array(c))

    return F.transform(F.split(word, ""), of)


def _product(options: Column, limit: int) -> Column:
    """All spellings; none if they are more than the limit."""
    n = F.aggregate(options, F.lit(1.0), lambda a, o: a * F.size(o))
    return F.when(n <= limit, tr.readings(options)).otherwise(F.array().cast("array<string>"))


def keyboard_variants(word: Column, limit: int = KEYBOARD_LIMIT) -> Column:
    """Spellings with at least one u, k or x replaced by ö, q or h, marks restored or not."""
    spellings = _product(_options(word, {"u": "ö", "k": "q", "x": "h", "o": "ö", "g": "ğ", "s": "ş", "c": "ç"}), limit)
    typed = F.split(word, "")
    changed = lambda v: F.exists(F.arrays_zip(typed.alias("a"), F.split(v, "").alias("b")), lambda z: z["a"].isin("u", "k", "x") & (z["a"] != z["b"]))
    return F.array_sort(F.filter(spellings, changed))


def layout_variants(word: Column, limit: int = COST_LIMIT) -> Column:
    """Other words that a Russian keyboard or an unmarked letter may stand for."""
    spellings = _product(_options(word, {"u": "ö", "o": "ö", "k": "q", "x": "h", "g": "ğ"}), limit)
    return F.array_sort(F.array_remove(F.array_distinct(spellings), word))


def partial_variants(word: Column) -> Column:
    """One mark removed or one bare letter marked."""
    at = F.sequence(F.lit(1), F.length(word))
    change = lambda table: F.transform(at, lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.translate(F.substr(word, i, F.lit(1)), *table), F.substr(word, i + 1)))
    spellings = F.concat(change(("şçöğʼ", "scog")), change(("scog", "şçöğ")))
    return F.array_sort(F.array_remove(F.array_distinct(spellings), word))


def contradicts(reading: Column, candidate: Column, cyrillic: Column) -> Column:
    """Whether the candidate drops a mark that the reading spells out."""
    r, c = F.replace(reading, F.lit(TUTUQ), F.lit("")), F.replace(candidate, F.lit(TUTUQ), F.lit(""))
    pairs = F.arrays_zip(F.split(r, "").alias("a"), F.split(c, "").alias("b"))
    drops = F.exists(pairs, lambda z: (z["a"].rlike("[şçöğ]") & (F.translate(z["a"], "şçöğ", "scog") == z["b"])) | (cyrillic & (z["a"] == "s") & (z["b"] == "ş")))
    fewer = F.length(reading) - F.length(r) > F.length(candidate) - F.length(c)
    return (F.length(r) == F.length(c)) & (drops | fewer)


def stripped_pairs(words: DataFrame) -> DataFrame:
    """(word, source): admitted words that are another one with some marks removed."""
    bare = tx.bare(F.col("word")).alias("bare")
    g = words.select(F.col("word").alias("source"), "skeleton", bare, total().alias("source_total"))
    pairs = words.select("word", "skeleton", bare, total().alias("total")).join(g, ["skeleton", "bare"])
    return pairs.where((F.col("word") != F.col("source")) & F.rlike(F.col("word"), tx.stripped_pattern(F.col("source")))).drop("skeleton", "bare")


def ambiguous(words: DataFrame) -> DataFrame:
    """Skeletons with several admitted words, with the words by falling count."""
    rows = words.select("skeleton", F.struct((-total()).alias("o"), F.col("word").alias("w")).alias("c"))
    lists = rows.groupBy("skeleton").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    return lists.where(F.size("cs") > 1).select("skeleton", F.size("cs").cast("bigint").alias("words"), F.concat_ws(" ", "cs.w").alias("candidates"))


def keyboard_whatif(words: DataFrame, ratios: tuple[float, ...] = (0.01, 0.05, 0.10)) -> DataFrame:
    """Lexicon words that look like a keyboard spelling of a far more frequent one, at several ratios."""
    variants = words.select("word", "books", total().alias("total"), F.explode(keyboard_variants(F.col("word"))).alias("v"))
    best = variants.join(words.select(F.col("word").alias("v"), F.col("books").alias("v_books")), "v").groupBy("word", "books", "total").agg(F.max("v_books").alias("best"))
    grid = F.explode(F.array(*[F.lit(r) for r in ratios])).alias("ratio")
    steps = best.where("best > 0").select("*", grid).where(F.col("books") / F.col("best") < F.col("ratio"))
    return steps.groupBy("ratio").agg(F.count("*").alias("forms"), F.sum("total").alias("mass"))


def spelling_cost(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """Class tokens (doc_class, word, n) that a far more frequent sibling would correct, or that a valid bare word blocks."""
    lex = words.select(F.col("word").alias("v"), total().alias("v_total"))
    latin = tokens.where("doc_class = 'latin_bare'").withColumn("skeleton", tx.skeleton_key(F.col("word")))
    latin = latin.join(words.select("skeleton", F.col("word").alias("v"), total().alias("v_total")), "skeleton").where((F.col("v") != F.col("word")) & F.rlike(F.col("word"), tx.stripped_pattern(F.col("v"))))
    cyr = tokens.where("doc_class = 'cyr_ru_layout'").select("doc_class", "word", "n", F.explode(layout_variants(F.col("word"))).alias("v")).join(lex, "v")
    cols = ["doc_class", "word", "n", "v", "v_total"]
    best = latin.select(*cols).unionByName(cyr.select(*cols)).groupBy("doc_class", "word", "n").agg(F.max("v_total").alias("best"))
    own = best.join(words.select("word", total().alias("own")), "word", "left")
    blocked = F.col("own").isNotNull() & (F.col("best") >= DOMINANCE * F.col("own"))
    return own.groupBy("doc_class").agg(F.sum(F.when(blocked, F.col("n")).otherwise(0)).alias("blocked"), F.sum(F.when(F.col("own").isNull(), F.col("n")).otherwise(0)).alias("corrected"))


def risk_split(surfaces: DataFrame, words: DataFrame, key_limit: int = 3) -> DataFrame:
    """Informal forms (surface, canon, n) outside the lexicon: at risk if a word shares a skeleton, else passed through.

    `hits` are the first few words of the skeleton by falling count.
    """
    unknown = surfaces.join(words.select(F.col("word").alias("canon")), "canon", "left_anti")
    keyed = unknown.select("surface", "canon", "n", F.explode(tr.skeleton_keys(F.col("surface"), tx.detect_script(F.lower("surface")))).alias("skeleton"))
    hits = keyed.join(words.select("skeleton", "word", total().alias("t")), "skeleton", "left").groupBy("surface", "canon", "n")
    ordered = F.slice(F.array_sort(F.collect_set(F.when(F.col("word").isNotNull(), F.struct((-F.col("t")).alias("o"), F.col("word").alias("w"))))), 1, key_limit)
    return hits.agg(ordered.alias("hits")).select("surface", "canon", "n", F.concat_ws(" ", "hits.w").alias("hits"))
