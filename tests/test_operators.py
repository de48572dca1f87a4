"""Core operators on small tables: nulls, empty tables, repeats, ties, and brute force where no SQL says it."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from bitik.operators import corpus, lexicon as lx, updates as up, variants as vr

DOCS = "doc_id bigint, text string, register string, extra string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, r, "x") for i, (t, r) in enumerate(rows)], DOCS)


def test_empty_and_null_texts(spark):
    none = docs(spark, [(None, "books"), ("", "news"), ("   ", None)])
    assert corpus.tokens(none, "doc_id").count() == 0
    assert corpus.unigrams(none).count() == 0
    assert corpus.word_pairs(none).count() == 0
    empty = spark.createDataFrame([], DOCS)
    assert corpus.document_stats(empty).count() == 0
    assert corpus.skeleton_index(corpus.unigrams(empty)).count() == 0


def test_pairs_break_at_numbers_and_sentences(spark):
    d = docs(spark, [("olma nok. behi 5ta olma nok", "books"), ("Olma NOK", "news")])
    got = {(r["w1"], r["w2"]): r["count"] for r in corpus.word_pairs(d).collect()}
    assert got == {("olma", "nok"): 3}


def test_very_long_text_without_blanks(spark):
    d = docs(spark, [("a" * 300_000 + " olma", "books")])
    assert corpus.tokens(d, "doc_id").count() == 2


def test_admission_rules(spark):
    rows = [("töğri", 900, 0, 0, 0, 900), ("togri", 2, 50, 0, 0, 52), ("kitob", 5, 0, 0, 0, 5), ("faqattg", 0, 9, 9, 0, 18), ("x", 9, 9, 9, 0, 27), ("o", 9, 0, 0, 0, 9), ("öyin", 1, 0, 0, 0, 1), ("we9", 9, 9, 9, 0, 0), (None, 1, 1, 1, 1, 1), (" ", 1, 1, 1, 1, 1)]
    w = lx.word_table(spark.createDataFrame(rows, "word string, books bigint, news bigint, telegram bigint, title bigint, lower bigint"))
    got = {r["word"]: (r["reason"], r["merged_into"]) for r in lx.admission(w).collect()}
    assert got == {
        "töğri": (None, None), "togri": ("stripped-variant-below-ratio", "töğri"), "kitob": (None, None), "faqattg": ("unmarked-not-in-books", None), "x": ("shorter-than-2", None),
        "o": (None, None), "öyin": ("rare", None), "we9": ("not-packable", None),
    }
    merged = {r["word"]: r["news"] for r in lx.merged_counts(lx.admission(w)).collect()}
    assert merged["töğri"] == 50 and "togri" not in merged
    kept = lx.admission(w, spark.createDataFrame([("togri",), ("yangi",)], "word string"))
    assert {r["word"] for r in kept.where("protected AND admitted").collect()} == {"togri", "yangi"}


@pytest.mark.parametrize("cap", [0, 9, 60, 200, 500, 10**9])
def test_size_cutoff_on_every_input(spark, cap):
    rows = [("olma", "nok", n) for n in (1, 2, 3, 3, 7, 150, 199, 200, 250, 250, 9000, 123456)]
    bytes_at = {t: sum(len(a) + len(b) + len(str(n)) + 3 for a, b, n in rows if n >= t) for t in range(3, 123458)}
    expected = min(t for t, size in bytes_at.items() if size <= cap)
    df = spark.createDataFrame(rows, "w1 string, w2 string, count bigint")
    assert tuple(lx.size_cutoff(df, ["w1", "w2"], cap).first()) == (expected, bytes_at[expected])
    assert tuple(lx.size_cutoff(df.limit(0), ["w1", "w2"], cap).first()) == (3, 0)


def brute_limit(times, limit, window):
    out, kept = [], []
    for t in times:
        kept = [x for x in kept if x > t - window]
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(t)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_limiter_is_the_fold(spark, seed):
    rng = random.Random(seed)
    hits, by = [], defaultdict(list)
    for n in range(3000):
        key = rng.choice([1, 1, 1, 2, 3])
        t = rng.choice([rng.randrange(8 * 3_600_000), 3_600_000 + rng.randrange(400_000), 2 * 3_600_000 - rng.randrange(90_000)])
        hits.append((key, t, n))
    for k, t, n in sorted(hits):
        by[k].append((t, n))
    expected = {n: ok for rows in by.values() for (t, n), ok in zip(rows, brute_limit([t for t, _ in rows], 5, 60_000), strict=True)}
    df = spark.createDataFrame(hits, "key bigint, ms bigint, n bigint")
    got = {r["n"]: r["allowed"] for r in up.limited(df, "key", "ms", "n", 5).collect()}
    assert got == expected


def test_decay_is_the_recurrence(spark):
    times = [0, 10**9, 10**9, 3 * 10**9, 9 * 10**9]
    count, last = 0.0, 0
    for t in times:
        count, last = count * 2 ** (-(t - last) / up.HALF_LIFE_MS) + 1, t
    df = spark.createDataFrame([(1, t) for t in times], "k int, ms bigint")
    assert abs(up.decayed(df, ["k"], "ms").first()["count"] - count) < 1e-9


def test_variants(spark):
    row = spark.range(1).select(
        vr.partial_variants(F.lit("öz")).alias("p"), vr.keyboard_variants(F.lit("bulgan")).alias("k"), vr.layout_variants(F.lit("kul")).alias("l"), vr.contradicts(F.lit("şox"), F.lit("sox"), F.lit(False)).alias("c"), vr.contradicts(F.lit("sox"), F.lit("şox"), F.lit(True)).alias("d"), vr.contradicts(F.lit("sox"), F.lit("sox"), F.lit(True)).alias("e"),
    ).first()
    assert row["p"] == ["oz"]
    assert row["k"] == ["bölgan", "bölğan"]
    assert row["l"] == ["köl", "qul", "qöl"]
    assert (row["c"], row["d"], row["e"]) == (True, True, False)


def test_routes(spark):
    e = "array<struct<type:string,offset:int,length:int>>"
    rows = [
        (1, "inline_query", None, 1, False, " salom ", None), (2, "inline_query", None, 1, False, " 12 ", None), (3, "message", "private", 1, True, "a", []), (4, "message", "private", 1, False, None, []),
        (5, "message", "group", 1, False, "olma", []), (6, "message", "group", 1, False, "@Bitik_Bot olma", []), (7, "message", "private", 1, False, "/help", [("bot_command", 0, 5)]), (8, "message", "private", 1, False, "123", None),
        (9, "message", "private", None, False, "olma", None), (10, "message", "channel", 1, False, "olma", None),
    ]
    df = spark.createDataFrame(rows, f"update_id int, kind string, chat_type string, from_id bigint, is_bot boolean, text string, entities {e}")
    got = {r["update_id"]: (r["route"], r["body"]) for r in up.route(df).collect()}
    assert [got[i][0] for i in range(1, 11)] == ["inline", "inline_empty", "ignored", "non_text", "ignored", "text", "command", "no_letters", "ignored", "ignored"]
    assert got[6][1] == "olma" and got[1][1] == "salom"
