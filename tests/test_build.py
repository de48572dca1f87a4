"""Operators that make test material, look-ups on hot keys, numbered rows, SQL functions: brute force on small tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bitik import session
from bitik.functions import registry, text as tx, translit as tr
from bitik.operators import build, correct, lexicon as lx, skew, updates as up


def one(spark, text, change):
    return spark.createDataFrame([(text,)], "text string").select(change(F.col("text"))).first()[0]


def test_aligned_scripts(spark):
    lat = spark.createDataFrame([(1, "Oʻrik va non\nsuv", "x"), (2, "bir\nikki", "x"), (3, None, "x"), (4, "", "x")], "k int, text string, line_no string")
    cyr = spark.createDataFrame([(1, "Ўрик ва нон\nсув бор"), (2, "бир"), (3, "уч"), (5, "беш")], "k int, text string")
    tokens = build.aligned_tokens(build.aligned_lines(lat, cyr, "k"))
    assert sorted(map(tuple, tokens.collect())) == [("ва", "va", 1), ("нон", "non", 1), ("ўрик", "oʻrik", 1)]
    assert tuple(build.agreement(tokens).first()) == (3, 3, 3)
    assert tuple(build.agreement(tokens.limit(0)).first()) == (0, 0, 0)


def test_conversion_of_texts(spark):
    cases = {
        "Toʻgʻri shahar!": "Töğri şahar!", "SHAHAR 5sh https://shahar.uz": "ŞAHAR 5sh https://shahar.uz", "Шаҳар ва iPhone": "Şahar va iPhone", "": "", "日本 sh": "日本 ş",
    }
    rows = spark.createDataFrame([*cases, None], "string").toDF("text").select("text", build.converted(F.col("text"), "new").alias("c")).collect()
    assert {r["text"]: r["c"] for r in rows} == {**cases, None: None}
    assert one(spark, "Toʻgʻri", lambda t: build.converted(t, "cyrillic")) == "Тўғри"
    assert one(spark, "Toʻgʻri", lambda t: build.converted(t, "old")) == "Toʻgʻri"
    assert one(spark, "şahar", lambda t: build.converted(t, "old", "new")) == "shahar"


def test_typing_variants_and_highlighting(spark):
    assert one(spark, "toʻgʻri 'x' a@b.uz oʻ", build.without_apostrophes) == "togri 'x' a@b.uz o"
    assert one(spark, "Shahar SHOX mish-mish", build.bare_sh) == "Sahar SOX mis-mis"
    assert one(spark, "<b> sho'x & olma", lambda t: build.highlighted(t, lambda p: tr.old_to_new(p))) == "&lt;b&gt; <mark>ş</mark><mark>ö</mark>x &amp; olma"


def test_outcomes(spark):
    rows = [
        ("a", "togri gap sok", "töğri gap sok", "töğri gap şok"), ("a", "ozi", "özim", "özi"), ("a", "bir ikki", "bir", "bir ikki"), ("b", "шаҳар", "şahar", "şahar"), ("a", None, None, None), ("a", "", "", ""),
    ]
    got = {r["k"]: tuple(r)[1:] for r in build.outcomes(spark.createDataFrame(rows, "k string, typed string, output string, expected string"), "k").collect()}
    assert got["a"] == (1, 1, 1, 1, 1, 0.5) and got["b"] == (0, 0, 0, 1, 0, None)


def test_sentence_pool(spark):
    good = "Bugun ertalab oʻqituvchi bolalarga yangi kitob berdi"
    text = ". ".join([good, "Qisqa gap", f"«{good}»", good + " " + " ".join(["va"] * 12), good])
    docs = spark.createDataFrame([(1, text, "news"), (2, None, "news"), (3, "", None), (4, "Сегодня утром учитель щедро дал всем детям объёмную книгу", "news")], "doc_id bigint, text string, register string")
    rows = build.sentence_pool(docs).collect()
    assert sorted((r["doc_id"], r["sent"], r["sentence"], r["tokens"]) for r in rows) == [(1, 0, good, 7), (1, 4, good, 7)]


def words(spark, rows):
    return spark.createDataFrame([(w, *c, False) for w, *c in rows], "word string, books bigint, news bigint, telegram bigint, title bigint, lower bigint, protected boolean")


def test_foreign_collisions(spark):
    table = words(spark, [("sock", 0, 40, 0, 40, 0), ("soçk", 90, 1, 1, 0, 92), ("tom", 0, 40, 0, 40, 0), ("şer", 5, 5, 5, 0, 15)])
    lite = table.where("word IN ('soçk', 'şer')")
    assert [tuple(r) for r in build.foreign_collisions(table, lite).collect()] == [("sock", 40, "soçk")]


def test_choice_items(spark):
    table = words(spark, [(w, 10, 0, 0, 0, 10) for w in ("töğri", "şahar", "çiroyli", "sanʼat", "öquvçi", "olma", "togri")])
    items = build.choice_items(table, 10, 1).collect()
    assert len(items) >= 4 and len({r["item_id"] for r in items}) == len(items)
    for r in items:
        right = r["options"][r["answer"]]
        assert right in {"töğri", "şahar", "çiroyli", "sanʼat", "öquvçi"} and len(set(r["options"])) == 4
        assert not set(r["options"]) - {right} & {"olma", "togri"} and (r["shown"] != right or r["category"] == "apostrophe")
    assert build.choice_items(table.limit(0), 10, 1).count() == 0


def test_answers(spark):
    items = spark.createDataFrame([("a", "x", 0), ("b", "x", 1), ("c", "y", 2), ("d", "y", None)], "item_id string, category string, answer int")
    answers = spark.createDataFrame([("a", "Javob: A"), ("b", "bilmayman"), ("c", "c)"), ("d", "D")], "item_id string, answer_text string")
    got = {(r["category"], r["is_total"]): (r["items"], r["correct"]) for r in build.scored_answers(items, answers).collect()}
    assert got == {("x", 0): (2, 1), ("y", 0): (1, 1), (None, 1): (3, 2)}


def test_replies_fit(spark):
    text = "a&b " * 30
    rows = spark.createDataFrame([(1, "olma", "olma", "olma", "олма"), (2, text, text + "ş", text + "sh", text + "ш"), (3, None, None, None, None)], "id int, text string, new string, old string, cyrillic string")
    got = up.replies(rows, "id", 200).orderBy("id", "part").collect()
    assert [(r["id"], r["part"], r["script"]) for r in got] == [(1, 0, None), (2, 0, "new"), (2, 1, "old"), (2, 2, "cyrillic")]
    assert got[0]["body"] == "<b>new</b> already\n\n<b>old</b> already\n\n<b>cyrillic</b>\n<pre>олма</pre>"
    for r in got[1:]:
        assert len(r["body"]) <= 200 and r["body"].endswith("…</pre>") and "&" not in r["body"].replace("&amp;", "")


@pytest.mark.parametrize("share", [1000, 2])
def test_lookup_on_hot_keys(spark, monkeypatch, share):
    monkeypatch.setattr(skew, "HOT_SHARE", share)
    rng = random.Random(5)
    rows = [(n, rng.choice(["va"] * 8 + ["bu", "shu", None, "yoq"])) for n in range(500)]
    df = spark.createDataFrame(rows, "id int, w string")
    values = spark.createDataFrame([("va", 1), ("bu", 2), ("shu", 3)], "key string, v int")
    got = skew.lookup(df, "w", values, skew.hot_keys(df, "w"))
    assert sorted(map(tuple, got.collect())) == sorted((n, w, {"va": 1, "bu": 2, "shu": 3}.get(w)) for n, w in rows)
    assert skew.lookup(df.limit(0), "w", values, skew.hot_keys(df.limit(0), "w")).count() == 0


def test_positions_are_the_places_in_the_order(spark):
    rng = random.Random(6)
    rows = [(rng.choice("aab"), rng.randrange(50), n) for n in range(1000)]
    got = skew.positions(spark.createDataFrame(rows, "w string, c int, n int").repartition(5), "w", F.desc("c"), "n").collect()
    assert [(r["w"], r["c"], r["n"]) for r in sorted(got, key=lambda r: r["pos"])] == sorted(rows, key=lambda r: (r[0], -r[1], r[2]))
    assert sorted(r["pos"] for r in got) == list(range(1000))


def test_successors_and_grid(spark):
    pairs = spark.createDataFrame([("va", "bu", 5), ("va", "u", 9), ("bu", "va", 1)], "w1 string, w2 string, count bigint")
    near = lx.adjacency(pairs)
    assert [(r["pos"], r["w1"], r["w2"]) for r in near.orderBy("pos").collect()] == [(0, "bu", "va"), (1, "va", "u"), (2, "va", "bu")]
    assert sorted(map(tuple, lx.offsets(near).collect())) == [("bu", 0, 1), ("va", 1, 2)]
    table = spark.createDataFrame([("va", 0), ("bu", 1), ("u", 2)], "word string, rank bigint")
    ranked = spark.createDataFrame([(5, 0, 1), (9, 0, 2), (1, 1, 0)], "count bigint, w1_rank bigint, w2_rank bigint")
    grid = {(r["words"], r["pairs"]): (r["bytes"], r["fits"], r["chosen"]) for r in lx.size_grid(table, ranked, [1, 2, 3], [1, 10], 26).collect()}
    assert grid == {(1, 1): (6, True, False), (1, 10): (6, True, False), (2, 1): (18, True, False), (2, 10): (24, True, False), (3, 1): (23, True, True), (3, 10): (35, False, False)}


def test_null_delivery_numbers_all_count(spark):
    rows = [(None, "va", "bu", 2), (None, "va", "bu", 3), (1, "va", "bu", 7), (1, "va", "bu", 7), (2, None, "bu", 1)]
    got = lx.bigram_table(spark.createDataFrame(rows, "row_id bigint, w1 string, w2 string, count bigint")).collect()
    assert [tuple(r) for r in got] == [("va", "bu", 12)]


def test_protected_words_displace_the_tail(spark):
    table = words(spark, [("a" * n, 10 - n, 0, 0, 0, 1) for n in range(2, 6)]).withColumn("protected", F.length("word") == 5)
    assert [r["word"] for r in lx.build(table, 2).orderBy("rank").collect()] == ["aa", "aaaaa"]


def test_sql_functions(spark):
    names = registry.register(spark)
    assert len(names) == len(registry.FUNCTIONS) + 1
    forms = ["to'g'ri", "şeʼr", "тўғри", "Shahar", "S'hox", "a\\b'c", "", None]
    df = spark.createDataFrame([(w,) for w in forms], "w string")
    df.createOrReplaceTempView("forms")
    for name, function in registry.FUNCTIONS.items():
        assert [r[0] for r in spark.sql(f"SELECT bitik_{name}(w) FROM forms").collect()] == [r[0] for r in df.select(function(F.col("w"))).collect()], name
    got = spark.sql("SELECT pos, token FROM bitik_tokens('Olma @x va 5nok https://a.uz toʻgʻri')").collect()
    assert [tuple(r) for r in got] == [(0, "Olma"), (1, "va"), (2, None), (3, "toʻgʻri")]


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    class Conf:
        get = staticmethod(lambda k, d=None: {"spark.master": "spark://host:7077"}.get(k, d))

    class Context:
        applicationId, getConf = "app-1", staticmethod(Conf)

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_folder(Session)


def test_intermediate_tables_are_deleted(spark):
    df = session.materialise(spark.range(3))
    assert df.count() == 3
    session.clean(spark)
    with pytest.raises(Exception, match="(?i)not exist|FILE_NOT_EXIST|PATH_NOT_FOUND"):
        session.materialise(spark.range(3)) and df.count()


def test_seeded_order_is_uniform(spark):
    rows = spark.range(1000).select(build.seeded(7, F.col("id")).alias("h")).collect()
    assert len({r["h"] for r in rows}) == 1000 and 30 < Counter(r["h"][0] for r in rows)["0"] < 100
    assert one(spark, "x", lambda c: build.seeded(1, c)) != one(spark, "x", lambda c: build.seeded(2, c))
    assert one(spark, "ABC-д", tx.russian_layout) == "ABC-д"


def test_empty_tables(spark):
    pairs = spark.createDataFrame([], "w1 string, w2 string, count bigint")
    assert lx.adjacency(pairs).count() == lx.offsets(lx.adjacency(pairs)).count() == 0
    assert lx.merged_bigrams(pairs, spark.createDataFrame([], "word string, admitted boolean, merged_into string")).count() == 0
    lex, scores, suffixes = correct.lexicon(words(spark, [("olma", 1, 1, 1, 0, 1)]).limit(0)), correct.bigram_scores(pairs), spark.createDataFrame([], "suffix string")
    users = spark.createDataFrame([], "user bigint, word string, bonus double")
    texts = spark.createDataFrame([(1, "salom dunyo", 1), (2, None, 1), (3, "", None)], "id int, text string, user bigint")
    for given in (None, users):
        got = correct.autocorrect(texts, lex, scores, suffixes, users=given, morphology="correct").collect()
        assert {r["id"]: r["corrected"] for r in got} == {1: "salom dunyo", 2: None, 3: ""}
    asked = spark.createDataFrame([(1, "sal", None, 5), (2, None, None, None), (3, "", "salom", 5)], "query_id int, buffer string, prev string, user bigint")
    assert correct.suggest(asked, lex, scores, users=users).count() == 0
    assert build.sentence_pool(spark.createDataFrame([], "doc_id bigint, text string, register string")).count() == 0
    assert tuple(build.outcomes(spark.createDataFrame([], "typed string, output string, expected string")).first()) == (0, 0, 0, 0, 0, None)
