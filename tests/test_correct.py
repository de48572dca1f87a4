"""The engine on a small lexicon with hand-checked texts."""

import pytest
from pyspark.sql import functions as F

from bitik.functions import text as tx
from bitik.operators import correct, evidence as ev

WORDS = """töğri 900 100 50 0 1000|gap 800 100 50 0 900|özbekça 500 60 20 0 500|yozuv 300 10 5 0 300|şoşib 100 10 40 0 100|pişib 100 10 10 0 100|kelasizmi 50 10 60 0 100|oson 300 40 40 0 300
hozir 300 40 40 0 300|kelaman 300 40 40 0 300|rahmat 300 40 40 0 300|sok 5 0 0 0 5|şok 90 9 9 0 90|şer 200 9 9 0 200|şeʼr 300 9 9 0 300|kitob 2000 10 10 0 2000|oquv 50 1 1 0 50|öquv 500 5 5 0 500|osma 70 5 5 0 70|ösma 60 5 5 0 60|ozi 40 1 1 0 40|özi 400 4 4 0 400"""


@pytest.fixture(scope="module")
def parts(spark):
    rows = [(w, *map(int, c)) for w, *c in (r.split() for r in WORDS.replace("\n", "|").split("|"))]
    words = spark.createDataFrame([(w, b, n, t, ti, lo, False) for w, b, n, t, ti, lo in rows], "word string, books bigint, news bigint, telegram bigint, title bigint, lower bigint, protected boolean")
    bigrams = spark.createDataFrame([("töğri", "gap", 50), ("kitob", "ösma", 900)], "w1 string, w2 string, count bigint")
    suffixes = spark.createDataFrame([("lar",), ("larda",), ("xona",)], "suffix string")
    return correct.lexicon(words), correct.bigram_scores(bigrams), suffixes


CASES = {
    "togri gap": "töğri gap", "to'g'ri gap!": "töğri gap!", "TOGRI GAP": "TÖĞRI GAP", "ozbekcha yozuv oson": "özbekça yozuv oson", "хозир келаман, рахмат": "hozir kelaman, rahmat",
    "sosib pisib togri kelasizmi": "şoşib pişib töğri kelasizmi", "kelaslar qisela": "kelaslar qisela", "тугри": "töğri", "sok": "sok", "https://togri.uz @togri 5togri": "https://togri.uz @togri 5togri",
    "sher": "şer", "she'r": "şeʼr", "шеър": "şeʼr", "kitoblarda": "kitoblarda", "": "", "TOGGнинг": "TOGGning",
}


def test_autocorrect(spark, parts):
    texts = spark.createDataFrame([*enumerate(CASES), (99, None)], "id int, text string")
    got = {r["id"]: r["corrected"] for r in correct.autocorrect(texts, *parts).collect()}
    assert got.pop(99) is None
    assert [got[i] for i in range(len(CASES))] == list(CASES.values())


def test_context_decides_between_candidates(spark, parts):
    lex, bigrams, suffixes = parts
    texts = spark.createDataFrame([(1, "kitob osma"), (2, "o'sma"), (3, "kitob. oʻsma")], "id int, text string")
    got = {r["id"]: r["corrected"] for r in correct.autocorrect(texts, lex, bigrams, suffixes).collect()}
    assert got == {1: "kitob osma", 2: "ösma", 3: "kitob. ösma"}  # a valid form is never rewritten


def test_suggest(spark, parts):
    lex, bigrams, _ = parts
    asked = spark.createDataFrame([(1, "tog", None), (2, "g", "togri"), (3, "", "to'g'ri"), (4, "sh", None), (5, "qqq", None), (6, None, None), (7, "тў", None)], "query_id int, buffer string, prev string")
    rows = correct.suggest(asked, lex, bigrams).orderBy("query_id", "rank").collect()
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], []).append((r["word"], r["source"]))
    assert got[1] == [("töğri", "lexicon")]
    assert got[3] == [("gap", "bigram")]
    assert {w for w, _ in got[4]} <= {"şok", "şer", "şeʼr", "şoşib"} and len(got[4]) == 3
    assert got[7][0][0] == "töğri"
    assert 5 not in got and 6 not in got


def test_words_of_the_writer(spark, parts):
    lex, bigrams, suffixes = parts
    users = spark.createDataFrame([(1, "tögri", 1.0), (1, "şaqlat", 2.0), (2, "osma", 5.0)], "user bigint, word string, bonus double")
    texts = spark.createDataFrame([(1, "saqlat", 1), (2, "saqlat", 2), (3, "saqlat", None), (4, "o'sma", 2), (5, "şaqlat", 1)], "id int, text string, user bigint")
    got = {r["id"]: r["corrected"] for r in correct.autocorrect(texts, lex, bigrams, suffixes, users=users).collect()}
    assert got == {1: "şaqlat", 2: "saqlat", 3: "saqlat", 4: "ösma", 5: "şaqlat"}
    asked = spark.createDataFrame([(1, "saq", None, 1), (2, "saq", None, 2), (3, "to", None, 1)], "query_id int, buffer string, prev string, user bigint")
    rows = {}
    for r in correct.suggest(asked, lex, bigrams, users=users).orderBy("query_id", "rank").collect():
        rows.setdefault(r["query_id"], []).append((r["word"], r["source"]))
    assert rows[1] == [("şaqlat", "user")] and 2 not in rows and rows[3][0] == ("töğri", "lexicon") and ("tögri", "user") in rows[3]


def test_options(spark, parts):
    lex, bigrams, suffixes = parts
    fix = lambda text, **o: correct.autocorrect(spark.createDataFrame([(1, text)], "id int, text string"), lex, bigrams, suffixes, **o).first()["corrected"]
    assert fix("тугри") == "töğri" and fix("тугри", recovery=False) == "tugri"
    assert fix("шеър", script="cyrillic") == "шеър" and fix("she'r", script="cyrillic") == "шеър"
    listed = spark.createDataFrame([("şeʼr", "шеър*")], "word string, cyrillic string")
    assert fix("She'r gap", script="cyrillic", exceptions=listed) == "Шеър* гап"
    assert fix("ozbekchalarda") == "ozbekchalarda" and fix("ozbekchalarda", morphology="correct") == "özbekçalarda"
    assert fix("Ozbekchalarda", morphology="correct") == "Ozbekchalarda"  # stems of capitalised tokens stay
    assert fix("kitoblarda", morphology=None) == "kitoblarda"


EVIDENCE = [
    # form, word, sum, least: what is typed shows the letter, leaves it open or speaks against it
    ("sher", "şer", 1, 0), ("ser", "şer", 0, 0), ("sher", "şeʼr", 1, 0), ("she'r", "şeʼr", 2, 0), ("she'r", "şer", 0, -1), ("o'zi", "özi", 1, 0), ("o'zi", "ozi", -1, -1), ("ozi", "özi", 0, 0), ("özi", "ozi", -1, -1),
    ("s'hox", "shox", 1, 0), ("shox", "shox", 0, 0), ("şox", "shox", -1, -1), ("to'g'ri", "töğri", 2, 0), ("шер", "şer", 1, 0), ("сер", "şer", -1, -1), ("ўзи", "özi", 1, 0), ("узи", "özi", 0, 0), ("шеър", "şeʼr", 2, 0), ("шеър", "şer", 0, -1),
]


def test_evidence(spark):
    rows = spark.createDataFrame(EVIDENCE, "low string, word string, sum int, least int").withColumn("cyr", F.col("low").rlike("[а-яў]"))
    rows = rows.select("*", F.explode(ev.readings(F.col("low"), F.col("cyr"))).alias("r"))
    met = rows.where(F.col("r.key") == tx.skeleton_key(F.col("word"))).withColumn("e", ev.evidence(F.col("r.units"), ev.word_units(F.col("word")), F.col("cyr")))
    got = {(r["low"], r["word"]): (r["e"]["sum"], r["e"]["min"]) for r in met.collect()}
    assert got == {(a, b): (s, m) for a, b, s, m in EVIDENCE}
