"""Worked values of the orthography's column functions."""

import pytest
from pyspark.sql import functions as F

from bitik.functions import text as tx, translit as tr

SKELETON = [
    ("şoşib", {}, "SOSib"), ("shoshib", {}, "SOSib"), ("sosib", {}, "SOSib"), ("șoșib", {}, "SOSib"), ("togri", {}, "tOGri"),
    ("to'g'ri", {}, "tOGri"), ("TOʻGʻRI", {}, "tOGri"), ("wunaqa", {}, "Sunaqa"), ("özbekça", {}, "OzbekCa"), ("yong'oq", {}, "yOnGOq"),
    ("maʼno", {}, "manO"), ("Is'hoq", {}, "iSOq"), ("Işoq", {}, "iSOq"), ("тўғри", {}, "tOGri"), ("цирк", {"recovery": False}, "Sirk"),
    ("цирк", {}, "Sirk Sirq"), ("милиция", {}, "militSiya"), ("шеър", {}, "Ser"), ("объект", {"recovery": False}, "Obyekt"),
    ("бульон", {}, "bOlyOn bulyOn"), ("тугри", {"recovery": False}, "tuGri"), ("тугри", {}, "tOGri tuGri"),
    ("кушик", {}, "kOSik kOSiq kuSik kuSiq qOSik qOSiq quSik quSiq"), ("исхоқ", {}, "iSOq iSxOq"), ("qor", {}, "qOr"),
    ("qor", {"fuzzy_qk": True}, "kOr qOr"), ("xol", {"fuzzy_xh": True}, "hOl xOl"),
]
CYRILLIC = "тўғри=töğri цирк=sirk милиция=militsiya концерт=konsert маъно=maʼno шеър=şeʼr объект=obyekt съезд=syezd бульон=bulyon компьютер=kompyuter ер=yer кел=kel поэзия=poeziya ёзув=yozuv қўшиқ=qöşiq исҳоқ=ishoq"
OLD = "to'g'ri=töğri toʻgʻri=töğri to‘g‘ri=töğri shoshib=şoşib is'hoq=ishoq ma'no=maʼno mo''jiza=möʼjiza bog'=boğ choʻl=çöl yong'oq=yonğoq"
TOKENS = [
    ("'kino'", ["kino"]), ("bog' va tog'", ["bog'", "va", "tog'"]), ("oʻsha-oʻsha", ["oʻsha", "oʻsha"]), ("2026-yil", ["yil"]), ("5ta olma", [None, "olma"]),
    ("mo''jiza", ["mo''jiza"]), ("X₁ va a² soni", [None, "va", None, "soni"]), ("saytga kiring: https://misol.example/a yoki @kanal", ["saytga", "kiring", "yoki"]), ("", []),
]


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


@pytest.mark.parametrize("options", [{}, {"recovery": False}, {"fuzzy_qk": True}, {"fuzzy_xh": True}])
def test_skeleton_keys(spark, options):
    cases = [(w, k.split()) for w, o, k in SKELETON if o == options]
    got = column(spark, [w for w, _ in cases], lambda c: tr.skeleton_keys(c, tx.detect_script(F.lower(c)), **options))
    assert got == [k for _, k in cases]


def test_decomposed_letters_compose(spark):
    assert column(spark, ["şoşib", None], tx.normalize) == ["şoşib", None]


@pytest.mark.parametrize(("pairs", "f"), [(CYRILLIC, tr.cyrillic_to_new), (OLD, tr.old_to_new)])
def test_readings(spark, pairs, f):
    cases = [p.split("=") for p in pairs.split()]
    assert column(spark, [a for a, _ in cases], f) == [b for _, b in cases]


def test_tokens(spark):
    got = column(spark, [t for t, _ in TOKENS], lambda c: tx.tokens_of(tx.blank_protected(c)))
    assert [[None if x == tx.GLUED else x for x in r] for r in got] == [k for _, k in TOKENS]


def test_render_round_trip(spark):
    words = ["töğri", "şeʼr", "özbekça", "ishoq", "yozuv", "obyekt", "boğ", "maʼno", "elçi", "poeziya", "syezd"]
    old = column(spark, words, lambda c: tr.old_to_new(tr.new_to_old(c)))
    cyr = column(spark, words, lambda c: tr.cyrillic_to_new(tr.new_to_cyrillic(c)))
    assert old == words
    assert cyr == words


def test_rule_token(spark):
    got = column(spark, ["TOGGнинг", "15та", "iPhone", "ўзбек", "東京", None], lambda c: tr.rule_token(c, "new"))
    assert got == ["TOGGning", "15ta", "iPhone", "özbek", "東京", None]


def test_case_and_script(spark):
    assert column(spark, ["olma", "Olma", "OLMA", "A", "oLma", "15", None], tx.case_pattern) == ["lower", "title", "upper", "title", "mixed", "lower", None]
    assert column(spark, ["olma", "олма", "oлма", "東京", "", None], tx.detect_script) == ["latin", "cyrillic", "mixed", "mixed", "latin", None]


def test_heldout_is_the_number_modulo_ten(spark):
    import hashlib

    texts = [f"matn {i}" for i in range(200)]
    assert column(spark, texts, tx.heldout) == [int(hashlib.sha1(t.encode()).hexdigest(), 16) % 10 == 0 for t in texts]
