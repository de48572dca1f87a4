import hashlib

import pytest
from pyspark.sql import functions as F

from bitik.operators import corpus
from bitik.sources import io


def words(spark):
    return spark.createDataFrame([("olma", 5, 1, 0, 0, 6), ("töğri", 9, 0, 2, 0, 11), ('a"b', 1, 1, 1, 1, 1)], io.UNIGRAMS)


def test_tsv_round_trip(spark, tmp_path):
    io.write_unigrams(words(spark), f"{tmp_path}/u")
    back = io.read_tsv(spark, f"{tmp_path}/u", io.UNIGRAMS)
    assert sorted(back.collect()) == sorted(words(spark).collect())


def test_word_list(spark, tmp_path):
    (tmp_path / "w.txt").write_text("# comment\nolma # apple\n\nto'g'ri\nolma\n", encoding="utf-8")
    assert sorted(r[0] for r in io.read_words(spark, str(tmp_path / "w.txt")).collect()) == ["olma", "töğri"]


def test_items_and_marks(spark, tmp_path):
    (tmp_path / "i.jsonl").write_text('{"item_id": "a", "options": ["x", "y"], "answer": 1}\nbroken\n')
    rows = io.read_items(spark, str(tmp_path / "i.jsonl")).collect()
    assert [(r["item_id"], r["answer"]) for r in rows] == [("a", 1), (None, None)]
    marked = spark.createDataFrame([("a", "dev", "Keep!"), ("b", "dev", "drop"), ("c", "test", None)], "item_id string, split string, mark string")
    io.keep_marked(marked, f"{tmp_path}/kept")
    assert [r["item_id"] for r in spark.read.json(f"{tmp_path}/kept").collect()] == ["a"]


def test_lexicon_tables(spark, tmp_path):
    w = words(spark).where("word NOT LIKE '%\"%'").withColumn("protected", F.lit(False))
    pairs = spark.createDataFrame([("olma", "töğri", 4)], io.BIGRAMS)
    io.write_lexicon(w, pairs, spark.createDataFrame([("lar",)], "suffix string"), str(tmp_path))
    back, b, s = io.read_lexicon(spark, str(tmp_path))
    assert {r["word"]: r["uni_q"] for r in back.collect()}["töğri"] == 255
    assert b.count() == s.count() == 1
    digests = io.files_digest(spark, f"{tmp_path}/words/*.parquet").collect()
    assert all(len(r["sha256"]) == 64 for r in digests)
    io.publish(w, corpus.skeleton_index(w), pairs, f"{tmp_path}/pub", 3)
    assert spark.read.text(f"{tmp_path}/pub/bigrams").count() == 2


def test_report_and_upsert(spark):
    board = spark.createDataFrame([("a", 1), ("b", 2)], "name string, score int")
    new = spark.createDataFrame([("b", 3)], "name string, score int")
    assert sorted(map(tuple, io.upsert(board, new, "name").collect())) == [("a", 1), ("b", 3)]
    assert io.markdown(new) == "| name | score |\n| --- | --- |\n| b | 3 |"


def test_a_broken_lexicon_is_refused(spark, tmp_path):
    w = words(spark).withColumn("protected", F.lit(False))  # one word has a quotation mark
    pairs, suffixes = spark.createDataFrame([("olma", "töğri", 4)], io.BIGRAMS), spark.createDataFrame([("lar",)], "suffix string")
    io.write_lexicon(w, pairs, suffixes, str(tmp_path))
    with pytest.raises(ValueError, match="letters"):
        io.read_lexicon(spark, str(tmp_path))
    spark.createDataFrame([("lar",)], "other string").write.mode("overwrite").parquet(f"{tmp_path}/suffixes")
    with pytest.raises(ValueError, match="suffix"):
        io.read_lexicon(spark, str(tmp_path))


def test_verified_files_and_budget(spark, tmp_path):
    for name, content in (("a", b"1"), ("b", b"22"), ("c", b"3"), ("d", b"4")):
        (tmp_path / name).write_bytes(content)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    listed = spark.createDataFrame([("a", 1, sha(b"1").upper()), ("b", 1, sha(b"2")), ("c", 1, sha(b"9")), ("e", 1, sha(b"5"))], "name string, length bigint, sha256 string")
    assert dict(map(tuple, io.verified(spark, f"{tmp_path}/*", listed).collect())) == {"a": "ok", "b": "wrong size", "c": "wrong content", "d": "unlisted", "e": "missing"}
    assert io.folder_bytes(spark, str(tmp_path), 5) == 5
    with pytest.raises(ValueError):
        io.folder_bytes(spark, str(tmp_path), 4)


def test_users_as_json(spark):
    model = spark.createDataFrame([(1, "olma", 2.5, 10), (1, "nok", 1.0, 11), (2, "behi", 1.0, 3)], "from_id bigint, word string, count double, last_ms bigint")
    texts = io.export_users(model).unionByName(spark.createDataFrame([(3, "broken"), (4, None), (5, '{"format": "other"}')], "from_id bigint, json string"))
    assert sorted(map(tuple, io.import_users(texts).collect())) == sorted(map(tuple, model.collect()))


def test_a_cut_report_says_so(spark):
    assert io.markdown(spark.range(5), 2).endswith("3 more rows are left out.")
