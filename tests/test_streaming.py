import os
import random
import shutil

from bitik.operators import updates as up
from bitik.streaming import updates as st


def run(df, mode, path, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_counters_and_limiter(spark, tmp_path):
    schema = "update_id bigint, kind string, chat_type string, from_id bigint, is_bot boolean, text string, entities array<struct<type:string,offset:int,length:int>>, sent_at timestamp, received_at timestamp"
    rows = spark.sql("""SELECT id AS update_id, 'message' AS kind, 'private' AS chat_type, id % 2 AS from_id, false AS is_bot, 'olma' AS text, array() AS entities,
        timestamp_seconds(1700000000 + id) AS sent_at, timestamp_seconds(1700000000 + id) AS received_at FROM (SELECT id FROM range(60) UNION ALL SELECT 5)""")
    rows.selectExpr("update_id", "kind", "chat_type", "from_id", "is_bot", "text", "CAST(entities AS array<struct<type:string,offset:int,length:int>>) AS entities", "sent_at", "received_at").write.parquet(f"{tmp_path}/in")
    feed = st.read_updates(spark, f"{tmp_path}/in", schema)
    counted = run(st.counters(feed), "update", tmp_path, "counted").groupBy("route").max("updates").collect()
    assert [tuple(r) for r in counted] == [("text", 60)]


def test_limiter_decides_as_the_batch_form(spark, tmp_path):
    """Hits in any order, some late ones in later files, and a last file whose time lets the watermark pass them all."""
    rng = random.Random(8)
    hits = [(rng.randrange(3), rng.randrange(0, 600_000, 500), n) for n in range(400)]
    for n in range(4):
        spark.createDataFrame(hits[n::4], "key bigint, ms bigint, order bigint").coalesce(1).write.mode("append").parquet(f"{tmp_path}/h")
    end = 10 * 24 * 3600 * 1000
    for n in (1, 2):
        spark.createDataFrame([(99, n * end, 1000 + n), (None, n * end, 5)], "key bigint, ms bigint, order bigint").coalesce(1).write.parquet(f"{tmp_path}/late{n}")
    (tmp_path / "feed").mkdir()
    files = [*sorted((tmp_path / "h").glob("*.parquet")), *sorted((tmp_path / "late1").glob("*.parquet")), *sorted((tmp_path / "late2").glob("*.parquet"))]
    for n, file in enumerate(files):
        target = tmp_path / "feed" / f"{n:02}.parquet"
        shutil.copy(file, target)
        os.utime(target, (1_700_000_000 + n * 60,) * 2)
    feed = spark.readStream.schema("key bigint, ms bigint, order bigint").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/feed")
    got = {(r["key"], r["order"]): r["allowed"] for r in run(st.limiter(feed, 4), "append", tmp_path, "limited2").collect() if r["key"] != 99}
    batch = up.limited(spark.createDataFrame(hits, "key bigint, ms bigint, order bigint"), "key", "ms", "order", 4)
    assert got == {(r["key"], r["order"]): r["allowed"] for r in batch.collect()}
    state = spark.read.format("statestore").load(f"{tmp_path}/limited2").collect()
    assert {r["key"]["key"] for r in state} <= {99}  # all other keys are removed


def test_forgotten_words(spark, tmp_path):
    rows = [(1, "olma", 0), (1, "olma", 1), (1, "nok", 2), (1, "behi", 3), (1, "behi", 4), (None, "x", 5)]
    spark.createDataFrame(rows, "from_id bigint, word string, ms bigint").coalesce(1).write.parquet(f"{tmp_path}/w")
    feed = spark.readStream.schema("from_id bigint, word string, ms bigint").parquet(f"{tmp_path}/w")
    assert {r["word"] for r in run(st.learn(feed, max_words=2), "update", tmp_path, "forgot").collect()} == {"olma", "behi"}


def test_learned_words(spark, tmp_path):
    times = [0, 10**9, 3 * 10**9]
    spark.createDataFrame([(1, "olma", t) for t in times], "from_id bigint, word string, ms bigint").write.parquet(f"{tmp_path}/w")
    feed = spark.readStream.schema("from_id bigint, word string, ms bigint").parquet(f"{tmp_path}/w")
    got = run(st.learn(feed), "update", tmp_path, "learned").orderBy("last_ms", ascending=False).first()
    expected = up.decayed(spark.createDataFrame([(1, t) for t in times], "k int, ms bigint"), ["k"], "ms").first()["count"]
    assert abs(got["count"] - expected) < 1e-9
