"""Sources and sinks: corpus shards, word and pair tables, word lists, benchmark items, lexicon tables, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bitik.functions import text as tx, translit as tr
from bitik.operators.lexicon import packed, total

UNIGRAMS = "word string, books bigint, news bigint, telegram bigint, title bigint, lower bigint"
BIGRAMS = "w1 string, w2 string, count bigint"
USER_FORMAT = "bitik-user"
HELD_OUT = "surface string, canonical string, count bigint"
ITEMS = "item_id string, category string, split string, context string, question string, options array<string>, answer int, source string"


def shards(spark: SparkSession, path: str, register: str | None = None) -> DataFrame:
    """The text column of the parquet shards under a path or glob, with the file each row is from."""
    out = spark.read.parquet(path).select("text", F.input_file_name().alias("shard")).where("text <> ''")
    return out.withColumn("register", F.lit(register)) if register else out


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """A tab-separated table of declared types; quotes are ordinary characters."""
    return spark.read.schema(schema).options(sep="\t", quote="", header=str(header).lower()).csv(path)


def write_tsv(df: DataFrame, path: str, *order, compression: str = "none", header: bool = True) -> None:
    """Sorted by range partitions, so that the files follow one another in order."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").options(sep="\t", quote="", escape="", header=str(header).lower(), compression=compression).csv(path)


def write_unigrams(df: DataFrame, path: str) -> None:
    write_tsv(df, path, total().desc(), "word")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """A commented word list; words with an apostrophe are read as old Latin. Empty lines and repeats fall out."""
    line = F.trim(F.split_part("value", F.lit("#"), F.lit(1)))
    words = spark.read.text(path).select(line.alias("w")).where("w <> ''")
    low = F.lower(tx.normalize(F.col("w")))
    return words.select(F.when(F.contains("w", F.lit("'")), tr.old_to_new(low)).otherwise(F.lower("w")).alias("word")).distinct()


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """S7, JS1: benchmark items from JSON lines; a line that is no JSON has null fields."""
    return spark.read.schema(ITEMS).json(path)


def keep_marked(items: DataFrame, path: str) -> None:
    """Items whose review mark begins with keep, as JSON lines by split."""
    items.where(F.lower("mark").startswith("keep")).drop("mark").write.mode("overwrite").partitionBy("split").json(path)


def files_digest(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and sha-256 of every file, for checking a delivery."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def verified(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """S3: name and state (ok, missing, wrong size, wrong content, unlisted) of the files under a path against (name, length, sha256)."""
    found = files_digest(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("l"), F.col("sha256").alias("s"))
    both = manifest.join(found, "name", "full")
    state = F.when(F.col("l").isNull(), "missing").when(F.col("length").isNull(), "unlisted").when(F.col("l") != F.col("length"), "wrong size").when(F.col("s") != F.lower("sha256"), "wrong content").otherwise("ok")
    return both.select("name", state.alias("state"))


def folder_bytes(spark: SparkSession, path: str, budget: int | None = None) -> int:
    """Bytes of all files under a path; an error if they exceed the budget."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    if budget is not None and size > budget:
        raise ValueError(f"{path} has {size} bytes, {size - budget} more than allowed")
    return size


def export_users(model: DataFrame) -> DataFrame:
    """JS1: one JSON text a user of a model (from_id, word, count, last_ms); a user has at most 5,000 words."""
    words = F.array_sort(F.collect_list(F.struct("word", "count", "last_ms")))
    rows = model.where("from_id IS NOT NULL").groupBy("from_id").agg(words.alias("words"))
    return rows.select("from_id", F.to_json(F.struct(F.lit(USER_FORMAT).alias("format"), F.lit(1).alias("version"), "words")).alias("json"))


def import_users(rows: DataFrame) -> DataFrame:
    """JS1: the model in JSON texts (from_id, json); a text that is no model has no words."""
    read = F.from_json("json", "format string, version int, words array<struct<word:string,count:double,last_ms:bigint>>")
    return rows.select("from_id", read.alias("m")).where(F.col("m.format") == USER_FORMAT).select("from_id", F.explode("m.words").alias("w")).select("from_id", "w.*")


def write_lexicon(words: DataFrame, bigrams: DataFrame, suffixes: DataFrame, folder: str) -> None:
    """The packed lexicon as tables: words in the order of their skeleton, pairs by their first word, suffixes."""
    packed(words).sort("skeleton", tx.utf8_order(F.col("word"))).write.mode("overwrite").parquet(f"{folder}/words")
    bigrams.repartition("w1").sortWithinPartitions("w1", F.desc("count")).write.mode("overwrite").parquet(f"{folder}/bigrams")
    suffixes.orderBy("suffix").write.mode("overwrite").parquet(f"{folder}/suffixes")


LEXICON_COLUMNS = {
    "words": {"word": "string", "skeleton": "string", "uni_q": "int", "inf_q": "int", "capitalized": "boolean"},
    "bigrams": {"w1": "string", "w2": "string", "count": "bigint"},
    "suffixes": {"suffix": "string"},
}


def read_lexicon(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables of a lexicon; an error names missing columns, other types, and words that do not fit their columns."""
    tables = {name: spark.read.parquet(f"{folder}/{name}") for name in LEXICON_COLUMNS}
    for name, columns in LEXICON_COLUMNS.items():
        types = dict(tables[name].dtypes)
        if wrong := sorted(c for c, t in columns.items() if types.get(c) != t):
            raise ValueError(f"no lexicon: {wrong} missing or of another type in {name}")
    w = tables["words"]
    bad = w.agg(
        F.count_if(~F.coalesce(tx.is_packable(F.col("word")), F.lit(False))).alias("letters"), F.count_if(F.col("skeleton") != tx.skeleton_key(F.col("word"))).alias("skeletons"),
        F.count_if(~F.col("uni_q").between(0, 255) | ~F.col("inf_q").between(0, 255)).alias("counts"), (F.count("*") - F.count_distinct("word")).alias("repeated"),
    ).first()
    if any(bad):
        raise ValueError(f"no lexicon: {({k: n for k, n in bad.asDict().items() if n})} words are wrong")
    return w, tables["bigrams"], tables["suffixes"]


def publish(words: DataFrame, index: DataFrame, bigrams: DataFrame, folder: str, cutoff: int) -> None:
    """The published tables: word, count, skeleton; the skeleton index; pairs from a count on."""
    count = total().alias("count")
    write_tsv(words.select("word", count, tx.skeleton_key(F.col("word")).alias("skeleton")), f"{folder}/unigrams", F.desc("count"), "word", compression="gzip")
    write_tsv(index, f"{folder}/skeleton-index", "skeleton", compression="gzip")
    write_tsv(bigrams.where(F.col("count") >= cutoff), f"{folder}/bigrams", F.desc("count"), "w1", "w2", compression="gzip")


def markdown(df: DataFrame, limit: int = 200) -> str:
    """An aggregate as a Markdown table; a line at the end says how many rows beyond the limit are left out."""
    rows = df.limit(limit + 1).collect()
    lines = [df.columns, ["---"] * len(df.columns), *[["" if v is None else str(v) for v in r] for r in rows[:limit]]]
    out = "\n".join("| " + " | ".join(line) + " |" for line in lines)
    return out if len(rows) <= limit else f"{out}\n\n{df.count() - limit} more rows are left out."


def json_report(df: DataFrame, path: str) -> None:
    """An aggregate as one file of JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def upsert(board: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """JS2: a table with the rows of `new` in place of those of the same key."""
    return board.join(new, key, "left_anti").unionByName(new)
