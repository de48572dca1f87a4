"""Look-ups on keys of which a few may hold a large share of all rows, and places in a sorted table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bitik.session import materialise

#: A key with one in so many rows is hot, so a column has at most so many hot keys, whatever the data.
HOT_SHARE = 1000
#: Rows of a hot key, which find their value in the broadcast, are spread over so many keys that match nothing.
SPREAD = 4096


def hot_keys(rows: DataFrame, *columns: str) -> DataFrame:
    """key: the values that stand in one in HOT_SHARE of the rows in any of the columns; at most HOT_SHARE times the columns."""
    total = rows.count()
    counts = rows.select(F.explode(F.array(*columns)).alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"))
    return materialise(counts.where(F.col("n") * HOT_SHARE >= total).select("key"))


def lookup(rows: DataFrame, column: str, values: DataFrame, hot: DataFrame) -> DataFrame:
    """`rows` with the other columns of `values` (one row a key) for the key in `column`; null where there is none.

    Values of hot keys are broadcast, a table bounded by their number; all other keys are shuffled, and no key of
    those has a large share of the rows.
    """
    names = [c for c in values.columns if c != "key"]
    few = values.join(F.broadcast(hot), "key", "left_semi").select(F.col("key").alias("_hot"), F.struct(*names).alias("_few"))
    out = rows.join(F.broadcast(few), F.col(column) == F.col("_hot"), "left")
    row = F.pmod(F.xxhash64(*rows.columns), F.lit(SPREAD)).cast("string")
    out = out.withColumn("_key", F.when(F.col("_hot").isNull(), F.col(column)).otherwise(F.concat(F.lit("\x00"), row)))
    out = out.join(values.select(F.col("key").alias("_key"), F.struct(*names).alias("_other")), "_key", "left")
    both = F.coalesce("_few", "_other")
    return out.select(*rows.columns, *[both[n].alias(n) for n in names])


def positions(rows: DataFrame, *order) -> DataFrame:
    """`rows` with pos, the place of each in the order, from 0. Range partitions are sorted and numbered apart and shifted by the sizes of those before."""
    numbered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    numbered = materialise(numbered.select(*rows.columns, F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    sizes = sorted((r["_part"], r["n"]) for r in numbered.groupBy("_part").agg(F.count("*").alias("n")).collect())  # one row a partition
    starts, start = [], 0
    for part, n in sizes:
        starts.append((part, start))
        start += n
    table = rows.sparkSession.createDataFrame(starts, "_part bigint, _start bigint")
    return numbered.join(F.broadcast(table), "_part").select(*rows.columns, (F.col("_start") + F.col("_at")).alias("pos"))
