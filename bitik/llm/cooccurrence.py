"""Problem 1: items that appear together, and how much more often than by chance.

Deliveries are deduplicated, pairs are put in order, counts are combined before the shuffle, and lift and
pointwise mutual information come from the marginals. `basket_pairs` is the same for baskets of items.

A word may stand in a third of all rows. Pair counts are aggregated first, so such a word keeps one row for
each partner; the words with the most partners - at most 2 * HOT_SHARE of them, whatever the data, since
each takes at least one in HOT_SHARE of the pairs - have their marginals broadcast, and only the other
words go through a shuffled join.

Defined results: rows with a null or blank word, a null count, a count below 1 or equal words are left out;
a null row id is no delivery number, so such rows all count; of one id delivered with different
contents the least (w1, w2, count) counts; an empty table has no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bitik.functions.alphabet import APOSTROPHES, TUTUQ
from bitik.operators import skew
from bitik.session import materialise

HOT_SHARE = 1000


def canonical_word(word: Column) -> Column:
    """Without outer blanks, in lower case, with one apostrophe."""
    return F.translate(F.lower(F.regexp_replace(word, r"(?U)^\s+|\s+$", "")), APOSTROPHES, TUTUQ * len(APOSTROPHES))


def ordered_pairs(rows: DataFrame) -> DataFrame:
    """Valid deliveries of (row_id, w1, w2, count) as w1 < w2, n; each row id once."""
    a, b = canonical_word(F.col("w1")), canonical_word(F.col("w2"))
    valid = (
        rows.select("row_id", a.alias("a"), b.alias("b"), F.col("count").cast("bigint").alias("n"))
        .where("a <> '' AND b <> '' AND n >= 1 AND a <> b")
        .select("row_id", F.least("a", "b").alias("w1"), F.greatest("a", "b").alias("w2"), "n")
    )
    once = valid.where("row_id IS NOT NULL").groupBy("row_id").agg(F.min(F.struct("w1", "w2", "n")).alias("r")).select("r.w1", "r.w2", "r.n")
    return once.unionByName(valid.where("row_id IS NULL").select("w1", "w2", "n"))


#: Items of a basket that one task of the join holds beside all others of the basket.
BASKET_PART = 1000


def basket_pairs(rows: DataFrame, basket: str, item: str) -> DataFrame:
    """Ordered pairs of the distinct items of each basket, one row a basket and pair, as w1 < w2, n.

    Items are spread by an equi-join on the basket, never gathered into one list. A large basket is cut into parts of about
    BASKET_PART items by a hash of the item, and each part meets the whole basket in tasks of its own. Rows with a
    null basket or item are left out; a repeated item counts once in a basket.
    """
    items = materialise(rows.select(F.col(basket).alias("basket"), F.col(item).alias("item")).dropna().distinct())
    large = items.groupBy("basket").agg(F.ceil(F.count("*") / BASKET_PART).cast("int").alias("parts")).where("parts > 1")
    cut = items.join(large, "basket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    left = cut.select("basket", "item", F.pmod(F.xxhash64("item"), F.col("parts")).cast("int").alias("part"))
    right = cut.select("basket", F.col("item").alias("other"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return left.join(right, ["basket", "part"]).where("item < other").select(F.col("item").alias("w1"), F.col("other").alias("w2"), F.lit(1).cast("bigint").alias("n"))


def association(pairs: DataFrame, min_count: int = 1, min_lift: float | None = None) -> DataFrame:
    """w1, w2, count, lift, pmi of every pair with at least `min_count` and `min_lift`.

    lift = count * N / (n(w1) * n(w2)) with N the sum of all counts and n(w) that of the pairs with w on
    either side; pmi is its logarithm to base 2. Marginals are taken over all pairs before any threshold.
    """
    counts = materialise(pairs.groupBy("w1", "w2").agg(F.sum("n").alias("count")))
    margins = counts.select(F.explode(F.array("w1", "w2")).alias("w"), "count").groupBy("w").agg(F.sum("count").alias("n"), F.count("*").alias("partners"))
    margins = materialise(margins)
    both_sides = margins.agg(F.sum("n").alias("n"), F.sum("partners").alias("partners")).first()
    total, links = F.lit((both_sides["n"] or 0) // 2), F.lit((both_sides["partners"] or 0) // 2)
    hot = margins.where(F.col("partners") * HOT_SHARE >= links).select(F.col("w").alias("key"))
    out = counts.where(F.col("count") >= min_count)
    for side in ("w1", "w2"):
        out = skew.lookup(out, side, margins.select(F.col("w").alias("key"), F.col("n").alias(f"{side}_n")), hot)
    lift = F.col("count") * total / (F.col("w1_n").cast("double") * F.col("w2_n"))
    out = out.select("w1", "w2", "count", lift.alias("lift")).withColumn("pmi", F.log2("lift"))
    return out.where(F.col("lift") >= min_lift) if min_lift is not None else out
