"""From counts to a lexicon: admission, merges, ranking, builds, bigrams, quantised columns, suffixes, reports.

Word tables have the columns word, books, news, telegram, title, lower; null counts count as 0, null and
blank words are left out, a repeated word has its counts added. Words of one skeleton are few, so the
self-joins on it stay small per key; skew on a word is met by aggregating first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bitik.functions import text as tx
from bitik.functions.alphabet import APOSTROPHES, TUTUQ
from bitik.operators import skew
from bitik.session import materialise

COUNTS = ("books", "news", "telegram", "title", "lower")
MIN_COUNT = 2
BOOK_MIN_RATIO = 0.01
SHORT_WORDS = ("u", "o", "e", "a")
CAPITALIZED_SHARE = 0.90
BIGRAM_LOAD_MIN = 3
#: Bytes of the published pairs.
SIZE_CAP = 500_000_000


def word_table(rows: DataFrame) -> DataFrame:
    """The counted words, clean."""
    counts = [F.sum(F.coalesce(F.col(c).cast("bigint"), F.lit(0))).alias(c) for c in COUNTS]
    return rows.where("trim(word) <> ''").groupBy("word").agg(*counts)


def total() -> Column:
    return F.col("books") + F.col("news") + F.col("telegram")


def admission(words: DataFrame, protected: DataFrame | None = None, ratio: float = BOOK_MIN_RATIO) -> DataFrame:
    """`words` with skeleton, admitted, reason and merged_into.

    Marked words need MIN_COUNT anywhere, unmarked ones in books. A form that is an admitted word with some
    marks removed needs `ratio` of its book count. A rejected form is merged into the most frequent admitted
    word it may come from; of equals, the first by spelling.
    """
    w = F.col("word")
    if protected is not None:
        absent = protected.select("word").distinct().join(words, "word", "left_anti")
        words = words.unionByName(absent.select("word", *[F.lit(0).cast("bigint").alias(c) for c in COUNTS]))
        words = words.join(protected.select("word", F.lit(True).alias("protected")).distinct(), "word", "left").withColumn("protected", F.coalesce("protected", F.lit(False)))
    else:
        words = words.withColumn("protected", F.lit(False))
    first = (
        F.when((tx.letter_count(w) < 2) & ~w.isin(*SHORT_WORDS), "shorter-than-2")
        .when(~tx.is_packable(w), "not-packable")
        .when(tx.is_marked(w), F.when(total() < MIN_COUNT, "rare"))
        .when(F.col("books") < MIN_COUNT, "unmarked-not-in-books")
    )
    # a stripped variant has its source's skeleton and bare form; only such pairs meet the pattern
    judged = words.withColumn("skeleton", tx.skeleton_key(w)).withColumn("bare", tx.bare(w)).withColumn("reason", first)
    base = judged.where("reason IS NULL").select(F.col("word").alias("g"), "skeleton", "bare", F.col("books").alias("g_books"))
    from_g = (F.col("g") != w) & F.rlike(w, tx.stripped_pattern(F.col("g")))
    tops = judged.where("reason IS NULL").join(base, ["skeleton", "bare"]).where(from_g).groupBy("word").agg(F.max("g_books").alias("top"))
    judged = judged.join(tops, "word", "left")
    below = F.col("reason").isNull() & (F.col("books") < ratio * F.col("top"))
    judged = judged.withColumn("reason", F.when(~F.col("protected"), F.when(below, "stripped-variant-below-ratio").otherwise(F.col("reason")))).drop("top")
    judged = judged.withColumn("admitted", F.col("reason").isNull())
    targets = judged.where("admitted").select(F.col("word").alias("g"), "skeleton", "bare", total().alias("g_total"))
    best = F.min(F.struct((-F.col("g_total")).alias("o"), F.col("g").alias("g")))
    merges = judged.where("NOT admitted").join(targets, ["skeleton", "bare"]).where(from_g).groupBy("word").agg(best.alias("best")).select("word", F.col("best.g").alias("merged_into"))
    return judged.join(merges, "word", "left").select("word", *COUNTS, "skeleton", "protected", "admitted", "reason", "merged_into")


def rejections(admitted: DataFrame) -> DataFrame:
    """Rejected and merged forms by reason, with their mass."""
    merged = F.col("merged_into").isNotNull()
    return admitted.where("NOT admitted").groupBy("reason").agg(F.count("*").alias("forms"), F.count_if(merged).alias("merged"), F.sum(total()).alias("mass"), F.sum(F.when(merged, total()).otherwise(0)).alias("merged_mass"))


def merged_counts(admitted: DataFrame) -> DataFrame:
    """Admitted words with the counts of the forms merged into them."""
    kept = admitted.where("admitted OR merged_into IS NOT NULL")
    return kept.groupBy(F.coalesce("merged_into", "word").alias("word")).agg(*[F.sum(c).alias(c) for c in COUNTS], F.max("protected").alias("protected"))


def order_columns(by: str) -> list[Column]:
    """The two rankings of words."""
    crawl = F.col("news") + F.col("telegram")
    return [crawl.desc(), total().desc(), F.col("word")] if by == "crawl" else [total().desc(), F.col("word")]


def build(words: DataFrame, size: int, by: str = "total") -> DataFrame:
    """The first `size` words by rank; protected words displace the tail. `size` bounds the one window at the end."""
    kept = words.orderBy(F.desc("protected"), *order_columns(by)).limit(size)
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(*order_columns(by))).cast("bigint") - 1)


def packed(words: DataFrame) -> DataFrame:
    """The lexicon's columns: skeleton, quantised log counts, flags, in the packed order.

    The scale comes from the largest count, by one aggregate that meets the words in a broadcast of one row.
    """
    tops = F.broadcast(words.agg(F.max(total()).alias("top_all"), F.max("telegram").alias("top_inf")))
    titles = F.col("title") + F.col("lower")
    capital = (titles > 0) & (F.col("title") >= CAPITALIZED_SHARE * titles)
    return words.join(tops).select(
        "word", tx.skeleton_key(F.col("word")).alias("skeleton"), tx.quantise(total(), F.col("top_all")).alias("uni_q"), tx.quantise(F.col("telegram"), F.col("top_inf")).alias("inf_q"), capital.alias("capitalized"), "protected"
    )


def bigram_table(rows: DataFrame) -> DataFrame:
    """Directed pairs with their counts from the delivered rows; a delivery counts once, a row without a delivery number always."""
    word = lambda c: F.translate(F.lower(F.trim(F.col(c))), APOSTROPHES, TUTUQ * len(APOSTROPHES))
    valid = rows.select("row_id", word("w1").alias("w1"), word("w2").alias("w2"), F.col("count").cast("bigint").alias("count")).where("w1 <> '' AND w2 <> '' AND count >= 1")
    once = valid.where("row_id IS NOT NULL").groupBy("row_id").agg(F.min(F.struct("w1", "w2", "count")).alias("r")).select("r.*")
    return once.unionByName(valid.where("row_id IS NULL").drop("row_id")).groupBy("w1", "w2").agg(F.sum("count").alias("count"))


def merged_bigrams(bigrams: DataFrame, admitted: DataFrame, least: int = BIGRAM_LOAD_MIN) -> DataFrame:
    """Pairs with both sides mapped to admitted words; pairs outside the lexicon fall out.

    A word with a large share of all pairs meets its mapping in a broadcast of bounded size, see `skew`.
    """
    names = admitted.where("admitted OR merged_into IS NOT NULL").select("word", F.coalesce("merged_into", "word").alias("to"))
    out = materialise(bigrams.where(F.col("count") >= least))
    hot = skew.hot_keys(out, "w1", "w2")
    for side in ("w1", "w2"):
        out = skew.lookup(out, side, names.withColumnRenamed("word", "key"), hot).where("to IS NOT NULL").drop(side).withColumnRenamed("to", side)
    return out.groupBy("w1", "w2").agg(F.sum("count").alias("count"))


def build_bigrams(bigrams: DataFrame, words: DataFrame, size: int) -> DataFrame:
    """The most frequent pairs inside a build; ties in the order of the words' ranks."""
    ranks = words.select("word", "rank")
    for side in ("w1", "w2"):
        bigrams = bigrams.join(ranks.withColumnsRenamed({"word": side, "rank": f"{side}_rank"}), side)
    return bigrams.orderBy(F.desc("count"), "w1_rank", "w2_rank").limit(size).select("w1", "w2", "count", "w1_rank", "w2_rank")


def adjacency(bigrams: DataFrame) -> DataFrame:
    """AR2: every pair with its place in the list of all successors: by word, most frequent first, then by spelling.

    The list is sorted over range partitions and numbered in them, so a word with very many successors may
    lie in several; `offsets` are the places where the words begin.
    """
    return skew.positions(bigrams.select("w1", "w2", "count"), "w1", F.desc("count"), "w2")


def offsets(adjacent: DataFrame) -> DataFrame:
    """AR2: for each word the place of its first successor and their number."""
    return adjacent.groupBy("w1").agg(F.min("pos").alias("first_pos"), F.count("*").alias("successors"))


def size_grid(words: DataFrame, bigrams: DataFrame, word_steps: list[int], pair_steps: list[int], budget: int) -> DataFrame:
    """T4: estimated bytes of every build of a grid, whether it fits into `budget`, and the chosen one: the most words, then the most pairs.

    words: word, rank; bigrams: count, w1_rank, w2_rank. Counts and bytes are combined by step of the grid first:
    a pair belongs to the first word step that holds both its words, so one pass serves all word steps; a pair
    is six bytes, a word its letters and four bytes, as in the packed tables.
    """
    step = lambda rank: F.element_at(F.filter(F.array(*[F.lit(n) for n in word_steps]), lambda n: n > rank), 1)
    sizes = words.select(step(F.col("rank")).alias("words"), (F.octet_length("word") + 4).alias("bytes")).where("words IS NOT NULL").groupBy("words").agg(F.sum("bytes").alias("bytes"))
    pairs = bigrams.select(step(F.greatest("w1_rank", "w2_rank")).alias("words")).where("words IS NOT NULL").groupBy("words").agg(F.count("*").alias("pairs"))
    spark = words.sparkSession
    grid = spark.createDataFrame([(n,) for n in word_steps], "words int")
    upto = Window.orderBy("words").rowsBetween(Window.unboundedPreceding, 0)  # one row a step
    sums = grid.join(sizes, "words", "left").join(pairs, "words", "left").select("words", F.sum(F.coalesce("bytes", F.lit(0))).over(upto).alias("word_bytes"), F.sum(F.coalesce("pairs", F.lit(0))).over(upto).alias("all_pairs"))
    cells = sums.select("*", F.explode(F.array(*[F.lit(n) for n in pair_steps])).alias("pairs")).select("words", "pairs", (F.col("word_bytes") + 6 * F.least("pairs", "all_pairs")).cast("bigint").alias("bytes"))
    fits = cells.withColumn("fits", F.col("bytes") <= budget)
    best = F.max(F.when(F.col("fits"), F.struct("words", "pairs"))).over(Window.partitionBy())
    return fits.withColumn("chosen", F.coalesce(F.struct("words", "pairs") == best, F.lit(False)))


def size_cutoff(rows: DataFrame, columns: list[str], cap: int = SIZE_CAP, lowest: int = 3) -> DataFrame:
    """The least count, `lowest` or more, at which the lines of all pairs with that count or more fit into `cap` bytes.

    Lines are summed by count first, so the one window is over the distinct counts, at most the root of twice the sum of all counts.
    """
    line = sum((F.octet_length(c) for c in columns), F.octet_length(F.col("count").cast("string"))) + len(columns) + 1
    by = rows.where(F.col("count") >= lowest).groupBy("count").agg(F.sum(line).alias("bytes"))
    sums = by.select("count", F.sum("bytes").over(Window.orderBy(F.desc("count")).rowsBetween(Window.unboundedPreceding, 0)).alias("bytes"))
    fits = F.col("bytes") <= cap
    cutoff = F.coalesce(F.max(F.when(~fits, F.col("count"))) + 1, F.lit(lowest)).cast("bigint")
    return sums.agg(cutoff.alias("cutoff"), F.coalesce(F.max(F.when(fits, F.col("bytes"))), F.lit(0)).cast("bigint").alias("bytes"))


def suffix_chains(words: DataFrame, stem_min: int = 1000, word_min: int = 10, min_stems: int = 100) -> DataFrame:
    """A10, Q10: suffixes of 2 to 12 letters that follow many different stems; words have a column n."""
    stems = words.where((F.col("n") >= stem_min) & (tx.letter_count(F.col("word")) >= 3)).select(F.col("word").alias("stem"))
    cuts = words.where((F.col("n") >= word_min) & (F.length("word") > 1)).select("word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("i"))
    splits = cuts.select(F.substr("word", F.lit(1), F.col("i")).alias("stem"), F.substr("word", F.col("i") + 1).alias("suffix"))
    fit = splits.where(~F.startswith("suffix", F.lit(TUTUQ)) & tx.letter_count(F.col("suffix")).between(2, 12))
    return fit.join(stems, "stem", "left_semi").groupBy("suffix").agg(F.count("*").alias("stems")).where(F.col("stems") >= min_stems)


def subtract(words: DataFrame, held: DataFrame) -> DataFrame:
    """Word counts without the held-out tokens (word, register, letter_case, n), never below 0; rare words go."""
    by = [F.sum(F.when(F.col("register") == r, F.col("n")).otherwise(0)).alias(f"h_{r}") for r in ("news", "telegram")]
    by += [F.sum(F.when(F.col("letter_case") == c, F.col("n")).otherwise(0)).alias(f"h_{c}") for c in ("title", "lower")]
    joined = words.join(held.groupBy("word").agg(*by), "word", "left")
    less = lambda c: F.greatest(F.lit(0), F.col(c) - F.coalesce(f"h_{c}", F.lit(0))).alias(c)
    return joined.select("word", "books", *[less(c) for c in ("news", "telegram", "title", "lower")]).where(total() >= MIN_COUNT)


def coverage(held: DataFrame, words: DataFrame, chains: DataFrame) -> DataFrame:
    """Shares of held-out tokens in the lexicon, with a word of their skeleton, and with stem and suffix in it."""
    forms = held.groupBy("register", "word").agg(F.sum("n").alias("n"))
    lex = words.select("word")
    known = forms.select("word").distinct().join(lex.withColumn("known", F.lit(True)), "word", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    keyed = known.withColumn("skeleton", tx.skeleton_key(F.col("word"))).join(lex.select(tx.skeleton_key(F.col("word")).alias("skeleton"), F.lit(True).alias("keyed")).distinct(), "skeleton", "left")
    cuts = known.where("NOT known AND length(word) >= 5").select("word", F.explode(F.sequence(F.lit(3), F.length("word") - 2)).alias("i"))
    parts = cuts.select("word", F.substr("word", F.lit(1), F.col("i")).alias("stem"), F.substr("word", F.col("i") + 1).alias("suffix"))
    split = parts.join(chains.select("suffix"), "suffix", "left_semi").join(lex.withColumnRenamed("word", "stem"), "stem", "left_semi").select("word", F.lit(True).alias("split")).distinct()
    flags = keyed.join(split, "word", "left").select("word", "known", F.coalesce("keyed", F.lit(False)).alias("keyed"), F.coalesce("split", F.lit(False)).alias("split"))
    n = F.col("n")
    share = lambda flag, name: (F.sum(F.when(flag, n).otherwise(0)) / F.sum(n)).alias(name)
    return forms.join(flags, "word").groupBy("register").agg(F.sum("n").alias("tokens"), share(F.col("known"), "in_lexicon"), share(F.col("keyed"), "skeleton_match"), share(F.col("known") | F.col("split"), "stem_plus_suffix"))


def prefixes(words: DataFrame, key: str = "skeleton") -> DataFrame:
    """The prefix index: one row for every prefix of every key."""
    return words.select("*", F.explode(F.sequence(F.lit(1), F.length(key))).alias("len")).withColumn("prefix", F.expr(f"substr({key}, 1, len)")).drop("len")
