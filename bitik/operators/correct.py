"""Queries of the engine: conservative correction of whole texts, and suggestions for unfinished words.

A token may only become a word of one of its skeletons; a valid token is never rewritten. Everything about a
form is found once for each distinct form and joined back to its places; only the choice between several
candidates looks at the word chosen before, by a fold over the few chains that hold such a choice.

A lexicon has the columns word, skeleton, ln_uni, capitalized, units; bigrams w1, w2, ln_bi; suffixes suffix;
the words of users user, word, bonus, which count for the texts and queries of that user alone.
Null and empty texts come back as they are; tokens of a third script or of mixed case are never corrected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bitik.functions import text as tx, translit as tr
from bitik.operators.evidence import evidence, latin_units, readings, word_units
from bitik.operators.lexicon import packed, total
from bitik.operators.updates import HALF_LIFE_MS
from bitik.session import materialise

LAMBDA, MU, NU, MIX = 2.0, 3.0, 0.5, 0.5
ACRONYM = 4
MIN_STEM, MIN_SUFFIX = 3, 2
SCAN_ALL, UNIGRAM_POOL, BIGRAM_POOL = 256, 64, 128


def lexicon(words: DataFrame) -> DataFrame:
    """Words with the logarithm of their quantised counts, the informal register mixed in, and their units."""
    tops = F.broadcast(words.agg(F.max(total()).alias("a"), F.max("telegram").alias("b")))
    scale = lambda top: F.lit(255.0) / F.log(F.greatest(F.lit(2.0), F.col(top).cast("double")))
    rows = packed(words).join(tops)
    ln_all, ln_inf = F.col("uni_q") / scale("a"), F.when(F.col("inf_q") > 0, F.col("inf_q") / scale("b"))
    return rows.select("word", "skeleton", ((1 - MIX) * ln_all + MIX * F.coalesce(ln_inf, ln_all)).alias("ln_uni"), "capitalized", word_units(F.col("word")).alias("units"))


def user_words(model: DataFrame, now: Column | None = None) -> DataFrame:
    """Q4: user, word and bonus of a user model (from_id, word, count, last_ms), its counts decayed to `now` in milliseconds."""
    age = (now if now is not None else F.max("last_ms").over(Window.partitionBy("from_id"))) - F.col("last_ms")
    decayed = F.col("count") * F.pow(F.lit(2.0), -age / F.lit(float(HALF_LIFE_MS)))
    return model.select(F.col("from_id").alias("user"), "word", F.log1p(decayed).alias("bonus")).where("user IS NOT NULL AND word <> ''")


def bigram_scores(bigrams: DataFrame) -> DataFrame:
    """w1, w2, ln_bi from the quantised pair counts."""
    top = F.broadcast(bigrams.agg(F.max("count").alias("t")))
    scale = F.lit(255.0) / F.log(F.greatest(F.lit(2.0), F.col("t").cast("double")))
    return bigrams.join(top).select("w1", "w2", F.log(F.exp(tx.quantise(F.col("count"), F.col("t")) / scale) + 1).alias("ln_bi"))


def segments(texts: DataFrame, key: str) -> DataFrame:
    """The pieces of every text in order, with kind, chunk, initial and shouting.

    Texts are distributed by their key before they are taken apart: whole texts move, not pieces, and every window
    below finds its rows in place.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.select(key, "text").repartition(parts, key).select(key, F.posexplode_outer(tx.runs(F.col("text"))).alias("run_no", "run")).where("run_no IS NOT NULL")
    rows = rows.withColumn("protected_run", tx.is_protected_run(F.col("run")))
    rows = rows.withColumn("ps", F.when(F.col("run").rlike(f"^[{tx.JS_SPACE}]"), F.array("run")).otherwise(tx.segments_of(F.col("run"))))
    rows = rows.select(key, "run_no", "protected_run", "ps", F.posexplode_outer("ps").alias("piece_no", "piece"))
    before, after = F.get("ps", F.col("piece_no") - 1), F.get("ps", F.col("piece_no") + 1)
    glued = F.coalesce(before.rlike(f"{tx.DIGIT}$"), F.lit(False)) | F.coalesce(after.rlike(f"^{tx.DIGIT}"), F.lit(False))
    kind = F.when(~tx.is_token(F.col("piece")), "gap").when(F.col("protected_run"), "protected").when(glued, "glued").otherwise("token")
    rows = rows.select(key, "run_no", "piece_no", "piece", kind.alias("kind")).withColumn("letter_case", tx.case_pattern(F.col("piece")))
    along = Window.partitionBy(key).orderBy("run_no", "piece_no")
    stop = (F.col("kind") == "gap") & F.col("piece").rlike(tx.BREAK)
    rows = rows.withColumn("stop", stop).withColumn("chunk", F.sum(stop.cast("int")).over(along))
    chunk = Window.partitionBy(key, "chunk")
    token, long_ = F.col("kind") == "token", (F.col("kind") == "token") & (F.length("piece") >= 2)
    first = F.min(F.when(token, F.struct("run_no", "piece_no"))).over(chunk)
    rows = rows.withColumn("initial", token & (first == F.struct("run_no", "piece_no")))
    upper = F.min(F.when(long_, (F.col("letter_case") == "upper").cast("int"))).over(chunk)
    return rows.withColumn("shouting", F.coalesce(upper == 1, F.lit(False)))


def candidates(forms: DataFrame, lex: DataFrame, users: DataFrame | None = None, recovery: bool = True) -> DataFrame:
    """Forms (low, script, and user with `users`) beside the words of their skeletons.

    Columns: those of forms, word, skeleton, capitalized, base (score without context), sum and least (evidence).
    Every reading of a form is a row with its skeleton, so one equi-join finds the words, however many readings there are.
    """
    keys = ["low", "script", *(["user"] if users is not None else [])]
    cyr = F.col("script") == "cyrillic"
    read = forms.select(*keys, F.explode(readings(F.col("low"), cyr, recovery)).alias("r")).select(*keys, F.col("r.key").alias("skeleton"), F.col("r.units").alias("typed"))
    met = read.join(lex.select("skeleton", "word", "units", "ln_uni", "capitalized"), "skeleton")
    if users is not None:
        known = users.select("user", "word", "bonus")
        met = met.join(known, ["user", "word"], "left").withColumn("bonus", F.coalesce("bonus", F.lit(0.0)))
        own = users.join(lex.select("word"), "word", "left_anti")
        own = own.select("user", "word", "bonus", tx.skeleton_key(F.col("word")).alias("skeleton"), word_units(F.col("word")).alias("units"), F.lit(0.0).alias("ln_uni"), F.lit(True).alias("capitalized"))
        met = met.unionByName(read.join(own, ["user", "skeleton"]).select(met.columns))
    else:
        met = met.withColumn("bonus", F.lit(0.0))
    e = evidence(F.col("typed"), F.col("units"), cyr)
    judged = met.withColumn("e", e)
    base = F.col("ln_uni") + MU * F.col("bonus") + NU * F.col("e.sum")
    return judged.select(*keys, "word", "skeleton", "capitalized", "bonus", base.alias("base"), F.col("e.sum").alias("sum"), F.col("e.min").alias("least"))


def valid_readings(forms: DataFrame, lex: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """`forms` with r0, r1 (the literal reading first) and valid, the first of them that is a word of the lexicon or of the user."""
    low, cyr = F.col("low"), F.col("script") == "cyrillic"
    read = forms.withColumn("r0", F.when(cyr, tr.cyrillic_to_new(low)).otherwise(tr.literal(low))).withColumn("r1", F.when(cyr, F.col("r0")).otherwise(tr.old_to_new(low)))
    for r in ("r0", "r1"):
        read = read.join(lex.select(F.col("word").alias(r), F.lit(True).alias(f"{r}_known")), r, "left")
        if users is not None:
            read = read.join(users.select("user", F.col("word").alias(r), F.lit(True).alias(f"{r}_own")), ["user", r], "left").withColumn(f"{r}_known", F.coalesce(f"{r}_known", f"{r}_own")).drop(f"{r}_own")
    return read.withColumn("valid", F.when(F.col("r0_known"), F.col("r0")).when(F.col("r1_known"), F.col("r1"))).drop("r0_known", "r1_known")


def resolve(forms: DataFrame, lex: DataFrame, suffixes: DataFrame | None = None, users: DataFrame | None = None, recovery: bool = True, morphology: str | None = "read") -> DataFrame:
    """Forms (low, script, and user with `users`) with valid, the candidates, the stem-and-suffix reading and the corrected stem."""
    keys = ["low", "script", *(["user"] if users is not None else [])]
    read = valid_readings(forms, lex, users)
    one = F.struct("skeleton", tx.utf8_order(F.col("word")).alias("o"), "word", "base", "least", "capitalized")
    cands = candidates(read.where("valid IS NULL").select(*keys), lex, users, recovery).groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("cands"))
    if users is None:
        out = read.join(cands, keys, "left")
    else:  # forms of texts without a user model have a null user
        same = [F.col("x.low") == F.col("y.low"), F.col("x.script") == F.col("y.script"), F.col("x.user").eqNullSafe(F.col("y.user"))]
        out = read.alias("x").join(cands.alias("y"), same, "left").select("x.*", "y.cands")
    nothing = F.lit(None).cast("string")
    if suffixes is None or morphology is None:
        return out.select(*keys, "valid", "cands", nothing.alias("morph"), nothing.alias("mended"))
    open_ = out.where("valid IS NULL AND cands IS NULL").select("low", "script", "r0", "r1").distinct()
    out = out.join(stem_readings(open_, lex, suffixes), ["low", "script"], "left")
    if morphology != "correct":
        return out.select(*keys, "valid", "cands", "morph", nothing.alias("mended"))
    left = out.where("valid IS NULL AND cands IS NULL AND morph IS NULL AND script = 'latin'").select("low", "script").distinct()
    return out.join(stem_corrections(left, lex, suffixes), ["low", "script"], "left").select(*keys, "valid", "cands", "morph", "mended")


def _cuts(forms: DataFrame, base: Column) -> DataFrame:
    """every stem and tail of a form: no tail begins with an apostrophe, no Latin digraph is divided."""
    cyr = F.col("script") == "cyrillic"
    cuts = forms.withColumn("b", base).where(F.length("b") > 1).select("*", F.explode(F.sequence(F.lit(1), F.length("b") - 1)).alias("i"))
    cuts = cuts.withColumn("stem", F.substr("b", F.lit(1), F.col("i"))).withColumn("tail", F.substr("b", F.col("i") + 1)).drop("b", "i")
    cuts = cuts.where(~F.col("tail").rlike(f"^{tx.APOS}") & (cyr | ~(F.col("stem").rlike("[scg]$") & F.startswith("tail", F.lit("h")))))
    return cuts.where((tx.letter_count(F.col("stem")) >= MIN_STEM) & (tx.letter_count(F.col("tail")) >= MIN_SUFFIX))


def stem_corrections(forms: DataFrame, lex: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Lower-case Latin forms whose stem alone is corrected and whose suffix stays, with the result as mended.

    All divisions must give the same word, which must have the form's skeleton and no evidence against it. The
    best stem is the one with the highest score without context.
    """
    ways = F.array_distinct(F.array(tr.literal(F.col("tail")), tr.old_to_new(F.col("tail"))))
    parts = _cuts(forms, F.col("low")).select("low", "stem", F.posexplode(ways).alias("way", "t"))
    fit = parts.join(suffixes.select(F.col("suffix").alias("t")), "t", "left_semi").groupBy("low", "stem").agg(F.min(F.struct("way", "t")).alias("t"))
    stems = fit.select(F.col("stem").alias("low"), F.lit("latin").alias("script")).distinct()
    order = F.struct(-F.col("base"), F.col("skeleton"), tx.utf8_order(F.col("word")))
    best = candidates(stems, lex).where("least >= 0").groupBy(F.col("low").alias("stem")).agg(F.min_by("word", order).alias("top"))
    outs = fit.join(best, "stem").groupBy("low").agg(F.count_distinct(F.concat("top", "t.t")).alias("n"), F.min(F.concat("top", "t.t")).alias("mended")).where("n = 1")
    e = evidence(latin_units(F.col("low")), word_units(F.col("mended")), F.lit(False))
    kept = outs.where(tx.skeleton_key(F.col("low")) == tx.skeleton_key(F.col("mended"))).where(e["min"] >= 0)
    return kept.select("low", F.lit("latin").alias("script"), "mended")


def stem_readings(forms: DataFrame, lex: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Forms that read as a known stem and a suffix chain as typed, with that reading as morph."""
    cyr = F.col("script") == "cyrillic"
    cuts = _cuts(forms.select("low", "script", "r0", "r1"), F.when(cyr, F.col("r0")).otherwise(F.col("low")))
    ways = F.array(*[F.struct(s(F.col("stem")).alias("s"), t(F.col("tail")).alias("t"), F.lit(s is t is tr.literal).alias("as_typed")) for s in (tr.literal, tr.old_to_new) for t in (tr.literal, tr.old_to_new)])
    parts = cuts.select("low", "script", "r0", "r1", F.explode(ways).alias("w")).select("low", "script", "r0", "r1", "w.*").distinct()
    fit = parts.join(suffixes.select(F.col("suffix").alias("t")), "t", "left_semi").join(lex.select(F.col("word").alias("s")), "s", "left_semi")
    whole = F.concat("s", "t")
    sums = fit.groupBy("low", "script", "r0", "r1").agg(
        F.max(F.col("as_typed") & ~cyr).alias("literal"), F.max(whole == F.col("r1")).alias("whole"), F.count_distinct(whole).alias("n"), F.min(whole).alias("only")
    )
    morph = F.when(F.col("literal"), F.col("r0")).when(F.col("whole"), F.col("r1")).when(F.col("n") == 1, F.col("only"))
    return sums.select("low", "script", morph.alias("morph")).where("morph IS NOT NULL")


def _choose(prev: Column, options: Column, scores: Column) -> Column:
    """The first option with the highest score after the word `prev`."""
    score = lambda o: o["base"] + LAMBDA * F.coalesce(F.try_element_at(scores, F.concat_ws(" ", prev, o["word"])), F.lit(0.0))
    start = F.struct(F.lit(None).cast("string").alias("word"), F.lit(float("-inf")).alias("score"))
    return F.aggregate(options, start, lambda b, o: F.when(score(o) > b["score"], F.struct(o["word"].alias("word"), score(o).alias("score"))).otherwise(b), lambda b: b["word"])


def _in_context(nodes: DataFrame, key: str, bigrams: DataFrame) -> DataFrame:
    """The choice at every node with several options, carried along its chain."""
    chain = Window.partitionBy(key, "chain")
    nodes = nodes.withColumn("several", F.max(F.size("options") > 1).over(chain)).where("several")
    lagged = nodes.withColumn("before", F.lag("options").over(chain.orderBy("run_no", "piece_no"))).where("before IS NOT NULL AND size(options) > 1")
    pairs = lagged.select(key, "chain", F.explode("before.word").alias("w1"), "options").select(key, "chain", "w1", F.explode("options.word").alias("w2")).distinct()
    known = pairs.join(bigrams, ["w1", "w2"]).groupBy(key, "chain").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(" ", "w1", "w2"), "ln_bi"))).alias("scores"))
    lists = nodes.groupBy(key, "chain").agg(F.array_sort(F.collect_list(F.struct("run_no", "piece_no", "options"))).alias("nodes")).join(known, [key, "chain"], "left")
    scores = F.coalesce("scores", F.expr("map()").cast("map<string,double>"))
    empty = F.struct(F.lit("").alias("prev"), F.expr("array()").cast("array<struct<run_no:int,piece_no:int,chosen:string>>").alias("out"))

    def step(acc, n):
        word = _choose(acc["prev"], n["options"], scores)
        return F.struct(word.alias("prev"), F.concat(acc["out"], F.array(F.struct(n["run_no"].alias("run_no"), n["piece_no"].alias("piece_no"), word.alias("chosen")))).alias("out"))

    return lists.select(key, F.explode(F.aggregate("nodes", empty, step, lambda a: a["out"])).alias("c")).select(key, "c.*")


def autocorrect(
    texts: DataFrame, lex: DataFrame, bigrams: DataFrame, suffixes: DataFrame | None = None, key: str = "id", script: str = "new",
    users: DataFrame | None = None, exceptions: DataFrame | None = None, recovery: bool = True, morphology: str | None = "read",
) -> DataFrame:
    """Q1: key, corrected for texts (key, text, and user with `users`).

    users: words of the writers, valid in their own texts and favoured there. exceptions (word, cyrillic): words
    with a Cyrillic spelling of their own. recovery: read Cyrillic letters of a Russian keyboard as Uzbek ones.
    morphology: None, "read" (stem and suffix as typed) or "correct" (the stem corrected as well).
    """
    rows = segments(texts, key).withColumn("low", F.lower(tx.fold_confusables(F.col("piece")))).withColumn("script", tx.detect_script(F.col("low")))
    plain = (F.col("kind") == "token") & (F.col("script") != "mixed") & (F.col("letter_case") != "mixed") & ~((F.col("script") == "cyrillic") & tr.has_foreign_cyrillic(F.col("low")))
    rows = rows.withColumn("plain", plain)
    keys = ["low", "script"]
    if users is not None:
        writers = texts.select(key, "user").join(users.select("user").distinct(), "user", "left_semi")
        rows, keys = rows.join(writers, key, "left"), [*keys, "user"]
    rows = materialise(rows)  # read for the forms, for the choice and for the result
    known = materialise(resolve(rows.where("plain").select(*keys).distinct(), lex, suffixes, users, recovery, morphology))
    written = rows.where("kind IN ('token', 'glued')").select("piece").distinct()
    written = written.select("piece", tr.rule_token(F.col("piece"), script).alias("as_written"))
    # a word that fills a third of the texts makes one skewed key, which adaptive execution splits on this side
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) if k == "user" else F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    rows = rows.alias("a").join(known.alias("b"), same, "left").select("a.*", "b.valid", "b.cands", "b.morph", "b.mended")
    rows = rows.join(written, "piece", "left")
    short = tx.letter_count(F.col("low")) < 2
    acronym = F.col("valid").isNull() & (F.col("letter_case") == "upper") & ~F.col("shouting") & (tx.letter_count(F.col("low")) <= ACRONYM)
    proper = F.col("letter_case").isin("title", "upper") & ~F.col("initial") & ~F.col("shouting")
    option = lambda word, base: F.array(F.struct(word.alias("word"), base.alias("base")))
    fitting = F.transform(F.filter("cands", lambda c: (c["least"] >= 0) & (c["capitalized"] | ~proper)), lambda c: F.struct(c["word"].alias("word"), c["base"].alias("base")))
    options = F.when(F.col("plain") & F.col("valid").isNotNull(), option(F.col("valid"), F.lit(0.0))).when(F.col("plain") & ~short & ~acronym & (F.size(fitting) > 0), fitting)
    rows = rows.withColumn("options", options).withColumn("typed", ~F.col("plain") | short | acronym)
    reset = F.col("stop") | ((F.col("kind") != "gap") & F.col("options").isNull())
    rows = rows.withColumn("chain", F.sum(reset.cast("int")).over(Window.partitionBy(key).orderBy("run_no", "piece_no")))
    chosen = _in_context(rows.where("options IS NOT NULL").select(key, "chain", "run_no", "piece_no", "options"), key, bigrams)
    rows = rows.join(chosen, [key, "run_no", "piece_no"], "left")
    word = F.when(~F.col("typed"), F.coalesce("chosen", F.get("options.word", F.lit(0)), F.when(F.col("cands").isNull() & ~((F.col("script") == "cyrillic") & F.lit(script == "cyrillic")), F.coalesce("morph", F.when(F.col("letter_case") == "lower", F.col("mended"))))))
    rows = rows.withColumn("word", word)
    word, spelling = F.col("word"), None
    if exceptions is not None and script == "cyrillic":
        rows = rows.join(exceptions.select("word", F.col("cyrillic").alias("listed")), "word", "left")
        spelling = F.col("listed")
    shown = tr.render(word, script, F.col("letter_case"), spelling)
    as_typed = F.coalesce("as_written", "piece")
    out = F.when(word.isNotNull(), F.when(tx.same_letters(shown, F.col("piece")), F.col("piece")).otherwise(shown)).otherwise(as_typed)
    parts = rows.select(key, F.struct("run_no", "piece_no", out.alias("out")).alias("p")).groupBy(key).agg(F.array_sort(F.collect_list("p")).alias("ps"))
    joined = parts.select(key, F.array_join("ps.out", "").alias("corrected"))
    return texts.select(key, "text").join(joined, key, "left").select(key, F.coalesce("corrected", "text").alias("corrected"))


def _context(queries: DataFrame, lex: DataFrame, users: DataFrame | None) -> DataFrame:
    """query_id, w1: the lexicon word that the previous word reads as, the literal reading first."""
    low = F.lower(tx.fold_confusables(F.col("prev")))
    forms = queries.select("query_id", *(["user"] if users is not None else []), low.alias("low"), tx.detect_script(low).alias("script")).where("low <> '' AND script <> 'mixed'")
    return valid_readings(forms, lex, users).where("valid IS NOT NULL").select("query_id", F.col("valid").alias("w1"))


def suggest(queries: DataFrame, lex: DataFrame, bigrams: DataFrame, n: int = 3, script: str = "new", users: DataFrame | None = None, recovery: bool = True) -> DataFrame:
    """query_id, rank, word, source for queries (query_id, buffer, prev, and user with `users`).

    Pools: all words of a key prefix if they are few, else the most frequent, with the strongest successors of
    the previous word and the user's own words; a typed word that is itself valid is always offered. Buffers of
    mixed script get nothing. Only prefixes that are asked for are looked up, each once.
    """
    own_keys = ["user"] if users is not None else []
    q = queries.withColumn("low", F.lower(tx.fold_confusables(F.coalesce("buffer", F.lit(""))))).withColumn("script", tx.detect_script(F.col("low")))
    q = q.withColumn("cyr", F.col("script") == "cyrillic").where("script <> 'mixed'")
    q = materialise(q.join(_context(q, lex, users), "query_id", "left"))  # read for the asked prefixes and for the scores
    keep = ["query_id", "buffer", "low", "cyr", "w1", *own_keys, "typed"]
    asked = q.select("*", F.explode(readings(F.col("low"), F.col("cyr"), recovery)).alias("r")).select("*", F.col("r.key").alias("prefix"), F.col("r.units").alias("typed"))
    wanted = asked.where("prefix <> ''").select("prefix").distinct()
    index = lex.select("word", "skeleton", "ln_uni", F.explode(F.sequence(F.lit(1), F.length("skeleton"))).alias("i"))
    index = materialise(index.withColumn("prefix", F.substr("skeleton", F.lit(1), F.col("i"))).drop("i").join(wanted, "prefix", "left_semi"))
    sizes = index.groupBy("prefix").agg(F.count("*").alias("size"))
    best = Window.partitionBy("prefix").orderBy(F.desc("ln_uni"), "skeleton", tx.utf8_order(F.col("word")))
    first = index.withColumn("r", F.row_number().over(best)).where(f"r <= {UNIGRAM_POOL}").select("prefix", "word")
    few = index.join(sizes.where(f"size <= {SCAN_ALL}"), "prefix", "left_semi").select("prefix", "word")
    pools = few.unionByName(first.join(sizes.where(f"size > {SCAN_ALL}"), "prefix", "left_semi"))
    pool = asked.join(pools, "prefix").select(*keep, "word")
    follow = bigrams.join(q.select("w1").distinct(), "w1", "left_semi").withColumn("r", F.row_number().over(Window.partitionBy("w1").orderBy(F.desc("ln_bi"), "w2"))).where(f"r <= {BIGRAM_POOL}")
    next_ = asked.join(follow.select("w1", F.col("w2").alias("word")), "w1").join(lex.select("word", "skeleton"), "word").where(F.startswith("skeleton", F.col("prefix")))
    both = pool.unionByName(next_.select(*keep, "word"))
    if users is not None:
        own = users.select("user", "word", F.explode(F.sequence(F.lit(1), F.length(tx.skeleton_key(F.col("word"))))).alias("i"))
        own = own.select("user", "word", F.substr(tx.skeleton_key(F.col("word")), F.lit(1), F.col("i")).alias("prefix"))
        both = both.unionByName(asked.join(own, ["user", "prefix"]).select(*keep, "word"))
    both = both.distinct().join(lex.select("word", "units", "ln_uni"), "word", "left").join(bigrams.withColumnRenamed("w2", "word"), ["w1", "word"], "left")
    if users is not None:
        both = both.join(users.select("user", "word", "bonus"), ["user", "word"], "left")
    bonus = F.coalesce(F.col("bonus"), F.lit(0.0)) if users is not None else F.lit(0.0)
    scored = both.withColumn("bonus", bonus).withColumn("e", evidence(F.col("typed"), F.coalesce("units", word_units(F.col("word"))), F.col("cyr")))
    literal = F.when(F.col("cyr"), tr.cyrillic_to_new(F.col("low"))).otherwise(tr.literal(F.col("low")))
    # of two valid readings the literal one is the typed word
    whole = F.when(F.col("word") == literal, 2).when(~F.col("cyr") & (F.col("word") == tr.old_to_new(F.col("low"))), 1).otherwise(0)
    scored = scored.withColumn("whole", whole).withColumn("score", F.coalesce("ln_uni", F.lit(0.0)) + LAMBDA * F.coalesce("ln_bi", F.lit(0.0)) + MU * F.col("bonus") + NU * F.col("e.sum"))
    scored = scored.groupBy("query_id", "buffer", "word", "ln_bi", "bonus", "whole").agg(F.max("score").alias("score"))
    by_query = Window.partitionBy("query_id")
    scored = scored.withColumn("exact", (F.col("whole") > 0) & (F.col("whole") == F.max("whole").over(by_query)))
    order = by_query.orderBy(F.desc("score"), tx.skeleton_key(F.col("word")), tx.utf8_order(F.col("word")))
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("exact") | (F.col("rank") <= n))
    ranked = ranked.withColumn("exact_rank", F.max(F.when(F.col("exact"), F.col("rank"))).over(by_query))
    kept = ranked.where(~F.coalesce((F.col("exact_rank") > n) & (F.col("rank") == n), F.lit(False))).withColumn("rank", F.least("rank", F.lit(n)))
    source = F.when(F.col("exact"), "exact").when(F.col("bonus") > 0, "user").when(F.col("ln_bi") > 0, "bigram").otherwise("lexicon")
    pattern = tx.case_pattern(F.coalesce("buffer", F.lit("")))
    return kept.select("query_id", "rank", tr.render(F.col("word"), script, F.when(pattern == "mixed", "lower").otherwise(pattern)).alias("word"), source.alias("source"))
