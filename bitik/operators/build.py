"""Test material made from the corpus and the lexicon: aligned scripts, sentence pools, typing variants, choice questions, outcomes of a correction.

Sampling is by the order of a hash of a seed and a key, so it is the same on every cluster and needs no shuffle of whole rows.
Null texts give no rows throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bitik.functions import text as tx, translit as tr
from bitik.functions.alphabet import OKINA, TUTUQ
from bitik.operators import corpus, variants as vr
from bitik.operators.lexicon import CAPITALIZED_SHARE, total

#: A sentence of the pool: characters and tokens.
SENTENCE_CHARS, SENTENCE_TOKENS = (30, 170), (5, 16)
QUOTES = '["«»“”]'
#: Count and share of capitals from which a form is taken for a foreign name.
FOREIGN_COUNT, FOREIGN_SHARE = 30, 0.8


def seeded(seed: int, *keys: Column) -> Column:
    """The place of a row in a seeded order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


# --- aligned scripts ---------------------------------------------------------------------------------------


def aligned_lines(latin: DataFrame, cyrillic: DataFrame, key: str) -> DataFrame:
    """Key, line_no, latin, cyrillic of the lines of two tables of (key, text), of texts with equally many lines."""
    a = latin.where("text <> ''").select(key, F.split("text", "\n").alias("a"))
    b = cyrillic.where("text <> ''").select(key, F.split("text", "\n").alias("b"))
    both = a.join(b, key).where("size(a) = size(b)")
    return both.select(key, F.posexplode(F.arrays_zip("a", "b")).alias("line_no", "l")).select(key, "line_no", F.col("l.a").alias("latin"), F.col("l.b").alias("cyrillic"))


def aligned_tokens(lines: DataFrame) -> DataFrame:
    """Cyrillic, latin, count of the tokens at equal places of lines with equally many tokens, in lower case."""
    low = lambda c: F.transform(tx.tokens_of(tx.blank_protected(tx.normalize(F.col(c)))), F.lower)
    pairs = lines.select(low("latin").alias("a"), low("cyrillic").alias("b")).where("size(a) = size(b)").select(F.explode(F.arrays_zip("a", "b")).alias("p"))
    kept = pairs.select(F.col("p.b").alias("cyrillic"), F.col("p.a").alias("latin")).groupBy("cyrillic", "latin").agg(F.count("*").alias("count"))
    return kept.where((tx.detect_script(F.col("latin")) == "latin") & (tx.detect_script(F.col("cyrillic")) == "cyrillic"))


def agreement(pairs: DataFrame) -> DataFrame:
    """Pairs, tokens and agreed: tokens whose two spellings the rules read as one word."""
    same = tr.cyrillic_rule(F.col("cyrillic")) == tr.old_to_new(F.col("latin"))
    return pairs.agg(F.count("*").alias("pairs"), F.coalesce(F.sum("count"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.when(same, F.col("count"))), F.lit(0)).alias("agreed"))


# --- sentences and how they are typed ------------------------------------------------------------------------


def sentence_pool(docs: DataFrame) -> DataFrame:
    """doc_id, doc_class, sent, sentence, tokens: plain sentences of moderate length of the documents that are kept."""
    stats = corpus.document_stats(docs).where("keep").select("doc_id", "doc_class")
    chunks = F.posexplode_outer(F.split(tx.blank_protected(tx.normalize(F.col("text"))), r"[.!?…\n]+")).alias("sent", "chunk")
    rows = corpus.scan(docs, "doc_id").select("doc_id", chunks).select("doc_id", "sent", F.trim("chunk").alias("sentence"))
    fit = rows.where(F.length("sentence").between(*SENTENCE_CHARS) & ~F.col("sentence").rlike(QUOTES))
    n = F.size(F.filter(tx.tokens_of(F.col("sentence")), lambda t: t != tx.GLUED))
    return fit.withColumn("tokens", n).where(F.col("tokens").between(*SENTENCE_TOKENS)).join(stats, "doc_id").select("doc_id", "doc_class", "sent", "sentence", "tokens")


def on_tokens(text: Column, change) -> Column:
    """The text with every token changed; protected runs and all other characters stay."""
    run = lambda r: F.array_join(F.transform(tx.segments_of(r), lambda p: F.when(tx.is_token(p), change(p)).otherwise(p)), "")
    return F.array_join(F.transform(tx.runs(text), lambda r: F.when(tx.is_protected_run(r), r).otherwise(run(r))), "")


def converted(text: Column, to: str, source: str = "old") -> Column:
    """The text with its tokens written in another script; nothing is corrected.

    A token in the script of `source` is read in it; tokens of the other script, of mixed case or script, and those beside
    a digit go by the rules of one token. The same script on both sides changes nothing.
    """
    if source == to:
        return text

    side = "cyrillic" if source == "cyrillic" else "latin"
    beside = lambda ps, i: F.get(ps, i - 1).rlike(f"{tx.DIGIT}$") | F.coalesce(F.get(ps, i + 1).rlike(f"^{tx.DIGIT}"), F.lit(False))

    def place(ps: Column, p: Column, i: Column) -> Column:
        token = tx.is_token(p)
        return F.struct(p.alias("p"), F.when(token, F.lower(tx.fold_confusables(p))).alias("low"), F.when(token, tx.letters_of(p)).alias("letters"), F.when(token, F.coalesce(beside(ps, i), F.lit(False))).alias("glued"))

    def known(x: Column) -> Column:
        return F.struct(x["p"].alias("p"), x["low"].alias("low"), x["glued"].alias("glued"), tx.case_of_letters(x["letters"]).alias("pattern"), tx.script_of_letters(F.lower(tx.fold_confusables(x["letters"]))).alias("kind"))

    def one(x: Column) -> Column:
        direct = (x["pattern"] != "mixed") & (x["kind"] == side) & ~x["glued"]
        read = tr.render(tr.canonical(x["low"], source), to, x["pattern"])
        return F.when(x["low"].isNull(), x["p"]).when(direct, read).otherwise(tr.rule_token(x["p"], to, "old" if source == "cyrillic" else source))

    def run(r: Column) -> Column:
        # every step is bound by a transform of its own, so that nothing is found twice for a piece
        facts = F.transform(F.array(tx.segments_of(r)), lambda ps: F.array_join(F.transform(F.transform(F.transform(ps, lambda p, i: place(ps, p, i)), known), one), ""))
        return F.get(facts, F.lit(0))

    return F.array_join(F.transform(tx.runs(text), lambda r: F.when(tx.is_protected_run(r), r).otherwise(run(r))), "")


def without_apostrophes(text: Column) -> Column:
    """P32."""
    return on_tokens(text, tx.strip_apostrophes)


def bare_sh(text: Column) -> Column:
    """Tokens typed with s for sh."""
    return on_tokens(text, lambda t: F.replace(F.replace(F.replace(t, F.lit("sh"), F.lit("s")), F.lit("Sh"), F.lit("S")), F.lit("SH"), F.lit("S")))


def highlighted(text: Column, change) -> Column:
    """The changed text as HTML, its marked letters set off in the tokens that differ."""
    marked = lambda p: F.when(change(p) == p, tx.html_escape(p)).otherwise(F.regexp_replace(tx.html_escape(change(p)), "[şçöğʼŞÇÖĞ]", "<mark>$0</mark>"))
    run = lambda r: F.array_join(F.transform(tx.segments_of(r), lambda p: F.when(tx.is_token(p), marked(p)).otherwise(tx.html_escape(p))), "")
    return F.array_join(F.transform(tx.runs(text), lambda r: F.when(tx.is_protected_run(r), tx.html_escape(r)).otherwise(run(r))), "")


# --- outcomes ---------------------------------------------------------------------------------------------


def outcomes(rows: DataFrame, *keys: str) -> DataFrame:
    """Correct, wrong, missed, kept tokens, misaligned texts and precision of (typed, output, expected), by the keys.

    Tokens are compared up to their kind of apostrophe. A token needs a change if neither it nor its rule
    conversion is the expected one; it is missed if the output is still one of these two.
    """
    toks = lambda c: F.filter(tx.tokens_of(tx.blank_protected(tx.normalize(F.col(c)))), lambda t: t != tx.GLUED)
    sized = rows.select(*keys, toks("typed").alias("typed"), toks("output").alias("output"), toks("expected").alias("expected"))
    aligned = (F.size("typed") == F.size("output")) & (F.size("typed") == F.size("expected"))
    same = lambda a, b: F.coalesce(tx.same_letters(a, b), F.lit(False))
    places = F.explode_outer(F.when(aligned, F.arrays_zip("typed", "output", "expected"))).alias("t")
    t = sized.select(*keys, aligned.alias("aligned"), F.size("typed").alias("n"), places).select(*keys, "aligned", "n", "t.*").withColumn("rule", tr.rule_token(F.col("typed"), "new"))
    typed, output, expected, rule = map(F.col, ("typed", "output", "expected", "rule"))
    right = same(typed, expected) | same(rule, expected)
    kind = (
        F.when(~F.col("aligned"), "misaligned")
        .when(typed.isNull(), None)
        .when(same(output, expected), F.when(right, "kept").otherwise("correct"))
        .when(same(output, typed) | same(output, rule), "missed")
        .otherwise("wrong")
    )
    counts = t.groupBy(*keys).agg(*[F.count_if(kind == k).alias(k) for k in ("correct", "wrong", "missed", "kept", "misaligned")])
    return counts.withColumn("precision", F.try_divide("correct", F.col("correct") + F.col("wrong")))


# --- lexicon reports and choice questions -----------------------------------------------------------------


def foreign_collisions(words: DataFrame, lite: DataFrame, least: int = FOREIGN_COUNT, share: float = FOREIGN_SHARE) -> DataFrame:
    """form, crawl, collides_with: capitalised words of the crawl outside the build whose skeleton is that of a common word in it."""
    titles = F.col("title") + F.col("lower")
    capital = lambda s: (titles > 0) & (F.col("title") >= s * titles)
    crawl = F.col("news") + F.col("telegram")
    forms = words.where((crawl >= least) & capital(share) & ~F.contains("word", F.lit(TUTUQ)) & (F.length("word") >= 3)).select("word", crawl.alias("crawl"), tx.skeleton_key(F.col("word")).alias("skeleton"))
    common = lite.where(~capital(CAPITALIZED_SHARE)).select(F.col("word").alias("g"), total().alias("g_total"), tx.skeleton_key(F.col("word")).alias("skeleton"))
    met = forms.join(lite.select("word"), "word", "left_anti").join(common, "skeleton").where("word <> g")
    return met.groupBy(F.col("word").alias("form"), "crawl").agg(F.min_by("g", F.struct(-F.col("g_total"), "g")).alias("collides_with"))


def most_common(rows: DataFrame, keys: list[str], item: str, count: str, k: int) -> DataFrame:
    """T5: the k most frequent items by key; of equals, the first by spelling. Each task keeps its own k before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc(count), item)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Question words of each category of choice questions: what is shown and which words it suits.
CATEGORIES = ("ascii2new", "old2new", "cyr2new", "apostrophe")


def choice_items(words: DataFrame, per_category: int, seed: int) -> DataFrame:
    """Q12: item_id, category, shown, options, answer: questions for the new spelling of a marked word shown in another way.

    Distractors are other spellings of the word that are no words themselves; a word with fewer than three gives no
    question. Words and the order of the options are drawn by a seeded hash; no word is used in two categories.
    """
    w = F.col("word")
    old, cyr = tr.new_to_old(w), tr.new_to_cyrillic(w)
    marked = words.select("word", total().alias("total")).where(w.rlike("[şçöğʼ]") & F.length(w).between(4, 12))
    draw = F.conv(F.substring(seeded(seed, w), 1, 4), 16, 10).cast("int") % 3
    plain = ~F.contains(w, F.lit(TUTUQ))
    category = F.when(~plain, "apostrophe").when(draw == 0, "ascii2new").when((draw == 1) & w.rlike("[öğ]"), "old2new").when(tr.cyrillic_to_new(cyr) == w, "cyr2new").otherwise("ascii2new")
    rows = marked.withColumn("category", category).withColumn("old", old).withColumn("cyr", cyr)
    shown = F.when(F.col("category") == "ascii2new", tx.ascii_form(w)).when(F.col("category") == "cyr2new", F.col("cyr")).otherwise(F.col("old"))
    first = F.when(F.col("category") == "apostrophe", F.array(F.replace(w, F.lit(TUTUQ), F.lit(OKINA)), F.replace(w, F.lit(TUTUQ), F.lit("")), F.replace(w, F.lit(TUTUQ), F.lit("’")))).otherwise(
        F.array(F.when(F.col("category") == "old2new", F.replace("old", F.lit(OKINA), F.lit(""))).otherwise(F.col("old")), tx.bare(w))
    )
    rows = rows.withColumn("shown", shown).withColumn("wrong", F.concat(first, vr.partial_variants(w)))
    places = rows.select("word", F.posexplode("wrong").alias("place", "v")).where("v <> word")
    free = places.join(words.select(F.col("word").alias("v")), "v", "left_anti").groupBy("word", "v").agg(F.min("place").alias("place"))
    # at most twice the letters of a word
    three = free.groupBy("word").agg(F.slice(F.array_sort(F.collect_list(F.struct("place", "v"))), 1, 3).alias("ds")).where("size(ds) = 3")
    asked = rows.join(three, "word").withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy(seeded(seed, w)))).where(F.col("r") <= per_category)
    mixed = F.array_sort(F.transform(F.concat(F.array(w), F.col("ds.v")), lambda o: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), w, o)).alias("h"), o.alias("o"))))
    asked = asked.withColumn("options", F.transform(mixed, lambda m: m["o"]))
    return asked.select(F.concat_ws("-", "category", F.lpad(F.col("r").cast("string"), 4, "0")).alias("item_id"), "category", "shown", "options", (F.array_position("options", w) - 1).cast("int").alias("answer"))


def parsed_answer(text: Column) -> Column:
    """The first A, B, C or D that stands alone in an answer, from 0; -1 if there is none."""
    letter = F.regexp_extract(F.upper(text), r"\b([ABCD])\b", 1)
    return F.coalesce(F.when(letter != "", F.ascii(letter) - 65), F.lit(-1)).cast("int")


def scored_answers(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Items and correct answers by category and in total for (item_id, answer_text); a missing answer is a wrong one."""
    met = items.where("answer IS NOT NULL").join(answers.select("item_id", parsed_answer(F.col("answer_text")).alias("given")), "item_id", "left")
    return met.rollup("category").agg(F.grouping("category").cast("int").alias("is_total"), F.count("*").alias("items"), F.count_if(F.coalesce(F.col("given") == F.col("answer"), F.lit(False))).alias("correct"))
