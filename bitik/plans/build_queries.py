"""Queries that make test material and reports, and the parts of the engine that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from bitik.functions import text as tx, translit as tr
from bitik.operators import build, corpus, correct, evidence as ev, lexicon as lx
from bitik.plans import corpus_queries as cq, engine_queries as eq, lexicon_queries as lq, sql as q, update_queries as uq
from bitik.session import materialise, spread, table

SEED, SAMPLE, PER_CATEGORY, TOP = 20_26, 200, 50, 20
GRID_NU, GRID_MIX = (0.0, 0.5, 1.0, 2.0), (0.0, 0.25, 0.5)


def _books(spark: SparkSession, sf_dir: str, split: str) -> DataFrame:
    """The books of one split by shard and place in it: one row for each, however many rows were delivered for a place."""
    rows = table(spark, sf_dir, "uz_books_v2").where((F.col("split") == split) & F.col("shard_idx").isNotNull())
    place = F.row_number().over(Window.partitionBy("shard_idx").orderBy("row_idx", "book_id"))
    return rows.select(F.concat_ws("/", F.col("shard_idx").cast("string"), place.cast("string")).alias("place"), "text")


def aligned_pairs(spark, sf_dir):
    """Words at equal places of the Latin and the Cyrillic books at equal places of a shard."""
    return build.aligned_tokens(build.aligned_lines(_books(spark, sf_dir, "lat"), _books(spark, sf_dir, "cyr"), "place"))


def rule_agreement(spark, sf_dir):
    """The Latin books beside their own conversion to Cyrillic: how many tokens read back as one word."""
    latin = _books(spark, sf_dir, "lat")
    cyrillic = uq.convert(latin, "place", "cyrillic").withColumnRenamed("converted", "text")
    return build.agreement(build.aligned_tokens(build.aligned_lines(latin, cyrillic, "place")))


def sentence_pool(spark, sf_dir):
    return build.sentence_pool(table(spark, sf_dir, "documents"))


def sampled_sentences(spark, sf_dir):
    """A seeded sample of the pool for each class of documents."""
    order = Window.partitionBy("doc_class").orderBy(build.seeded(SEED, F.col("doc_id"), F.col("sent")))
    return sentence_pool(spark, sf_dir).withColumn("r", F.row_number().over(order)).where(F.col("r") <= SAMPLE).select("doc_id", "sent", "doc_class", "sentence")


def typing_variants(spark, sf_dir):
    """Every update text without apostrophes, with s for sh, and on a Russian keyboard."""
    t = F.col("text")
    return spread(table(spark, sf_dir, "updates").select("update_id", "text")).select("update_id", build.without_apostrophes(t).alias("without_apostrophes"), build.bare_sh(t).alias("bare_sh"), tx.russian_layout(t).alias("russian_layout"))


def highlighted_texts(spark, sf_dir):
    """Every update text in new Latin as HTML with the changed letters set off."""
    return spread(table(spark, sf_dir, "updates").select("update_id", "text")).select("update_id", build.highlighted(F.col("text"), lambda p: tr.rule_token(p, "new")).alias("html"))


def foreign_collisions(spark, sf_dir):
    return build.foreign_collisions(lq._words(spark, sf_dir, True), lq._lite(spark, sf_dir))


def most_common_forms(spark, sf_dir):
    """T5: the most frequent word forms of each register."""
    forms = corpus.surfaces(table(spark, sf_dir, "documents"), "register")
    return build.most_common(forms, ["register"], "surface", "n", TOP).select("register", F.col("rank").cast("bigint").alias("rank"), "surface", "n")


def choice_items(spark, sf_dir):
    return build.choice_items(lq._merged(spark, sf_dir, True), PER_CATEGORY, SEED).withColumn("options", F.array_join("options", "|"))


def answer_scores(spark, sf_dir):
    """The rule converter's answers written as text, parsed and scored by item."""
    i = table(spark, sf_dir, "eval_items")
    low = F.lower(tx.fold_confusables(tx.quoted_word(F.col("question"))))
    at = F.array_position("options", F.when(tx.detect_script(low) == "cyrillic", tr.cyrillic_rule(low)).otherwise(tr.old_to_new(low)))
    said = F.when(at > 0, F.concat(F.lit("Javob: "), F.substr(F.lit("abcd"), at.cast("int"), F.lit(1)), F.lit(") deb oʻylayman"))).otherwise("bilmayman")
    return build.scored_answers(i.select("item_id", "category", "answer"), i.select("item_id", said.alias("answer_text")))


def lexicon_stats(spark, sf_dir):
    """Q5: words, letters, pairs and suffixes of the small build."""
    lite = materialise(lq._lite(spark, sf_dir))
    pairs = lx.build_bigrams(lq.merged_bigrams(spark, sf_dir), lite, lq.TOP_BIGRAMS).agg(F.count("*").alias("pairs"))
    return lite.agg(F.count("*").alias("words"), F.sum(F.length("word")).alias("letters"), F.count_distinct(tx.skeleton_key(F.col("word"))).alias("skeletons")).join(pairs)


def _plain_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """form, word, total, telegram and evidence: the plain-keyboard form of every marked word beside the words of its skeleton."""
    words = materialise(lx.build(lq._merged(spark, sf_dir), eq.SIZE))
    forms = words.where(tx.is_marked(F.col("word"))).select(F.col("word").alias("wanted"), tx.ascii_form(F.col("word")).alias("form"))
    forms = forms.withColumn("skeleton", tx.skeleton_key(F.col("form"))).withColumn("typed", ev.latin_units(F.col("form")))
    lex = words.select("word", lx.total().alias("total"), "telegram", tx.skeleton_key(F.col("word")).alias("skeleton"), ev.word_units(F.col("word")).alias("units"))
    met = forms.join(lex, "skeleton").withColumn("e", ev.evidence(F.col("typed"), F.col("units"), F.lit(False)))
    return met.select("wanted", "form", "word", "total", "telegram", F.col("e.sum").alias("sum"), F.col("e.min").alias("least"))


def candidate_evidence(spark, sf_dir):
    """The evidence of plain forms for every word of their skeleton."""
    return _plain_candidates(spark, sf_dir).select("form", "word", F.col("sum").cast("bigint").alias("sum"), F.col("least").cast("bigint").alias("least")).distinct()


def tuning_grid(spark, sf_dir):
    """Words that come back from their plain form, for every weight of the evidence and share of the informal register.

    Every candidate is scored for all settings inside its row.
    """
    rows = _plain_candidates(spark, sf_dir).where("least >= 0")
    grid = F.explode(F.array(*[F.struct(F.lit(nu).alias("nu"), F.lit(mix).alias("mix")) for nu in GRID_NU for mix in GRID_MIX])).alias("g")
    ln = F.log(F.greatest(F.lit(1), F.col("total")).cast("double"))
    informal = F.when(F.col("telegram") > 0, F.log(F.col("telegram").cast("double"))).otherwise(ln)
    score = F.round((1 - F.col("g.mix")) * ln + F.col("g.mix") * informal + F.col("g.nu") * F.col("sum"), 9)
    best = rows.select("wanted", "word", "sum", "total", "telegram", grid).select("wanted", "word", "g.nu", "g.mix", score.alias("score")).groupBy("nu", "mix", "wanted").agg(F.min_by("word", F.struct(-F.col("score"), "word")).alias("best"))
    return best.groupBy("nu", "mix").agg(F.count("*").alias("words"), F.count_if(F.expr("best = wanted")).alias("correct"))


def sentence_outcomes(spark, sf_dir):
    """The sampled sentences in new Latin, typed in three careless ways and corrected, against what was meant."""
    return build.outcomes(_careless(spark, sf_dir), "variant")


def golden_cases(spark, sf_dir):
    """Q11: sampled sentences whose careless typing the engine corrects to exactly what was meant."""
    return _careless(spark, sf_dir).where("output = expected AND typed <> expected").select("variant", "typed", "expected").distinct()


def _careless(spark: SparkSession, sf_dir: str) -> DataFrame:
    meant = uq.convert(sampled_sentences(spark, sf_dir).select(F.concat_ws("/", "doc_id", "sent").alias("place"), F.col("sentence").alias("text")), "place", "new")
    t = F.col("converted")
    ways = {"without_marks": tx.ascii_form(tx.normalize(t)), "one_letter_sh": F.translate(t, "şçöğʼŞÇÖĞ", "scogSCOG"), "as_meant": t}
    rows = materialise(meant.select("place", t.alias("expected"), F.explode(F.map_from_arrays(F.array(*map(F.lit, ways)), F.array(*ways.values()))).alias("variant", "typed")).withColumn("id", F.concat_ws("/", "place", "variant")))
    fixed = correct.autocorrect(rows.select("id", F.col("typed").alias("text")), *eq.parts(spark, sf_dir))
    return rows.join(fixed.withColumnRenamed("corrected", "output"), "id").select("variant", "typed", "output", "expected")


QUERIES = {
    f.__name__: f
    for f in (
        aligned_pairs, rule_agreement, sentence_pool, sampled_sentences, typing_variants, highlighted_texts, foreign_collisions, most_common_forms, choice_items, answer_scores, lexicon_stats, candidate_evidence, tuning_grid,
        sentence_outcomes, golden_cases,
    )
}

_PLACED = "(SELECT split, shard_idx || '/' || row_number() OVER (PARTITION BY split, shard_idx ORDER BY row_idx, book_id) AS place, text FROM uz_books_v2 WHERE split IN ('lat', 'cyr') AND shard_idx IS NOT NULL)"
_LINES = f"(SELECT split, place, line_no, line AS text FROM (SELECT split, place, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, len(string_split(text, chr(10))) AS n FROM {_PLACED} WHERE text <> '') WHERE (place, n) IN (SELECT place, n FROM (SELECT place, split, len(string_split(text, chr(10))) AS n FROM {_PLACED} WHERE text <> '') GROUP BY place, n HAVING count(DISTINCT split) = 2))"
_POOL = f"""{cq._DOCS}, counted AS (SELECT doc_id, sent, count(surface) AS tokens FROM toks GROUP BY 1, 2),
pool AS (SELECT c.doc_id, s.doc_class, CAST(c.sent AS INT) AS sent, trim(chunk, ' ') AS sentence, CAST(tokens AS INT) AS tokens FROM chunks c JOIN stats s ON s.doc_id = c.doc_id AND keep JOIN counted n ON n.doc_id = c.doc_id AND n.sent = c.sent
  WHERE length(trim(chunk, ' ')) BETWEEN 30 AND 170 AND NOT regexp_matches(chunk, '{build.QUOTES}') AND tokens BETWEEN 5 AND 16)"""


def _evidence(typed: str, word: str) -> str:
    """Sum and least of the evidence of a Latin form, by maps from pairs of units."""
    t = f"regexp_extract_all({q.literal(typed).replace('ʼ' * 10, '’' * 10)}, '[scg]’*h’*|[^’]’*')"
    w = f"regexp_extract_all(replace({word}, 'ʼ', '’'), '[scg]’*h’*|[^’]’*')"
    shows = [f"{a}>{b}" for a, bs in ev.SHOWN.items() for b in bs.split() if "+" not in b and "'" not in b]
    opens = [f"{a}>{b}" for a, b in ev.OPEN.items()]
    letter = f"CASE WHEN p || '>' || u IN {tuple(shows)} THEN 1 WHEN p || '>' || u IN {tuple(opens)} THEN 0 WHEN p IN {tuple(ev.OPEN)} THEN -1 ELSE 0 END"
    # plain forms have no apostrophes, so a tutuq of the word is never typed and never judged
    one = f"list_transform(range(1, len({t}) + 1), lambda i: list_transform([{{'u': ({t})[i], 'p': replace(({w})[i], '’', '')}}], lambda z: {letter.replace('p ||', 'z.p ||').replace('|| u', '|| z.u').replace('WHEN p IN', 'WHEN z.p IN')})[1])"
    return one


_FORMS = f"""{lq._ADM}, build AS (SELECT word, books + news + telegram AS total, telegram, {q.key('word')} AS skeleton FROM merged ORDER BY total DESC, word LIMIT {eq.SIZE}),
forms AS (SELECT word AS wanted, replace(replace(translate(word, 'öğʼ', 'og'), 'ş', 'sh'), 'ç', 'ch') AS form FROM build WHERE regexp_matches(word, '[şçöğʼ]')),
beside AS (SELECT wanted, form, word, total, telegram, {_evidence('form', 'word')} AS e FROM forms JOIN build ON skeleton = {q.key('form')}),
cands AS (SELECT wanted, form, word, total, telegram, CAST(list_sum(e) AS BIGINT) AS sum, CAST(least(0, list_min(e)) AS BIGINT) AS least FROM beside)"""
_MD5 = f"md5(concat_ws('|', '{SEED}', {{}}))"
ORACLE_SQL = {
    "aligned_pairs": f"""WITH {q.tokens(_LINES, 'place, line_no, split')},
      rows AS (SELECT place, line_no, split, pos, lower(surface) AS w, count(*) OVER (PARTITION BY place, line_no, split) AS n FROM toks)
      SELECT c.w AS cyrillic, l.w AS latin, count(*) AS "count" FROM (SELECT place, line_no, n, w, row_number() OVER (PARTITION BY place, line_no ORDER BY sent, pos) AS r FROM (SELECT rows.*, sent FROM rows JOIN toks USING (place, line_no, split, pos)) WHERE split = 'lat') l
      JOIN (SELECT place, line_no, n, w, row_number() OVER (PARTITION BY place, line_no ORDER BY sent, pos) AS r FROM (SELECT rows.*, sent FROM rows JOIN toks USING (place, line_no, split, pos)) WHERE split = 'cyr') c USING (place, line_no, n, r)
      WHERE {q.script('l.w')} = 'latin' AND {q.script('c.w')} = 'cyrillic' GROUP BY 1, 2""",
    "sentence_pool": f"{_POOL} SELECT * FROM pool",
    "sampled_sentences": f"{_POOL} SELECT doc_id, sent, doc_class, sentence FROM (SELECT *, row_number() OVER (PARTITION BY doc_class ORDER BY {_MD5.format('CAST(doc_id AS VARCHAR), CAST(sent AS VARCHAR)')}) AS r FROM pool) WHERE r <= {SAMPLE}",
    "foreign_collisions": f"""{lq._FULL}, uni_only AS (SELECT word, {lq._COUNT} FROM unigrams WHERE trim(word) <> '' GROUP BY word), {lq._admit('uni_only').replace('judged', 'j2').replace('tops', 't2').replace('ruled', 'r2').replace('merges', 'm2').replace('adm AS', 'adm2 AS').replace('FROM adm ', 'FROM adm2 ').replace('merged AS', 'merged2 AS')},
      lite AS (SELECT *, books + news + telegram AS total FROM merged2 ORDER BY total DESC, word LIMIT {lq.LITE}),
      f AS (SELECT word, news + telegram AS crawl FROM words WHERE news + telegram >= {build.FOREIGN_COUNT} AND title + lower > 0 AND title >= {build.FOREIGN_SHARE} * (title + lower) AND NOT contains(word, 'ʼ') AND length(word) >= 3 AND word NOT IN (SELECT word FROM lite))
      SELECT f.word AS form, crawl, arg_min(g.word, (-total, g.word)) AS collides_with FROM f JOIN lite g ON {q.key('g.word')} = {q.key('f.word')} AND g.word <> f.word WHERE NOT (title + lower > 0 AND title >= 0.9 * (title + lower)) GROUP BY 1, 2""",
    "most_common_forms": f"{cq._TOKS}, c AS (SELECT register, surface, count(*) AS n FROM toks WHERE surface IS NOT NULL GROUP BY 1, 2) SELECT register, rank, surface, n FROM (SELECT *, row_number() OVER (PARTITION BY register ORDER BY n DESC, surface) AS rank FROM c) WHERE rank <= {TOP}",
    "choice_items": f"""{lq._FULL}, m AS (SELECT word, {_MD5.format('word')} AS h, {q.new_to_old('word')} AS old, {q.new_to_cyrillic('word')} AS cyr FROM merged WHERE regexp_matches(word, '[şçöğʼ]') AND length(word) BETWEEN 4 AND 12),
      d AS (SELECT *, CAST('0x' || h[1:4] AS INT) % 3 AS draw, {q.cyrillic_to_new('cyr')} AS back FROM m),
      c AS (SELECT *, CASE WHEN contains(word, 'ʼ') THEN 'apostrophe' WHEN draw = 0 THEN 'ascii2new' WHEN draw = 1 AND regexp_matches(word, '[öğ]') THEN 'old2new' WHEN back = word THEN 'cyr2new' ELSE 'ascii2new' END AS category FROM d),
      s AS (SELECT word, h, category, CASE category WHEN 'ascii2new' THEN replace(replace(translate(word, 'öğʼ', 'og'), 'ş', 'sh'), 'ç', 'ch') WHEN 'cyr2new' THEN cyr ELSE old END AS shown,
        list_concat(CASE WHEN category = 'apostrophe' THEN [replace(word, 'ʼ', 'ʻ'), replace(word, 'ʼ', ''), replace(word, 'ʼ', '’')] ELSE [CASE WHEN category = 'old2new' THEN replace(old, 'ʻ', '') ELSE old END, translate(word, 'şçöğʼ', 'scog')] END, {lq._PARTIAL}) AS wrong FROM c),
      v AS (SELECT word, v, min(i) AS i FROM (SELECT word, unnest(wrong) AS v, generate_subscripts(wrong, 1) AS i FROM s) WHERE v <> word AND v NOT IN (SELECT word FROM merged) GROUP BY 1, 2),
      t AS (SELECT word, list(v ORDER BY i)[1:3] AS ds FROM v GROUP BY word HAVING count(*) >= 3),
      a AS (SELECT s.*, ds, row_number() OVER (PARTITION BY category ORDER BY h) AS r FROM s JOIN t USING (word)),
      o AS (SELECT category, r, shown, word, (SELECT list(o ORDER BY md5(concat_ws('|', '{SEED}', word, o))) FROM (SELECT unnest(list_concat([word], ds)) AS o)) AS options FROM a WHERE r <= {PER_CATEGORY})
      SELECT category || '-' || lpad(CAST(r AS VARCHAR), 4, '0') AS item_id, category, shown, array_to_string(options, '|') AS options, CAST(list_position(options, word) - 1 AS INT) AS answer FROM o""",
    "answer_scores": uq.ORACLE_SQL["eval_scores"],
    "lexicon_stats": f"{lq._RANKS}, {lq._DIRECTED} SELECT (SELECT count(*) FROM lite) AS words, (SELECT CAST(sum(length(word)) AS BIGINT) FROM lite) AS letters, (SELECT count(DISTINCT {q.key('word')}) FROM lite) AS skeletons, (SELECT least({lq.TOP_BIGRAMS}, count(*)) FROM pairs JOIN lite a ON a.word = w1 JOIN lite b ON b.word = w2) AS pairs",
    "candidate_evidence": f"{_FORMS} SELECT DISTINCT form, word, sum, least FROM cands",
    "tuning_grid": f"""{_FORMS}, g AS (SELECT nu, mix FROM (SELECT unnest({list(GRID_NU)}) AS nu), (SELECT unnest({list(GRID_MIX)}) AS mix)),
      s AS (SELECT nu, mix, wanted, word, round((1 - mix) * ln(greatest(1, total)) + mix * CASE WHEN telegram > 0 THEN ln(telegram) ELSE ln(greatest(1, total)) END + nu * sum, 9) AS score FROM cands, g WHERE least >= 0),
      b AS (SELECT nu, mix, wanted, arg_min(word, (-score, word)) AS best FROM s GROUP BY 1, 2, 3) SELECT CAST(nu AS DOUBLE) AS nu, CAST(mix AS DOUBLE) AS mix, count(*) AS words, count(*) FILTER (best = wanted) AS correct FROM b GROUP BY 1, 2""",
}
