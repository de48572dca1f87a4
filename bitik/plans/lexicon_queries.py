"""Lexicon queries over the unigrams and bigrams tables, with held-out text from documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from bitik.functions import text as tx, translit as tr
from bitik.operators import corpus, lexicon as lx, variants as vr
from bitik.plans import corpus_queries as cq, sql as q
from bitik.session import materialise, table

#: Words and pairs of the smallest build, stems of a suffix, and the sizes the published pairs may have.
LITE, TOP_BIGRAMS, MIN_STEMS = 50_000, 200_000, 4
CAPS = (10_000, 100_000, 1_000_000, lx.SIZE_CAP)
#: Steps and bytes of the build grid.
WORD_STEPS, PAIR_STEPS, BUDGET = [50, 100, 200, 1_000, 10_000, 50_000, 400_000], [1_000, 10_000, 200_000, 2_000_000], 30_000


def _words(spark: SparkSession, sf_dir: str, corpus_too: bool = False) -> DataFrame:
    """The delivered word counts, with those of the documents added on demand."""
    rows = table(spark, sf_dir, "unigrams")
    if corpus_too:
        rows = rows.unionByName(corpus.unigrams(table(spark, sf_dir, "documents")))
        return materialise(lx.word_table(rows))  # read by every join of the admission
    return lx.word_table(rows)


def _admitted(spark: SparkSession, sf_dir: str, corpus_too: bool = False) -> DataFrame:
    return lx.admission(_words(spark, sf_dir, corpus_too))


def _merged(spark: SparkSession, sf_dir: str, corpus_too: bool = False) -> DataFrame:
    return lx.merged_counts(_admitted(spark, sf_dir, corpus_too))


def _lite(spark: SparkSession, sf_dir: str, by: str = "total") -> DataFrame:
    return lx.build(_merged(spark, sf_dir), LITE, by)


def _lexicon(spark: SparkSession, sf_dir: str, corpus_too: bool = True) -> DataFrame:
    """Merged words with their skeleton."""
    return _merged(spark, sf_dir, corpus_too).withColumn("skeleton", tx.skeleton_key(F.col("word")))


def admission(spark, sf_dir):
    return _admitted(spark, sf_dir, True).select("word", "skeleton", "admitted", "reason", "merged_into")


def rejections(spark, sf_dir):
    return lx.rejections(_admitted(spark, sf_dir, True))


def merged_counts(spark, sf_dir):
    return _merged(spark, sf_dir, True).drop("protected")


def lexicon_topk(spark, sf_dir):
    """The build by total count with ranks."""
    return _lite(spark, sf_dir).select("word", "rank", lx.total().alias("total"))


def lexicon_by_crawl(spark, sf_dir):
    return _lite(spark, sf_dir, "crawl").select("word", "rank", (F.col("news") + F.col("telegram")).alias("crawl"))


PROTECTED = ("novvoyxona", "qoyvor", "kelasizmi")


def protected_words(spark, sf_dir):
    """Protected words enter a build whatever their count."""
    listed = spark.createDataFrame([(w,) for w in PROTECTED], "word string")
    return lx.build(lx.merged_counts(lx.admission(_words(spark, sf_dir), listed)), LITE).select("word", "rank", "protected")


def lexicon_diff(spark, sf_dir):
    """Words gained and lost between the two rankings."""
    a, b = _lite(spark, sf_dir).select("word"), _lite(spark, sf_dir, "crawl").select("word")
    return b.exceptAll(a).withColumn("change", F.lit("gained")).unionByName(a.exceptAll(b).withColumn("change", F.lit("lost")))


def quantised(spark, sf_dir):
    return lx.packed(_merged(spark, sf_dir)).select("word", "skeleton", "uni_q", "inf_q", "capitalized")


def packed_order(spark, sf_dir):
    """Ids of the packed lexicon: skeletons in byte order, then words with marked letters after plain ones."""
    from pyspark.sql import Window

    lite = _lite(spark, sf_dir)  # at most LITE rows
    order = Window.orderBy(tx.skeleton_key(F.col("word")), tx.utf8_order(F.col("word")))
    return lite.select("word", (F.row_number().over(order).cast("bigint") - 1).alias("id"))


def directed_bigrams(spark, sf_dir):
    return lx.bigram_table(table(spark, sf_dir, "bigrams"))


def merged_bigrams(spark, sf_dir):
    return lx.merged_bigrams(directed_bigrams(spark, sf_dir), _admitted(spark, sf_dir))


def lexicon_bigrams(spark, sf_dir):
    return lx.build_bigrams(merged_bigrams(spark, sf_dir), _lite(spark, sf_dir), TOP_BIGRAMS)


def bigram_adjacency(spark, sf_dir):
    return lx.adjacency(merged_bigrams(spark, sf_dir))


def adjacency_offsets(spark, sf_dir):
    return lx.offsets(bigram_adjacency(spark, sf_dir))


def size_cutoff(spark, sf_dir):
    """A15 at the production size and at smaller ones."""
    pairs = materialise(merged_bigrams(spark, sf_dir))
    found = [lx.size_cutoff(pairs, ["w1", "w2"], cap).select(F.lit(cap).cast("bigint").alias("cap"), "*") for cap in CAPS]
    return reduce(DataFrame.unionByName, found)


def size_grid(spark, sf_dir):
    """T4: builds of several sizes against a byte budget."""
    words = materialise(lx.build(_merged(spark, sf_dir), WORD_STEPS[-1]))
    ranks = words.select("word", "rank")
    pairs = lx.build_bigrams(merged_bigrams(spark, sf_dir), ranks, PAIR_STEPS[-1])
    return lx.size_grid(ranks, pairs, WORD_STEPS, PAIR_STEPS, BUDGET)


def suffix_chains(spark, sf_dir):
    words = _merged(spark, sf_dir, True).select("word", lx.total().alias("n"))
    return lx.suffix_chains(words, 50, 5, MIN_STEMS)


def _held(spark, sf_dir):
    """Canonical words of held-out news and telegram documents."""
    docs = table(spark, sf_dir, "documents").where("register IN ('news', 'telegram')").where(tx.heldout(F.col("text")))
    forms = corpus.analysed(corpus.surfaces(docs, "register")).where("kind = 'word'")
    return forms.groupBy(F.col("canon").alias("word"), "register", "letter_case").agg(F.sum("n").alias("n"))


def heldout_subtraction(spark, sf_dir):
    return lx.subtract(_words(spark, sf_dir), _held(spark, sf_dir))


def coverage(spark, sf_dir):
    words = _merged(spark, sf_dir).select("word", lx.total().alias("n"))
    out = lx.coverage(_held(spark, sf_dir), _lite(spark, sf_dir), lx.suffix_chains(words, 50, 5, 1))
    return out.select("register", "tokens", *[F.round(c, 6).alias(c) for c in ("in_lexicon", "skeleton_match", "stem_plus_suffix")])


def transliterations(spark, sf_dir):
    """Every word in old Latin and Cyrillic, and both read back."""
    w = F.col("word")
    out = _words(spark, sf_dir).select("word", tr.new_to_old(w).alias("old"), tr.new_to_cyrillic(w).alias("cyrillic"))
    return out.select("word", "old", "cyrillic", tr.old_to_new(F.col("old")).alias("from_old"), tr.cyrillic_to_new(F.col("cyrillic")).alias("from_cyrillic"), tx.bare(w).alias("bare"), tx.ascii_form(w).alias("ascii"), tx.is_marked(w).alias("marked"))


def round_trips(spark, sf_dir):
    """Round trips over the lexicon: words and those that come back unchanged, by script."""
    t = transliterations(spark, sf_dir)
    return t.agg(F.count("*").alias("words"), F.count_if(F.expr("word = from_old")).alias("old_ok"), F.count_if(F.expr("word = from_cyrillic")).alias("cyrillic_ok"))


def stripped_variants(spark, sf_dir):
    return vr.stripped_pairs(_lexicon(spark, sf_dir))


def partial_mark_forms(spark, sf_dir):
    """Marked words with a far more frequent, fully marked sibling."""
    return vr.stripped_pairs(_lexicon(spark, sf_dir)).where(tx.is_marked(F.col("word")) & (F.col("source_total") >= vr.DOMINANCE * F.col("total")))


def ambiguity_groups(spark, sf_dir):
    return vr.ambiguous(_lexicon(spark, sf_dir))


def spelling_variants(spark, sf_dir):
    """How many keyboard and partial variants each word has, and the first of each."""
    w = F.col("word")
    v = _words(spark, sf_dir).select("word", vr.keyboard_variants(w).alias("k"), vr.partial_variants(w).alias("p"))
    return v.select("word", F.size("k").cast("bigint").alias("keyboard"), F.get("k", F.lit(0)).alias("first_keyboard"), F.size("p").cast("bigint").alias("partial"), F.get("p", F.lit(0)).alias("first_partial"))


def keyboard_whatif(spark, sf_dir):
    return vr.keyboard_whatif(_lexicon(spark, sf_dir))


def spelling_cost(spark, sf_dir):
    tokens = cq.class_unigrams(spark, sf_dir).select("doc_class", "word", F.col("count").alias("n"))
    return vr.spelling_cost(tokens, _lexicon(spark, sf_dir))


def _risk(spark, sf_dir):
    forms = corpus.analysed(corpus.surfaces(table(spark, sf_dir, "documents").where("register = 'telegram'"))).where("kind = 'word' AND n >= 2")
    return vr.risk_split(forms.select("surface", "canon", "n"), _lexicon(spark, sf_dir))


def risk_forms(spark, sf_dir):
    return _risk(spark, sf_dir).select("surface", "n", "hits")


def veto_whatif(spark, sf_dir):
    """Forms at risk whose best hit drops a mark that the typed form spells out."""
    risk = _risk(spark, sf_dir).where("hits <> ''")
    cyr = tx.detect_script(F.lower("surface")) == "cyrillic"
    vetoed = vr.contradicts(F.col("canon"), F.get(F.split("hits", " "), F.lit(0)), cyr)
    return risk.groupBy(vetoed.alias("vetoed")).agg(F.count("*").alias("forms"), F.sum("n").alias("tokens"))


def prefix_completions(spark, sf_dir):
    """The five most frequent words of every skeleton prefix."""
    from pyspark.sql import Window

    index = lx.prefixes(_lexicon(spark, sf_dir, False).select("word", "skeleton", lx.total().alias("total")))
    ranked = index.withColumn("rank", F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("total"), "word")))
    return ranked.where("rank <= 5").select("prefix", F.col("rank").cast("bigint").alias("rank"), "word")


def next_word(spark, sf_dir):
    """The three most frequent successors of every word."""
    from pyspark.sql import Window

    ranked = merged_bigrams(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("w1").orderBy(F.desc("count"), "w2")))
    return ranked.where("rank <= 3").select("w1", F.col("rank").cast("bigint").alias("rank"), "w2", "count")


QUERIES = {
    f.__name__: f
    for f in (
        admission, rejections, merged_counts, lexicon_topk, lexicon_by_crawl, protected_words, lexicon_diff, quantised, packed_order, directed_bigrams, merged_bigrams, lexicon_bigrams, bigram_adjacency, adjacency_offsets, size_cutoff, size_grid,
        suffix_chains, heldout_subtraction, coverage, transliterations, round_trips, stripped_variants, partial_mark_forms, ambiguity_groups, spelling_variants, keyboard_whatif, spelling_cost, risk_forms, veto_whatif, prefix_completions, next_word,
    )
}

_COUNT = ", ".join(f"CAST(sum(coalesce({c}, 0)) AS BIGINT) AS {c}" for c in lx.COUNTS)
_WORDS = f"words AS (SELECT word, {_COUNT} FROM unigrams WHERE trim(word) <> '' GROUP BY word)"


def _admit(words: str = "words", listed: str = "") -> str:
    prot = f"word IN ({listed})" if listed else "false"
    return f"""
judged AS (SELECT *, {q.key('word')} AS skeleton, {prot} AS protected, CASE WHEN length(translate(word, '{q._APOS}', '')) < 2 AND word NOT IN ('u', 'o', 'e', 'a') THEN 'shorter-than-2'
  WHEN NOT regexp_full_match(word, '[a-zşçöğʼ]{{1,255}}') THEN 'not-packable' WHEN regexp_matches(word, '[şçöğʼ]') THEN CASE WHEN books + news + telegram < 2 THEN 'rare' END
  WHEN books < 2 THEN 'unmarked-not-in-books' END AS r1 FROM {words}),
tops AS (SELECT w.word, max(g.books) AS top FROM judged w JOIN judged g ON g.skeleton = w.skeleton AND g.word <> w.word WHERE w.r1 IS NULL AND g.r1 IS NULL AND {q.stripped_from('g.word', 'w.word')} GROUP BY w.word),
ruled AS (SELECT j.*, CASE WHEN protected THEN NULL WHEN r1 IS NULL AND books < 0.01 * top THEN 'stripped-variant-below-ratio' ELSE r1 END AS reason FROM judged j LEFT JOIN tops USING (word)),
merges AS (SELECT w.word, arg_min(g.word, (-(g.books + g.news + g.telegram), g.word)) AS merged_into FROM ruled w JOIN ruled g ON g.skeleton = w.skeleton AND g.word <> w.word WHERE w.reason IS NOT NULL AND g.reason IS NULL AND {q.stripped_from('g.word', 'w.word')} GROUP BY w.word),
adm AS (SELECT r.*, reason IS NULL AS admitted, merged_into FROM ruled r LEFT JOIN merges USING (word)),
merged AS (SELECT coalesce(merged_into, word) AS word, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in lx.COUNTS)}, bool_or(protected) AS protected FROM adm WHERE admitted OR merged_into IS NOT NULL GROUP BY 1)"""


_ADM = f"WITH {_WORDS}, {_admit()}"
_FULL = f"{cq._UNI}, every AS (SELECT word, books, news, telegram, title, lower FROM unigrams UNION ALL SELECT word, books, news, telegram, title, lower FROM uni), words AS (SELECT word, {_COUNT} FROM every WHERE trim(word) <> '' GROUP BY word), {_admit()}"
_FULL_LEX = f"{_FULL}, lex AS (SELECT *, books + news + telegram AS total, {q.key('word')} AS skeleton FROM merged)"
_LEX = f"{_ADM}, lex AS (SELECT *, books + news + telegram AS total, {q.key('word')} AS skeleton FROM merged)"
_RANKS = f"""{_ADM}, ranked AS (SELECT *, row_number() OVER (ORDER BY books + news + telegram DESC, word) - 1 AS rank, row_number() OVER (ORDER BY news + telegram DESC, books + news + telegram DESC, word) - 1 AS crawl_rank FROM merged),
lite AS (SELECT * FROM ranked WHERE rank < {LITE})"""
_DIRECTED = f"""valid AS (SELECT row_id, translate(lower(trim(w1)), '{q._APOS}', 'ʼʼʼʼʼʼʼʼʼʼ') AS w1, translate(lower(trim(w2)), '{q._APOS}', 'ʼʼʼʼʼʼʼʼʼʼ') AS w2, CAST("count" AS BIGINT) AS c FROM bigrams),
once AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY w1, w2, c) AS r FROM valid WHERE w1 <> '' AND w2 <> '' AND c >= 1),
directed AS (SELECT w1, w2, CAST(sum(c) AS BIGINT) AS "count" FROM once WHERE r = 1 OR row_id IS NULL GROUP BY w1, w2),
pairs AS (SELECT coalesce(a.merged_into, a.word) AS w1, coalesce(b.merged_into, b.word) AS w2, CAST(sum("count") AS BIGINT) AS "count" FROM directed d
  JOIN adm a ON a.word = d.w1 JOIN adm b ON b.word = d.w2 WHERE "count" >= 3 AND (a.admitted OR a.merged_into IS NOT NULL) AND (b.admitted OR b.merged_into IS NOT NULL) GROUP BY 1, 2)"""
_CHAINS = f"""chains AS (SELECT suffix, count(*) AS stems FROM (SELECT word[1:i] AS stem, word[i + 1:] AS suffix FROM (SELECT word, unnest(range(1, length(word))) AS i FROM merged WHERE books + news + telegram >= 5))
  WHERE suffix[1:1] <> 'ʼ' AND length(replace(suffix, 'ʼ', '')) BETWEEN 2 AND 12 AND stem IN (SELECT word FROM merged WHERE books + news + telegram >= 50 AND length(replace(word, 'ʼ', '')) >= 3) GROUP BY suffix HAVING count(*) >= {MIN_STEMS})"""
_SHA = "list_sum(list_transform(range(1, 41), lambda i: (instr('0123456789abcdef', sha1(text)[i:i]) - 1) * CASE WHEN i = 40 THEN 1 ELSE 6 END)) % 10 = 0"
_HELD = f"{q.tokens(where=f'''text <> '' AND register IN ('news', 'telegram') AND {_SHA}''')}, {q.analysed()}, held AS (SELECT canon AS word, register, letter_case, count(*) AS n FROM toks JOIN forms USING (surface) WHERE canon IS NOT NULL GROUP BY 1, 2, 3)"


def _spellings(pairs: dict[str, str]) -> str:
    """All spellings of word, letter by letter."""
    case = " ".join(f"WHEN '{a}' THEN ['{a}', '{b}']" for a, b in pairs.items())
    return f"list_reduce(list_transform(regexp_extract_all(word, '(?s:.)'), lambda c: CASE c {case} ELSE [c] END), lambda a, o: list_transform(flatten(list_transform(a, lambda p: list_transform(o, lambda x: p || x))), lambda z: z))"


_KB = {"u": "ö", "k": "q", "x": "h", "o": "ö", "g": "ğ", "s": "ş", "c": "ç"}
_KEYBOARD = f"""(CASE WHEN length(regexp_replace(word, '[^ukxogsc]', '', 'g')) <= 9 THEN list_sort(list_filter({_spellings(_KB)}, lambda v: len(list_filter(range(1, length(word) + 1), lambda i: word[i:i] IN ('u', 'k', 'x') AND word[i:i] <> v[i:i])) > 0)) ELSE [] END)"""
_LAYOUT = f"(CASE WHEN length(regexp_replace(word, '[^uokxg]', '', 'g')) <= 8 THEN list_filter({_spellings({'u': 'ö', 'o': 'ö', 'k': 'q', 'x': 'h', 'g': 'ğ'})}, lambda v: v <> word) ELSE [] END)"
_PARTIAL = """list_sort(list_distinct(list_filter(flatten(list_transform(range(1, length(word) + 1), lambda i: [word[1:i - 1] || translate(word[i:i], 'şçöğʼ', 'scog') || word[i + 1:], word[1:i - 1] || translate(word[i:i], 'scog', 'şçöğ') || word[i + 1:]])), lambda v: v <> word)))"""
_CLASS = cq.ORACLE_SQL["class_unigrams"]
_COST = f"""{_FULL}, cls AS ({_CLASS}), lex AS (SELECT word, books + news + telegram AS total, {q.key('word')} AS skeleton FROM merged),
cand AS (SELECT doc_class, c.word, "count" AS n, l.total FROM (SELECT *, {q.key('word')} AS skeleton FROM cls WHERE doc_class = 'latin_bare') c JOIN lex l ON l.skeleton = c.skeleton AND l.word <> c.word AND {q.stripped_from('l.word', 'c.word')}
  UNION ALL SELECT doc_class, c.word, n, l.total FROM (SELECT doc_class, word, "count" AS n, unnest({_LAYOUT}) AS v FROM cls WHERE doc_class = 'cyr_ru_layout') c JOIN lex l ON l.word = c.v),
best AS (SELECT doc_class, word, n, max(total) AS best FROM cand GROUP BY 1, 2, 3)
SELECT doc_class, CAST(coalesce(sum(n) FILTER (best >= 10 * total), 0) AS BIGINT) AS blocked, CAST(coalesce(sum(n) FILTER (total IS NULL), 0) AS BIGINT) AS corrected FROM best LEFT JOIN lex USING (word) GROUP BY 1"""
# the corpus of the lexicon is all documents, that of the informal forms those of one register
_RISK = f"""{_FULL_LEX}, tele AS (SELECT surface, canon, count(*) AS n FROM full_toks WHERE register = 'telegram' AND canon IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2),
unknown AS (SELECT *, lower(translate(surface, '{q.FOLD_FROM}', '{q.FOLD_TO}')) AS low, {q.script('lower(surface)')} = 'cyrillic' AS cyr FROM tele WHERE canon NOT IN (SELECT word FROM lex)),
keys AS (SELECT DISTINCT surface, {q.key('r')} AS skeleton FROM (SELECT surface, unnest(CASE WHEN cyr THEN {q.readings('low')} ELSE [low] END) AS r FROM unknown)),
ranked AS (SELECT surface, word, row_number() OVER (PARTITION BY surface ORDER BY total DESC, word) AS r FROM (SELECT DISTINCT surface, word, total FROM keys JOIN lex USING (skeleton))),
risk AS (SELECT u.surface, canon, n, cyr, coalesce(hits, '') AS hits FROM unknown u LEFT JOIN (SELECT surface, string_agg(word, ' ' ORDER BY r) AS hits FROM ranked WHERE r <= 3 GROUP BY surface) USING (surface))"""
_VETO = f"""{_RISK}, two AS (SELECT *, replace(canon, 'ʼ', '') AS r, replace(hit, 'ʼ', '') AS c FROM (SELECT *, string_split(hits, ' ')[1] AS hit FROM risk WHERE hits <> '')),
flags AS (SELECT n, length(r) = length(c) AND (len(list_filter(range(1, length(r) + 1), lambda i: (regexp_matches(r[i:i], '[şçöğ]') AND translate(r[i:i], 'şçöğ', 'scog') = c[i:i]) OR (cyr AND r[i:i] = 's' AND c[i:i] = 'ş'))) > 0
  OR length(canon) - length(r) > length(hit) - length(c)) AS vetoed FROM two)
SELECT vetoed, count(*) AS forms, CAST(sum(n) AS BIGINT) AS tokens FROM flags GROUP BY vetoed"""
ORACLE_SQL = {
    "risk_forms": f"{_RISK} SELECT surface, n, hits FROM risk",
    "veto_whatif": _VETO,
    "admission": f"{_FULL} SELECT word, skeleton, admitted, reason, merged_into FROM adm",
    "rejections": f"{_FULL} SELECT reason, count(*) AS forms, count(merged_into) AS merged, CAST(sum(books + news + telegram) AS BIGINT) AS mass, CAST(coalesce(sum(books + news + telegram) FILTER (merged_into IS NOT NULL), 0) AS BIGINT) AS merged_mass FROM adm WHERE NOT admitted GROUP BY reason",
    "merged_counts": f"{_FULL} SELECT word, books, news, telegram, title, lower FROM merged",
    "lexicon_topk": f"{_RANKS} SELECT word, rank, books + news + telegram AS total FROM lite",
    "lexicon_by_crawl": f"{_RANKS} SELECT word, crawl_rank AS rank, news + telegram AS crawl FROM ranked WHERE crawl_rank < {LITE}",
    "protected_words": f"""WITH {_WORDS}, extra AS (SELECT * FROM words UNION ALL SELECT w, 0, 0, 0, 0, 0 FROM (SELECT unnest({list(PROTECTED)}) AS w) WHERE w NOT IN (SELECT word FROM words)), {_admit('extra', str(list(PROTECTED))[1:-1])},
      r AS (SELECT *, row_number() OVER (ORDER BY books + news + telegram DESC, word) AS r FROM merged), kept AS (SELECT * FROM r WHERE protected UNION ALL SELECT * FROM (SELECT * FROM r WHERE NOT protected ORDER BY r LIMIT {LITE} - (SELECT count(*) FROM r WHERE protected)))
      SELECT word, row_number() OVER (ORDER BY r) - 1 AS rank, protected FROM kept""",
    "lexicon_diff": f"{_RANKS} SELECT word, CASE WHEN rank >= {LITE} THEN 'gained' ELSE 'lost' END AS change FROM ranked WHERE (rank < {LITE}) <> (crawl_rank < {LITE})",
    "quantised": f"""{_LEX}, scale AS (SELECT max(total) AS a, max(telegram) AS b FROM lex) SELECT word, skeleton,
      CASE WHEN total > 0 THEN CAST(greatest(1, least(255, round_even(ln(total) * (255.0 / ln(greatest(2.0, a))), 0))) AS INT) ELSE 0 END AS uni_q,
      CASE WHEN telegram > 0 THEN CAST(greatest(1, least(255, round_even(ln(telegram) * (255.0 / ln(greatest(2.0, b))), 0))) AS INT) ELSE 0 END AS inf_q, title + lower > 0 AND title >= 0.9 * (title + lower) AS capitalized FROM lex, scale""",
    "packed_order": f"{_RANKS} SELECT word, row_number() OVER (ORDER BY {q.key('word')}, translate(word, 'şçöğʼ', '{{|}}~' || chr(127))) - 1 AS id FROM lite",
    "directed_bigrams": f"{_ADM}, {_DIRECTED} SELECT * FROM directed",
    "merged_bigrams": f"{_ADM}, {_DIRECTED} SELECT * FROM pairs",
    "lexicon_bigrams": f'{_RANKS}, {_DIRECTED} SELECT w1, w2, "count", a.rank AS w1_rank, b.rank AS w2_rank FROM pairs JOIN lite a ON a.word = w1 JOIN lite b ON b.word = w2 ORDER BY "count" DESC, a.rank, b.rank LIMIT {TOP_BIGRAMS}',
    "bigram_adjacency": f'{_ADM}, {_DIRECTED} SELECT w1, w2, "count", row_number() OVER (ORDER BY w1, "count" DESC, w2) - 1 AS pos FROM pairs',
    "adjacency_offsets": f'{_ADM}, {_DIRECTED}, n AS (SELECT w1, count(*) AS n FROM pairs GROUP BY w1) SELECT w1, CAST(coalesce(sum(n) OVER (ORDER BY w1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_pos, n AS successors FROM n',
    "size_cutoff": f"{_ADM}, {_DIRECTED}, caps AS (SELECT unnest({list(CAPS)}) AS cap), grid AS (SELECT 3 AS t UNION SELECT \"count\" + 1 FROM pairs WHERE \"count\" >= 3), sums AS (SELECT t, coalesce((SELECT sum(strlen(w1) + strlen(w2) + strlen(CAST(\"count\" AS VARCHAR)) + 3) FROM pairs WHERE \"count\" >= t), 0) AS bytes FROM grid) SELECT CAST(cap AS BIGINT) AS cap, CAST(min(t) AS BIGINT) AS cutoff, CAST(max(bytes) AS BIGINT) AS bytes FROM caps JOIN sums ON bytes <= cap GROUP BY cap",
    "size_grid": f"""{_RANKS}, {_DIRECTED}, w AS (SELECT unnest({WORD_STEPS}) AS words), p AS (SELECT unnest({PAIR_STEPS}) AS pairs), r AS (SELECT word, rank FROM ranked WHERE rank < {WORD_STEPS[-1]}),
      j AS (SELECT greatest(a.rank, b.rank) AS top FROM pairs JOIN r a ON a.word = w1 JOIN r b ON b.word = w2),
      c AS (SELECT CAST(w.words AS INT) AS words, CAST(p.pairs AS INT) AS pairs, CAST(coalesce((SELECT sum(strlen(word) + 4) FROM r WHERE rank < w.words), 0) + 6 * least(p.pairs, (SELECT count(*) FROM j WHERE top < w.words)) AS BIGINT) AS bytes FROM w, p)
      SELECT *, bytes <= {BUDGET} AS fits, coalesce((words, pairs) = (SELECT (words, pairs) FROM c WHERE bytes <= {BUDGET} ORDER BY words DESC, pairs DESC LIMIT 1), false) AS chosen FROM c""",
    "suffix_chains": f"{_FULL}, {_CHAINS} SELECT * FROM chains",
    "heldout_subtraction": f"""WITH {_WORDS}, {_HELD}, h AS (SELECT word, sum(n) FILTER (register = 'news') AS a, sum(n) FILTER (register = 'telegram') AS b, sum(n) FILTER (letter_case = 'title') AS t, sum(n) FILTER (letter_case = 'lower') AS l FROM held GROUP BY word),
      out AS (SELECT word, books, CAST(greatest(0, news - coalesce(a, 0)) AS BIGINT) AS news, CAST(greatest(0, telegram - coalesce(b, 0)) AS BIGINT) AS telegram, CAST(greatest(0, title - coalesce(t, 0)) AS BIGINT) AS title, CAST(greatest(0, lower - coalesce(l, 0)) AS BIGINT) AS lower FROM words LEFT JOIN h USING (word)) SELECT * FROM out WHERE books + news + telegram >= 2""",
    "coverage": f"""{_RANKS}, {_CHAINS.replace(f">= {MIN_STEMS})", ">= 1)")}, {_HELD}, flags AS (SELECT word, word IN (SELECT word FROM lite) AS known, {q.key('word')} IN (SELECT {q.key('word')} FROM lite) AS keyed,
      word IN (SELECT word FROM (SELECT word, word[1:i] AS stem, word[i + 1:] AS suffix FROM (SELECT word, unnest(range(3, length(word) - 1)) AS i FROM (SELECT DISTINCT word FROM held))) WHERE stem IN (SELECT word FROM lite) AND suffix IN (SELECT suffix FROM chains)) AS split FROM (SELECT DISTINCT word FROM held))
      SELECT register, CAST(sum(n) AS BIGINT) AS tokens, round(sum(CASE WHEN known THEN n ELSE 0 END) / sum(n), 6) AS in_lexicon, round(sum(CASE WHEN keyed THEN n ELSE 0 END) / sum(n), 6) AS skeleton_match, round(sum(CASE WHEN known OR split THEN n ELSE 0 END) / sum(n), 6) AS stem_plus_suffix FROM held JOIN flags USING (word) GROUP BY register""",
    "transliterations": f"WITH {_WORDS}, t AS (SELECT word, {q.new_to_old('word')} AS old, {q.new_to_cyrillic('word')} AS cyrillic FROM words) SELECT word, old, cyrillic, {q.old_to_new('old')} AS from_old, {q.cyrillic_to_new('cyrillic')} AS from_cyrillic, translate(word, 'şçöğʼ', 'scog') AS bare, replace(replace(translate(word, 'öğʼ', 'og'), 'ş', 'sh'), 'ç', 'ch') AS ascii, regexp_matches(word, '[şçöğʼ]') AS marked FROM t",
    "round_trips": f"WITH {_WORDS}, t AS (SELECT word, {q.new_to_old('word')} AS old, {q.new_to_cyrillic('word')} AS cyrillic FROM words) SELECT count(*) AS words, count(*) FILTER ({q.old_to_new('old')} = word) AS old_ok, count(*) FILTER ({q.cyrillic_to_new('cyrillic')} = word) AS cyrillic_ok FROM t",
    "stripped_variants": f"{_FULL_LEX} SELECT w.word, w.total, g.word AS source, g.total AS source_total FROM lex w JOIN lex g ON g.skeleton = w.skeleton AND g.word <> w.word WHERE {q.stripped_from('g.word', 'w.word')}",
    "partial_mark_forms": f"{_FULL_LEX} SELECT w.word, w.total, g.word AS source, g.total AS source_total FROM lex w JOIN lex g ON g.skeleton = w.skeleton AND g.word <> w.word WHERE {q.stripped_from('g.word', 'w.word')} AND regexp_matches(w.word, '[şçöğʼ]') AND g.total >= 10 * w.total",
    "ambiguity_groups": f"{_FULL_LEX} SELECT skeleton, count(*) AS words, string_agg(word, ' ' ORDER BY total DESC, word) AS candidates FROM lex GROUP BY skeleton HAVING count(*) > 1",
    "spelling_variants": f"WITH {_WORDS}, v AS (SELECT word, {_KEYBOARD} AS k, {_PARTIAL} AS p FROM words) SELECT word, len(k) AS keyboard, k[1] AS first_keyboard, len(p) AS partial, p[1] AS first_partial FROM v",
    "keyboard_whatif": f"{_FULL_LEX}, v AS (SELECT word, books, total, unnest({_KEYBOARD}) AS v FROM lex), best AS (SELECT v.word, v.books, v.total, max(l.books) AS best FROM v JOIN lex l ON l.word = v.v GROUP BY 1, 2, 3), r AS (SELECT unnest([0.01, 0.05, 0.10]) AS ratio) SELECT CAST(ratio AS DOUBLE) AS ratio, count(*) AS forms, CAST(sum(total) AS BIGINT) AS mass FROM best, r WHERE best > 0 AND books / best < ratio GROUP BY 1",
    "spelling_cost": _COST,
    "prefix_completions": f"{_LEX}, p AS (SELECT skeleton[1:i] AS prefix, word, row_number() OVER (PARTITION BY skeleton[1:i] ORDER BY total DESC, word) AS rank FROM (SELECT *, unnest(range(1, length(skeleton) + 1)) AS i FROM lex)) SELECT prefix, rank, word FROM p WHERE rank <= 5",
    "next_word": f'{_ADM}, {_DIRECTED}, r AS (SELECT *, row_number() OVER (PARTITION BY w1 ORDER BY "count" DESC, w2) AS rank FROM pairs) SELECT w1, rank, w2, "count" FROM r WHERE rank <= 3',
}
