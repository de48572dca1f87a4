"""Queries over the chat updates, the event table and the benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bitik.functions import text as tx, translit as tr
from bitik.operators import build, corpus, updates as up
from bitik.plans import sql as q
from bitik.session import spread, table

BOT = "bitik_bot"


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return up.route(up.once(table(spark, sf_dir, "updates")), BOT)


def update_routes(spark, sf_dir):
    return _routed(spark, sf_dir).select("update_id", "route", F.length("body").alias("body_length"), "is_cut")


def route_counters(spark, sf_dir):
    """Updates by hour of sending and route."""
    return _routed(spark, sf_dir).groupBy(F.date_format("sent_at", "yyyy-MM-dd HH").alias("hour"), "route").agg(F.count("*").alias("updates"))


def rate_limit(spark, sf_dir):
    """W9 over all messages that are not ignored."""
    hits = _routed(spark, sf_dir).where("kind = 'message' AND route <> 'ignored'").select("from_id", F.unix_millis("sent_at").alias("ms"), "update_id")
    return up.limited(hits, "from_id", "ms", "update_id", up.LIMITS["message"]).select("update_id", "from_id", "allowed")


def event_limit(spark, sf_dir):
    """W9 over events: at most two of a user in ten hours, refusals not counted."""
    hits = table(spark, sf_dir, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "event_id")
    out = up.limited(hits, "user_id", "ms", "event_id", 2, 36_000_000)
    return out.groupBy("allowed").agg(F.count("*").alias("events"))


def decayed_counts(spark, sf_dir):
    """W10 over events by user and type."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return up.decayed(events, ["user_id", "event_type"], "ms").select("user_id", "event_type", F.round("count", 4).alias("count"))


def user_models(spark, sf_dir):
    """Q4: the user model of every chat user from their texts."""
    texts = _routed(spark, sf_dir).where("route = 'text'").select("from_id", "sent_at", F.col("body").alias("text"), "update_id")
    words = corpus.analysed(corpus.tokens(texts, "from_id", "update_id", "sent_at")).where("kind = 'word'").select("from_id", F.col("canon").alias("word"), F.unix_millis("sent_at").alias("ms"))
    return up.user_model(words)


def user_words(spark, sf_dir):
    """The words of every user model with their counts."""
    return user_models(spark, sf_dir).select("from_id", "word", F.round("count", 4).alias("count"))


def delivery_latency(spark, sf_dir):
    """Percentiles by index of the delivery time in microseconds."""
    us = up.once(table(spark, sf_dir, "updates")).select("kind", (F.unix_micros("received_at") - F.unix_micros("sent_at")).alias("us")).where("us IS NOT NULL")
    p = [F.expr(f"percentile_disc({x}) WITHIN GROUP (ORDER BY us)").cast("bigint").alias(n) for x, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))]
    return us.groupBy("kind").agg(*p, F.max("us").alias("max"))


def conversions(spark, sf_dir):
    """Every word-like form of the updates in the three scripts, with status and saved key presses."""
    texts = table(spark, sf_dir, "updates").select("text")
    forms = corpus.surfaces(texts).select("surface")
    s = F.col("surface")
    out = forms.select("surface", *[tr.rule_token(s, to).alias(to) for to in ("new", "old", "cyrillic")])
    return out.withColumn("status", up.status(s, F.col("new"), "new")).withColumn("saved", 2 * F.greatest(F.lit(0), tx.marks_in(F.col("new")) - tx.marks_in(s)))


def convert_texts(spark, sf_dir):
    """Whole update texts converted to new Latin, segments put together again in order."""
    return convert(table(spark, sf_dir, "updates").select("update_id", "text"), "update_id", "new")


def update_replies(spark, sf_dir):
    """Q14: the texts to answer in the three scripts as messages that fit."""
    texts = _routed(spark, sf_dir).where("route IN ('text', 'inline')").select("update_id", F.col("body").alias("text"))
    t = F.col("text")
    out = texts.select("update_id", t, build.converted(t, "new").alias("new"), build.on_tokens(t, lambda p: tr.rule_token(p, "old")).alias("old"), build.converted(t, "cyrillic").alias("cyrillic"))
    return up.replies(out, "update_id").withColumn("length", F.length("body")).withColumn("body", F.md5("body"))


def convert(texts: DataFrame, key: str, to: str, source: str = "old") -> DataFrame:
    """Texts (key, text) converted token by token inside the row."""
    return spread(texts.select(key, "text")).select(key, build.converted(F.col("text"), to, source).alias("converted"))


def eval_items(spark, sf_dir):
    """Items with their prompt, quoted word and distinct options."""
    i = table(spark, sf_dir, "eval_items")
    letters = F.transform(F.arrays_zip(F.array(*map(F.lit, "ABCD")).alias("l"), F.col("options").alias("o")), lambda z: F.concat_ws(") ", z["l"], z["o"]))
    prompt = F.concat_ws("\n", "context", "question", F.array_join(letters, "\n"))
    return i.select("item_id", F.md5(prompt).alias("prompt"), tx.quoted_word(F.col("question")).alias("quoted"), F.size(F.array_distinct("options")).alias("distinct_options"), F.array_join(F.slice(F.array_distinct("options"), 1, 3), "|").alias("first_three"))


def eval_scores(spark, sf_dir):
    """The share of items whose right option is the rule conversion of the quoted word, by category and in total."""
    i = table(spark, sf_dir, "eval_items").where("answer IS NOT NULL").select("category", "options", "answer", tx.quoted_word(F.col("question")).alias("w"))
    low = F.lower(tx.fold_confusables(F.col("w")))
    guess = F.when(tx.detect_script(low) == "cyrillic", tr.cyrillic_rule(low)).otherwise(tr.old_to_new(low))
    hit = F.array_position("options", guess) - 1 == F.col("answer")
    return i.rollup("category").agg(F.grouping("category").cast("int").alias("is_total"), F.count("*").alias("items"), F.count_if(F.coalesce(hit, F.lit(False))).alias("correct"))


QUERIES = {f.__name__: f for f in (update_routes, route_counters, rate_limit, event_limit, decayed_counts, user_words, delivery_latency, conversions, convert_texts, update_replies, eval_items, eval_scores)}

_ONCE = """once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY update_id ORDER BY received_at NULLS LAST, sent_at NULLS LAST) AS r FROM updates) WHERE r = 1),
bodies AS (SELECT *, chat_type IN ('group', 'supergroup') AS grp, CASE WHEN kind = 'inline_query' THEN trim(coalesce(text, ''))[1:256] WHEN chat_type IN ('group', 'supergroup') THEN trim(regexp_replace(text, '@bitik_bot\\b', '', 'gi')) ELSE text END AS b FROM once),
routed AS (SELECT *, CASE WHEN kind = 'inline_query' THEN CASE WHEN regexp_matches(b, '\\p{L}') THEN 'inline' ELSE 'inline_empty' END WHEN kind <> 'message' THEN 'ignored'
  WHEN coalesce(is_bot, false) OR from_id IS NULL OR chat_type IS NULL OR chat_type NOT IN ('private', 'group', 'supergroup') THEN 'ignored' WHEN grp AND NOT coalesce(regexp_matches(text, '(?i)@bitik_bot\\b'), false) THEN 'ignored'
  WHEN text IS NULL THEN 'non_text' WHEN len(list_filter(entities, lambda e: e."type" = 'bot_command' AND e."offset" = 0)) > 0 THEN CASE WHEN lower(regexp_extract(text, '^/\\w+@(\\w+)', 1)) IN ('', 'bitik_bot') THEN 'command' ELSE 'ignored' END
  WHEN regexp_matches(b, '\\p{L}') THEN 'text' ELSE 'no_letters' END AS route FROM bodies)"""


def _fold(key: str, item: str, hits: str, limit: int, window: int) -> str:
    """The limiter as a fold over each key's times in order: allowed times so far, and the flags."""
    ok = f"len(list_filter(s.a, lambda y: y > x.a[1] - {window})) < {limit}"
    step = f"lambda s, x: {{'a': CASE WHEN {ok} THEN s.a || x.a ELSE s.a END, 'f': s.f || [{ok}]}}"
    return f"""lists AS (SELECT {key}, list(ms ORDER BY ms, {item}) AS ts, list({item} ORDER BY ms, {item}) AS ids FROM ({hits}) GROUP BY {key}),
folded AS (SELECT {key}, ids, list_reduce(list_transform(ts, lambda t: {{'a': [t], 'f': [true]}}), {step}) AS r FROM lists), flags AS (SELECT unnest(ids) AS {item}, {key}, unnest(r.f) AS allowed FROM folded)"""


_MARKS = "length(regexp_replace({}, '[^şçöğʼŞÇÖĞ]', '', 'g'))"
_CONVERTED = f"""runs AS (SELECT n, run, i, regexp_matches(run, '{q.ANCHOR}') AS kept FROM (SELECT n, unnest(rs) AS run, generate_subscripts(rs, 1) AS i FROM (SELECT n, regexp_extract_all(text, '[{q.SPACE}]+|[^{q.SPACE}]+') AS rs FROM texts))),
segs AS (SELECT n, i, kept, ps, unnest(ps) AS p, generate_subscripts(ps, 1) AS j FROM (SELECT n, i, kept, CASE WHEN kept THEN [run] ELSE regexp_extract_all(run, {q._PIECES}) END AS ps FROM runs)),
found AS (SELECT *, CASE WHEN NOT kept AND regexp_matches(p, '{q.L}') THEN regexp_extract(p, '{q.L}+(?:{q.A}+{q.L}+)*') || {q._TAKEN} END AS surface, length(regexp_extract(p, '^{q.A}*')) AS lead,
    (NOT regexp_matches(p, '^{q.A}') AND j > 1 AND regexp_matches(ps[j - 1], '{q.D}$')) OR (length({q._TAIL}) = length({q._TAKEN}) AND regexp_matches(coalesce(ps[j + 1], ''), '^{q.D}')) AS glued FROM segs), {q.ruled('found')},
read AS (SELECT surface, {q.case_pattern('surface')} AS pat, {q.old_to_new('low')} AS canon FROM (SELECT DISTINCT surface, lower(translate(surface, '{q.FOLD_FROM}', '{q.FOLD_TO}')) AS low FROM found WHERE surface IS NOT NULL) WHERE {q.script('low')} = 'latin' AND {q.case_pattern('surface')} <> 'mixed'),
direct AS (SELECT surface, {', '.join(f"CASE pat WHEN 'upper' THEN upper({x}) WHEN 'title' THEN upper(({x})[1:1]) || ({x})[2:] ELSE {x} END AS {to}" for to, x in (('new', 'canon'), ('cyrillic', q.new_to_cyrillic('canon'))))}, NULL AS old FROM read),
out AS (SELECT n, {', '.join(f"string_agg(CASE WHEN f.surface IS NULL THEN p ELSE p[1:lead] || CASE WHEN glued THEN r.{to} ELSE coalesce(d.{to}, r.{to}) END || p[lead + length(f.surface) + 1:] END, '' ORDER BY i, j) AS {to}" for to in up.SCRIPTS)} FROM found f LEFT JOIN ruled r USING (surface) LEFT JOIN direct d USING (surface) GROUP BY n)"""
_ESCAPED = """replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')"""
_CYR = "regexp_matches(text, '[\\x{400}-\\x{52f}]')"
_IN_SCRIPT = {"cyrillic": f"{_CYR} AND NOT regexp_matches(text, '[A-Za-zÀ-ɏ]')", "new": f"NOT {_CYR} AND NOT regexp_matches(lower(text), 'sh|ch|[og]{q.A}')", "old": f"NOT {_CYR} AND NOT regexp_matches(lower(text), '[şçöğ]')"}
_SECTIONS = {to: f"CASE WHEN {to} <> text THEN '<b>{to}</b>' || chr(10) || '<pre>' || {_ESCAPED.format(to)} || '</pre>' ELSE '<b>{to}</b> ' || CASE WHEN {_IN_SCRIPT[to]} THEN 'already' ELSE 'unchanged' END END" for to in up.SCRIPTS}

ORACLE_SQL = {
    "conversions": f"""WITH {q.tokens('updates', 'update_id')}, {q.ruled('toks')} SELECT surface, new, old, cyrillic, CASE WHEN new <> surface THEN 'changed' WHEN regexp_matches(surface, '[\\x{{400}}-\\x{{52f}}]') THEN 'unchanged'
      WHEN regexp_matches(lower(surface), 'sh|ch|[og]{q.A}') THEN 'unchanged' ELSE 'already' END AS status, CAST(2 * greatest(0, {_MARKS.format('new')} - {_MARKS.format('surface')}) AS INT) AS saved FROM ruled""",
    "convert_texts": f"WITH texts AS (SELECT row_number() OVER () AS n, update_id, text FROM updates), {_CONVERTED} SELECT update_id, CASE WHEN text IS NOT NULL THEN coalesce(new, '') END AS converted FROM texts LEFT JOIN out USING (n)",
    "update_replies": f"""WITH {_ONCE}, texts AS (SELECT row_number() OVER () AS n, update_id, CASE WHEN length(b) > 4096 THEN b[1:4000] ELSE b END AS text FROM routed WHERE route IN ('text', 'inline')), {_CONVERTED},
      said AS (SELECT update_id, {', '.join(f"{x} AS s_{to}" for to, x in _SECTIONS.items())} FROM texts JOIN out USING (n)), whole AS (SELECT *, concat_ws(chr(10) || chr(10), s_new, s_old, s_cyrillic) AS one FROM said),
      parts AS (SELECT update_id, 0 AS part, NULL AS script, one AS body FROM whole WHERE length(one) <= {up.MAX_TEXT} {' '.join(f"UNION ALL SELECT update_id, {n}, '{to}', CASE WHEN length(s_{to}) > {up.MAX_TEXT} THEN regexp_replace(s_{to}[1:{up.MAX_TEXT - 7}], '&[a-z]*$', '') || '…</pre>' ELSE s_{to} END FROM whole WHERE length(one) > {up.MAX_TEXT}" for n, to in enumerate(up.SCRIPTS))})
      SELECT update_id, part, script, md5(body) AS body, CAST(length(body) AS INT) AS length FROM parts""",
    "rate_limit": f"WITH {_ONCE}, " + _fold("from_id", "update_id", "SELECT from_id, update_id, epoch_us(sent_at) // 1000 AS ms FROM routed WHERE kind = 'message' AND route <> 'ignored'", up.LIMITS["message"], up.WINDOW_MS) + " SELECT * FROM flags",
    "event_limit": "WITH " + _fold("user_id", "event_id", "SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms FROM events", 2, 36_000_000) + " SELECT allowed, count(*) AS events FROM flags GROUP BY allowed",
    "update_routes": f"WITH {_ONCE} SELECT update_id, route, CAST(length(CASE WHEN length(b) > 4096 THEN b[1:4000] ELSE b END) AS INT) AS body_length, coalesce(length(b) > 4096, false) AS is_cut FROM routed",
    "route_counters": f"WITH {_ONCE} SELECT strftime(sent_at AT TIME ZONE 'UTC', '%Y-%m-%d %H') AS hour, route, count(*) AS updates FROM routed GROUP BY 1, 2",
    "decayed_counts": f"WITH l AS (SELECT user_id, event_type, epoch_us(ts) // 1000 AS ms, max(epoch_us(ts) // 1000) OVER (PARTITION BY user_id, event_type) AS last FROM events) SELECT user_id, event_type, round(sum(pow(2.0, -(last - ms) / {float(up.HALF_LIFE_MS)})), 4) AS \"count\" FROM l GROUP BY 1, 2",
    "user_words": f"""WITH {_ONCE}, {q.tokens('(SELECT from_id, update_id, sent_at, b AS text FROM routed WHERE route = ' + "'text'" + ')', 'from_id, update_id, sent_at')}, {q.analysed()},
      w AS (SELECT from_id, canon AS word, epoch_us(sent_at) // 1000 AS ms FROM toks JOIN forms USING (surface) WHERE canon IS NOT NULL), l AS (SELECT *, max(ms) OVER (PARTITION BY from_id, word) AS last, max(ms) OVER (PARTITION BY from_id) AS now FROM w),
      c AS (SELECT from_id, word, last, now, sum(pow(2.0, -(last - ms) / {float(up.HALF_LIFE_MS)})) AS c FROM l GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY c * pow(2.0, -(now - last) / {float(up.HALF_LIFE_MS)}) DESC, word) AS r FROM c)
      SELECT from_id, word, round(c, 4) AS "count" FROM r WHERE r <= {up.MAX_WORDS}""",
    "delivery_latency": f"WITH {_ONCE} SELECT kind, quantile_disc(us, 0.5) AS p50, quantile_disc(us, 0.95) AS p95, quantile_disc(us, 0.99) AS p99, max(us) AS max FROM (SELECT kind, epoch_us(received_at) - epoch_us(sent_at) AS us FROM once) WHERE us IS NOT NULL GROUP BY kind",
    "eval_items": "SELECT item_id, md5(concat_ws(chr(10), context, question, array_to_string(list_transform(options, lambda o, i: ['A', 'B', 'C', 'D'][i] || ') ' || o), chr(10)))) AS prompt, regexp_extract(question, '\"([^\"]+)\"', 1) AS quoted, CAST(len(list_distinct(options)) AS INT) AS distinct_options, array_to_string(list_filter(options, lambda o, i: list_position(options, o) = i)[1:3], '|') AS first_three FROM eval_items",
    "eval_scores": f"WITH g AS (SELECT category, options, answer, lower(translate(regexp_extract(question, '\"([^\"]+)\"', 1), '{q.FOLD_FROM}', '{q.FOLD_TO}')) AS low FROM eval_items WHERE answer IS NOT NULL) SELECT category, CAST(grouping(category) AS INT) AS is_total, count(*) AS items, count(*) FILTER (list_position(options, CASE WHEN {q.script('low')} = 'cyrillic' THEN {q.cyrillic_rule('low')} ELSE {q.old_to_new('low')} END) - 1 = answer) AS correct FROM g GROUP BY ROLLUP (category)",
}
