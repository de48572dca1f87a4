"""Chat updates: routing, the sliding-window limit, counters and the decayed user model.

Updates may be delivered twice, late and out of order; a null user has no limit and no model.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from bitik.functions import text as tx

LIMITS = {"message": 20, "inline_query": 60}
WINDOW_MS = 60_000
MAX_TEXT, INPUT_CUT, INLINE_MAX = 4096, 4000, 256
HALF_LIFE_MS = 30 * 24 * 60 * 60 * 1000
MAX_WORDS = 5000


def once(updates: DataFrame) -> DataFrame:
    """Each update id once: of several deliveries the first received."""
    first = Window.partitionBy("update_id").orderBy(F.col("received_at").asc_nulls_last(), F.col("sent_at").asc_nulls_last())
    return updates.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def route(updates: DataFrame, username: str = "bitik_bot") -> DataFrame:
    """`updates` with route and body; the limiter comes before every route but ignored."""
    text = F.col("text")
    group = F.col("chat_type").isin("group", "supergroup")
    command = F.exists(F.coalesce("entities", F.expr("array()").cast("array<struct<type:string,offset:int,length:int>>")), lambda e: (e["type"] == "bot_command") & (e["offset"] == 0))
    target = F.lower(F.regexp_extract(text, r"^/\w+@(\w+)", 1))
    mentioned = F.lower(text).rlike(rf"@{username}(?!\w)")
    body = F.when(F.col("kind") == "inline_query", tx.cut(F.trim(F.coalesce(text, F.lit(""))), INLINE_MAX)).otherwise(
        F.when(group, F.trim(F.regexp_replace(text, rf"(?i)@{username}(?!\w)", ""))).otherwise(text)
    )
    letters = body.rlike(r"\p{L}")
    routed = (
        F.when(F.col("kind") == "inline_query", F.when(letters, "inline").otherwise("inline_empty"))
        .when(F.col("kind") != "message", "ignored")
        .when(F.coalesce(F.col("is_bot"), F.lit(False)) | F.col("from_id").isNull() | ~F.coalesce(group | (F.col("chat_type") == "private"), F.lit(False)), "ignored")
        .when(group & ~F.coalesce(mentioned, F.lit(False)), "ignored")
        .when(text.isNull(), "non_text")
        .when(command, F.when(target.isin("", username), "command").otherwise("ignored"))
        .when(letters, "text")
        .otherwise("no_letters")
    )
    long_ = F.length(body) > MAX_TEXT
    return updates.withColumn("route", routed).withColumn("body", F.when(long_, tx.cut(body, INPUT_CUT)).otherwise(body)).withColumn("is_cut", F.coalesce(long_, F.lit(False)))


SCRIPTS = ("new", "old", "cyrillic")


def status(text: Column, out: Column, script: str) -> Column:
    """Changed; already, if the text is written in the script; unchanged otherwise."""
    cyrillic = text.rlike(r"[\x{0400}-\x{052f}]")
    in_script = {
        "cyrillic": cyrillic & ~text.rlike("[A-Za-zÀ-ɏ]"),
        "new": ~cyrillic & ~F.lower(text).rlike(f"sh|ch|[og]{tx.APOS}"),
        "old": ~cyrillic & ~F.lower(text).rlike("[şçöğ]"),
    }[script]
    return F.when(out != text, "changed").when(in_script, "already").when(text.isNotNull(), "unchanged")


def replies(rows: DataFrame, key: str, limit: int = MAX_TEXT) -> DataFrame:
    """Q14: key, part, script, body: the text in the three scripts (columns new, old, cyrillic) as messages of at most `limit` characters.

    One message if all three fit, else one for each script, cut where it does not fit and never inside an escape. A
    script the text is not changed for has its status in place of the text. A null text has no reply.
    """

    def section(script: str) -> Column:
        state = status(F.col("text"), F.col(script), script)
        return F.when(state == "changed", F.concat(F.lit(f"<b>{script}</b>\n<pre>"), tx.html_escape(F.col(script)), F.lit("</pre>"))).otherwise(F.concat(F.lit(f"<b>{script}</b> "), state))

    def cut(body: Column) -> Column:
        short = F.regexp_replace(F.substring(body, 1, limit - len("…</pre>")), "&[a-z]*$", "")
        return F.when(F.length(body) > limit, F.concat(short, F.lit("…</pre>"))).otherwise(body)

    one = F.concat_ws("\n\n", *map(section, SCRIPTS))
    part = lambda n, script, body: F.struct(F.lit(n).alias("part"), F.lit(script).cast("string").alias("script"), body.alias("body"))
    parts = F.when(F.length(one) <= limit, F.array(part(0, None, one))).otherwise(F.array(*[part(n, s, cut(section(s))) for n, s in enumerate(SCRIPTS)]))
    return rows.where("text IS NOT NULL").select(key, F.explode(parts).alias("p")).select(key, "p.*")


def sessions(hits: DataFrame, key: str, ms: str, gap_ms: int = WINDOW_MS) -> DataFrame:
    """`hits` with session: the start of the stretch without a pause of `gap_ms` that a hit lies in.

    A busy key is cut into hours, each sorted on its own; only one row for each key and hour is looked at
    along a key's whole time to carry a stretch over an hour's end.
    """
    hour = F.floor(F.col(ms) / 3_600_000).alias("_hour")
    inside = Window.partitionBy(key, "_hour").orderBy(ms)
    marked = hits.select("*", hour).withColumn("_gap", F.col(ms) - F.lag(ms).over(inside))
    starts = marked.withColumn("_start", F.when(F.col("_gap").isNull() | (F.col("_gap") >= gap_ms), F.col(ms))).withColumn("_last", F.last("_start", ignorenulls=True).over(inside))
    ends = starts.groupBy(key, "_hour").agg(F.min(ms).alias("_min"), F.max(ms).alias("_max"), F.max("_start").alias("_open"))
    along = Window.partitionBy(key).orderBy("_hour")
    joined = ends.withColumn("_fresh", F.coalesce(F.col("_min") - F.lag("_max").over(along) >= gap_ms, F.lit(True)))
    # the stretch open at an hour's start: the last one begun in an earlier hour, or at a fresh hour's first hit
    opened = F.when(F.col("_fresh") | (F.col("_open") > F.col("_min")), F.col("_open"))
    carry = F.last(opened, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    carried = joined.select(key, "_hour", "_min", F.when(~F.col("_fresh"), carry).alias("_carry"))
    both = starts.join(carried, [key, "_hour"])
    return both.withColumn("session", F.when(F.col("_last") == F.col("_min"), F.coalesce("_carry", "_last")).otherwise(F.col("_last"))).drop("_hour", "_gap", "_start", "_last", "_min", "_carry")


def limited(hits: DataFrame, key: str, ms: str, order: str, limit: int, window_ms: int = WINDOW_MS) -> DataFrame:
    """`hits` with allowed: whether fewer than `limit` hits of the key were allowed in the window before.

    Refused hits do not count, so this is a fold and no window frame. A pause of a window's length empties the
    state, so stretches between pauses are folded apart, each streamed in order with only `limit` times in memory.
    """
    parts = sessions(hits, key, ms, window_ms).repartition(key, "session").sortWithinPartitions(key, "session", ms, order)

    def fold(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, times = None, deque()
        for batch in batches:
            allowed = []
            for k, s, t in zip(batch[key], batch["session"], batch[ms], strict=True):
                if (k, s) != at:
                    at, times = (k, s), deque()
                while times and times[0] <= t - window_ms:
                    times.popleft()
                allowed.append(len(times) < limit)
                if allowed[-1]:
                    times.append(t)
            yield batch.assign(allowed=allowed)

    out = parts.select(key, "session", ms, order)
    schema = f"{key} {out.schema[key].dataType.simpleString()}, session bigint, {ms} bigint, {order} {out.schema[order].dataType.simpleString()}, allowed boolean"
    return out.mapInPandas(fold, schema)


def decayed(events: DataFrame, keys: list[str], ms: str, last: DataFrame | None = None, half_life_ms: int = HALF_LIFE_MS) -> DataFrame:
    """The decayed count of each key at its own last time, in closed form.

    2^(-(last - t) / half-life) is summed relative to a fixed day of the key's first event, so that one
    partly combined aggregate is enough and no key's rows meet unaggregated.
    """
    spans = events.groupBy(*keys).agg(F.max(ms).alias("last_ms"))
    joined = events.join(spans, keys) if last is None else events.join(last, keys)
    weight = F.pow(F.lit(2.0), -(F.col("last_ms") - F.col(ms)) / F.lit(float(half_life_ms)))
    return joined.groupBy(*keys, "last_ms").agg(F.sum(weight).alias("count"))


def user_model(words: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """Words (from_id, word, ms) a user has written with decayed counts; the `max_words` largest stay."""
    counts = decayed(words, ["from_id", "word"], "ms")
    order = Window.partitionBy("from_id").orderBy(F.desc("now_count"), "word")
    newest = counts.groupBy("from_id").agg(F.max("last_ms").alias("now"))
    aged = counts.join(newest, "from_id").withColumn("now_count", F.col("count") * F.pow(F.lit(2.0), -(F.col("now") - F.col("last_ms")) / F.lit(float(HALF_LIFE_MS))))
    return aged.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max_words).drop("_r", "now")
