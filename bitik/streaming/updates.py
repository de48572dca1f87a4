"""Streaming forms of the update operators: counters with a watermark, and keyed state for limiter and user model."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bitik.operators import updates as up


def read_updates(spark, path: str, schema, max_files: int = 8) -> DataFrame:
    """The update feed: parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def counters(updates: DataFrame, late: str = "1 day", window: str = "1 hour") -> DataFrame:
    """Updates by route in tumbling windows of the sending time. Deliveries of one id count once within `late`."""
    fresh = updates.withWatermark("sent_at", late).dropDuplicatesWithinWatermark(["update_id"])
    return up.route(fresh).groupBy(F.window("sent_at", window), "route").agg(F.count("*").alias("updates"))


def limiter(hits: DataFrame, limit: int, window_ms: int = up.WINDOW_MS, late: str = "1 day") -> DataFrame:
    """Hits (key, ms, order) with allowed, the same as of the batch form `updates.limited`.

    A hit is decided when the watermark has passed it, so that one that arrives up to `late` after newer ones takes its
    place among them; later ones are dropped, as by every watermark. The state of a key is its undecided hits and the
    allowed times of its last window; a key without either is removed. Hits with a null key or time have no limit
    and give no rows.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, waiting = ([], []) if not state.exists else (list(state.get[0]), [(w["ms"], w["order"]) for w in map(_as_dict, state.get[1])])
        for batch in batches:
            waiting += list(zip(batch["ms"].tolist(), batch["order"].tolist(), strict=True))
        passed = state.getCurrentWatermarkMs()
        waiting.sort()
        ready = [w for w in waiting if w[0] < passed]
        waiting = waiting[len(ready) :]
        allowed = []
        for ms, _ in ready:
            times = [t for t in times if t > ms - window_ms]
            allowed.append(len(times) < limit)
            if allowed[-1]:
                times.append(ms)
        times = [t for t in times if t > passed - window_ms]
        if waiting or times:
            state.update((times, waiting))
            state.setTimeoutTimestamp(max(passed, waiting[0][0] if waiting else times[-1] + window_ms) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"key": [key[0]] * len(ready), "ms": [ms for ms, _ in ready], "order": [o for _, o in ready], "allowed": allowed})

    timed = hits.where("key IS NOT NULL AND ms IS NOT NULL").withColumn("at", F.timestamp_millis("ms")).withWatermark("at", late)
    return timed.groupBy("key").applyInPandasWithState(
        step, "key bigint, ms bigint, order bigint, allowed boolean", "times array<bigint>, waiting array<struct<ms:bigint,order:bigint>>", "append", GroupStateTimeout.EventTimeTimeout
    )


def _as_dict(row) -> dict:
    return row if isinstance(row, dict) else row.asDict()


def learn(words: DataFrame, half_life_ms: int = up.HALF_LIFE_MS, max_words: int = up.MAX_WORDS) -> DataFrame:
    """(from_id, word, ms) to decayed counts of the words just written; late hits decay from the newer time.

    The state of a user is at most `max_words` words with their counts and last times: beyond that the word
    with the least count, decayed to the newest time, is forgotten. Rows with a null user, word or time are left out.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = dict(zip(state.get[0], zip(state.get[1], state.get[2]))) if state.exists else {}
        touched = set()
        for batch in batches:
            for ms, word in sorted(zip(batch["ms"].tolist(), batch["word"].tolist(), strict=True)):
                count, last = known.get(word, (0.0, ms))
                newer = max(last, ms)
                known[word] = count * 2 ** (-(newer - last) / half_life_ms) + 2 ** (-(newer - ms) / half_life_ms), newer
                touched.add(word)
                if len(known) > max_words:
                    now = max(last for _, last in known.values())
                    least = min(known, key=lambda w: (known[w][0] * 2 ** (-(now - known[w][1]) / half_life_ms), w))
                    del known[least]
        state.update((list(known), [float(c) for c, _ in known.values()], [int(t) for _, t in known.values()]))
        rows = [(key[0], w, known[w][0], known[w][1]) for w in sorted(touched & known.keys())]
        yield pd.DataFrame(rows, columns=["from_id", "word", "count", "last_ms"])

    return words.dropna().groupBy("from_id").applyInPandasWithState(
        step, "from_id bigint, word string, count double, last_ms bigint", "words array<string>, counts array<double>, lasts array<bigint>", "update", GroupStateTimeout.NoTimeout
    )
