"""Problem 5: texts, measured in tokens, put together into sequences of fixed capacity.

Minimum bin slack: for each bin the longest waiting piece is taken, and a bitset subset-sum dynamic
programme over the lengths that are still available finds the fullest combination beside it, which is then
removed. A text longer than the capacity is first divided into whole bins and a rest; no other is divided.

Every partition of the scan packs its own texts in the task that counts their tokens, so no row moves and
nothing but lengths is held. A partition leaves at most one bin open, one in tens of thousands at the usual
split sizes. Sequence numbers are the partition number times 2^33 plus a number from 0.

Defined results: null and empty texts have 0 tokens and one row of no length at the end of the partition's
last sequence; equal ids are packed as separate rows; a null id keeps its row.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from bitik.session import spread

CAPACITY = 2048
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
SEQUENCES_PER_PARTITION = 1 << 33

_ENCODERS: dict[str, object] = {}


def encoder(path: str | None = None):
    """A tokenizer of the public vocabulary file at `path`; the default file is the installed multilingual one."""
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path(VOCABULARY)
    if path not in _ENCODERS:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        _ENCODERS[path] = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum that is at most `room`.

    Bit s of `reach` says that s is the sum of some pieces seen so far. Long lengths come first, and the
    search ends as soon as the room can be filled to the last token.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        for _ in range(min(counts[length], room // length)):
            grown = (reach | reach << length) & mask
            if grown == reach:
                break
            steps.append((length, reach))
            reach = grown
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, defaultdict(int)
    for length, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] += 1
            at -= length
    return dict(chosen)


def minimum_bin_slack(lengths: Iterable[int], capacity: int) -> list[dict[int, int]]:
    """Bins as {length: pieces}, each the fullest combination beside the longest length left.

    A combination is used again while enough pieces of its lengths are left, as the search would find it again.
    """
    counts: dict[int, int] = defaultdict(int)
    for n in lengths:
        counts[n] += 1
    bins = []
    while counts:
        top = max(counts)
        counts[top] -= 1
        beside = fullest({k: v for k, v in counts.items() if v}, capacity - top)
        counts[top] += 1
        beside[top] = beside.get(top, 0) + 1
        times = min(counts[k] // v for k, v in beside.items())
        bins += [beside] * times
        for k, v in beside.items():
            counts[k] -= v * times
            if not counts[k]:
                del counts[k]
    return bins


def place(sizes: list[int], capacity: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(row, part, first token, tokens, sequence, position in it) of every piece of texts of these sizes."""
    waiting: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequence, empty = 0, []
    for row, size in enumerate(sizes):
        for part in range(size // capacity):
            yield row, part, part * capacity, capacity, sequence, 0
            sequence += 1
        rest = size % capacity
        if rest:
            waiting[rest].append((row, size // capacity, size - rest))
        elif not size:
            empty.append(row)
    used = capacity if sequence else 0
    for content in minimum_bin_slack((n for n, items in waiting.items() for _ in items), capacity):
        used = 0
        for length in sorted(content, reverse=True):
            for _ in range(content[length]):
                row, part, first = waiting[length].pop()
                yield row, part, first, length, sequence, used
                used += length
        sequence += 1
    for row in empty:
        yield row, 0, 0, 0, max(sequence - 1, 0), used


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """One row for every piece: id, part, first_token, n_tokens, seq_no, seq_pos."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, ids, sizes = encoder(vocabulary), [], []
        for batch in batches:
            ids += list(batch["id"])
            sizes += [len(tokens.encode_ordinary(t)) if t else 0 for t in batch["text"]]
        base = TaskContext.get().partitionId() * SEQUENCES_PER_PARTITION
        rows: list[tuple] = []
        for row, part, first, n, seq, pos in place(sizes, capacity):
            rows.append((ids[row], part, first, n, base + seq, pos))
            if len(rows) == 20_000:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        yield pd.DataFrame(rows, columns=names)

    names = ["id", "part", "first_token", "n_tokens", "seq_no", "seq_pos"]
    kind = df.schema[id_col].dataType.simpleString()
    texts = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    return texts.mapInPandas(run, f"id {kind}, part int, first_token bigint, n_tokens int, seq_no bigint, seq_pos int").withColumnRenamed("id", id_col)
