"""Problem 6: evaluation texts that leaked, whole or in part, into a training corpus.

Template canonicalisation: every text becomes a sequence of word keys that is the same for new Latin, old
Latin with or without apostrophes and Cyrillic, and free of letter case, punctuation, mark-up, invisible
and look-alike characters. Windows of twelve successive words are hashed and hash-joined with the windows of the
evaluation contexts; equal words are a verbatim leak. The same is done with templates, in which numbers, names
and units are typed placeholders; windows of equal template whose slots differ by a one-to-one replacement are
a re-parameterised question, reported apart.

A name is a word that some context capitalises inside a sentence, in any letter case, or, since a new name
stands in no context, one that its own text capitalises. Both texts are hashed with the known names, with
these and the words capitalised inside a sentence, and with every capitalised word. Numbers written in groups
or with decimals are one slot; windows over their single digit groups are hashed as well.

Defined results: null and empty contexts or texts, and those of fewer than twelve words, have no windows;
repeated rows count once; items that share a context share its cases.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from bitik.functions.alphabet import APOSTROPHES
from bitik.llm.charmap import CharMap
from bitik.llm.lookalike import CYRILLIC_LATIN, CYRILLIC_LIKE, GREEK_LATIN, GREEK_LIKE, _maps
from bitik.session import materialise, spread

#: Successive words that make a leak.
WINDOW = 12
#: Bits of the filter that drops corpus windows at the scan: sixteen for each evaluation window, but at most 2^30
#: (128 MB), and no less than 2^10. A fuller filter lets more windows through to the join, which decides alone.
FILTER_BITS = (10, 30)
#: Copies of a window hash that many documents hold are spread over so many parts of the join.
SALTS = 8

#: Texts whose words are held at once.
SLICE = 1000

# Units of measure as word keys.
UNITS = frozenset("km m sm mm kg g gr t l ml ga soat daqiqa min foiz mln mlrd ming som dollar dona ta".split())

# One Latin key letter or pair for each letter of the alphabets.
KEY_FROM = "абвгдежзийклмнопрстуфхцчшщъыьэюяёўқғҳşçöğ"
KEY_TO = "a b v g d e j z i y k l m n o p r s t u f x s C S S - i - e yu ya yo o q g h S C o g".split()

_KEYS = CharMap({ord(a): None if b == "-" else b for a, b in zip(KEY_FROM, KEY_TO, strict=True)} | dict.fromkeys(map(ord, APOSTROPHES)))
_TAG = re.compile(r"</?[a-z][^<>]*>|&[a-z]+;")
_WORD = re.compile(r"[^\W_]+")
_BOTH = re.compile(r"[a-zà-ɏ][Ͱ-ԯ]|[Ͱ-ԯ][a-zà-ɏ]")
# lower-case look-alikes in both directions; capitals that look alike are folded with their lower-case sound
_TO_LATIN = dict(zip((CYRILLIC_LIKE + GREEK_LIKE).lower(), (CYRILLIC_LATIN + GREEK_LATIN).lower(), strict=True))
_TO_LATIN |= dict(zip("аеорсухіјѕ", "aeopcyxijs", strict=True))
_TO_CYRILLIC = {"b": "в", "k": "к", "m": "м", "h": "н", "t": "т"} | dict(zip("aeopcyxo", "аеорсухо", strict=True))
_TO_CYRILLIC |= {g: _TO_CYRILLIC[_TO_LATIN[g]] for g in GREEK_LIKE.lower() if _TO_LATIN[g] in _TO_CYRILLIC}
_CYRILLIC_ONLY = re.compile(r"[бгджзийлпфцчшщъыьэюяёўқғҳ]")
_LATIN_ONLY = re.compile(r"[bdfghklmnqrtuvzşçöğ]")


def _one_script(text: str) -> str:
    """Spell each word in the one alphabet most of its own letters belong to."""
    last = "latin"

    def fix(match: re.Match) -> str:
        nonlocal last
        word = match.group()
        cyrillic, latin = len(_CYRILLIC_ONLY.findall(word)), len(_LATIN_ONLY.findall(word))
        kind = "cyrillic" if cyrillic > latin else "latin" if latin > cyrillic else last
        last = kind
        table = _TO_CYRILLIC if kind == "cyrillic" else _TO_LATIN
        return "".join(table.get(c, c) for c in word)

    return _WORD.sub(fix, text)


def word_keys(text: str) -> list[str]:
    """The words of `text` as keys that do not depend on the alphabet or on how characters are stored."""
    maps = _maps()
    if not text.isascii():
        text = maps["fold"](unicodedata.normalize("NFKC", maps["before"](text)))
    text = _TAG.sub(" ", text.lower())
    if _BOTH.search(text):
        text = _one_script(text)
    text = _KEYS(text)
    return _WORD.findall(text.replace("sh", "S").replace("ch", "C").replace("ts", "s").replace("ye", "e"))


_NAME = re.compile(r"(?<=[^\W\d_] )[A-ZŞÇÖĞА-ЯЁЎҚҒҲ][^\W\d_'`´‘’ʻʼʽʿ′]*(?:['`´‘’ʻʼʽʿ′][^\W\d_]+)*")


def name_keys(text: str) -> set[str]:
    """Keys of the words that `text` capitalises inside a sentence; none if it is all in capitals."""
    if text.upper() == text:
        return set()
    return {k for m in _NAME.finditer(unicodedata.normalize("NFC", text)) for k in word_keys(m.group())}


def _number(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def _name_numbers(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = np.array([_number(k) for k in set().union(*map(name_keys, batch["text"]))], dtype=np.uint64)
        yield pd.DataFrame({"name": found.view(np.int64)})


_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW)], dtype=np.uint64)


_NUMBER, _UNIT, _NAMED = map(_number, ("<number>", "<unit>", "<name>"))
_UPPER = "A-ZŞÇÖĞА-ЯЁЎҚҒҲ"
_TAG_ANY_CASE = re.compile(_TAG.pattern, re.I)
#: Marks before a word: capitalised, capitalised inside a sentence, continuing a number.
CAPITAL, INSIDE, JOINED = "\ue000", "\ue001", "\ue002"
_OWN_MARKS = str.maketrans(dict.fromkeys(CAPITAL + INSIDE + JOINED, " "))
_CAPITALISED = re.compile(rf"(?<![^\W_])(?=[{_UPPER}](?![{_UPPER}]))")
_INSIDE = re.compile(rf"(?<=[^\W\d_] )(?=[{_UPPER}])")
_GROUPED = re.compile(r"\d+(?:[.,]\d+)+|(?<!\d)\d{1,3}(?:\s\d{3})+(?!\d)(?:[.,]\d+)*")
_SEPARATOR = re.compile(r"(?<=\d)[.,\s](?=\d)")
_INNER_MARK = re.compile(rf"(?<=[^\W_])[{CAPITAL}{INSIDE}]+")
_MARKED_WORD = re.compile(rf"([{CAPITAL}{INSIDE}{JOINED}]*)([^\W_]+)")


def marked_keys(text: str) -> tuple[list[str], list[str]]:
    """The words of `word_keys` and the marks before each of them."""
    maps = _maps()
    if not text.isascii():
        text = maps["fold"](unicodedata.normalize("NFKC", maps["before"](text.translate(_OWN_MARKS))))
    text = _TAG_ANY_CASE.sub(" ", text)
    text = _GROUPED.sub(lambda m: _SEPARATOR.sub(r"\g<0>" + JOINED, m.group()), text)
    text = _CAPITALISED.sub(CAPITAL, _INSIDE.sub(INSIDE, text)).lower()
    if _BOTH.search(text):
        text = _one_script(text)
    text = _INNER_MARK.sub("", _KEYS(text))
    found = _MARKED_WORD.findall(text.replace("sh", "S").replace("ch", "C").replace("ts", "s").replace("ye", "e"))
    return [w for _, w in found], [m for m, _ in found]


def _whole_numbers(words: list[str], marks: list[str]) -> tuple[list[str], list[str]]:
    """Words and marks with the digit groups of a number put together."""
    out: list[str] = []
    for w, m in zip(words, marks, strict=True):
        if JOINED in m:
            out[-1] += "." + w
        else:
            out.append(w)
    return out, [m for m in marks if JOINED not in m]


class Templates:
    """Word keys to template numbers and window hashes, with a bounded cache of words."""

    CACHE = 500_000

    def __init__(self, names: np.ndarray, replaced: bool = True):
        """names: the sorted numbers of the known names; replaced: whether windows with other slots are sought too."""
        self.names, self.replaced, self.cache = names, replaced, {}

    def _look_up(self, words: list[str]) -> np.ndarray:
        """Number, number with numbers and units typed, and whether it is a known name, of each word."""
        new = [w for w in set(words) - self.cache.keys()]
        plain = np.fromiter(map(_number, new), dtype=np.uint64, count=len(new))
        known = np.isin(plain, self.names)
        for w, n, k in zip(new, plain.tolist(), known.tolist(), strict=True):
            self.cache[w] = (n, _NUMBER if w[0].isdigit() else _UNIT if w in UNITS else n, int(k))
        out = np.array([self.cache[w] for w in words], dtype=np.uint64).reshape(len(words), 3)
        if len(self.cache) > self.CACHE:
            self.cache.clear()
        return out

    def windows(self, docs: list[tuple[list[str], list[str]]], verbatim: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """Hash, whether it is a window to join, and the slot flags of the words (none: plain words), for each way to read the concatenated docs."""
        flat, marks = [w for d, _ in docs for w in d], [m for _, d in docs for m in d]
        n = max(len(flat) - WINDOW + 1, 0)
        if not n:
            return []
        plain, base, known = self._look_up(flat).T
        owner = np.repeat(np.arange(len(docs)), [len(d) for d, _ in docs])
        inside = owner[:n] == owner[WINDOW - 1 :]
        typed, named = base != plain, known == 1

        def hashed(numbers: np.ndarray) -> np.ndarray:
            hashes = np.zeros(n, dtype=np.uint64)
            for k in range(WINDOW):
                hashes += numbers[k : k + n] * _POWERS[k]
            return hashes

        if not self.replaced:
            # equal words have equal slots in the template of numbers, units and known names; slots alone are no template, so their words are hashed
            slots = typed | named
            total = np.concatenate([[0], np.cumsum(slots)])
            template = total[WINDOW:] - total[:-WINDOW] < WINDOW
            return [(np.where(template, hashed(np.where(named & ~typed, np.uint64(_NAMED), base)), hashed(plain)), inside, slots)]
        before = [hashed(plain)]
        out = [(before[0], inside, None)] if verbatim else []
        capital, middle = np.array([m != "" and m != JOINED for m in marks]), np.array([INSIDE in m for m in marks])
        for names in (named, named | middle, capital):
            slots = typed | names
            hashes, keep = hashed(np.where(names & ~typed, np.uint64(_NAMED), base)), inside
            for other in before:  # a window without slots, or read the same way already
                keep = keep & (hashes != other)
            if names is not named:  # slots alone are no template
                total = np.concatenate([[0], np.cumsum(slots)])
                keep = keep & (total[WINDOW:] - total[:-WINDOW] < WINDOW)
            before.append(hashes)
            out.append((hashes, keep, slots))
        return out


class WindowFilter:
    """A set of window hashes as a bit table: `may_hold` is true for every hash in the set and for few others."""

    def __init__(self, hashes: Iterable[int], total: int, bits: tuple[int, int] = FILTER_BITS):
        self.shift = np.uint64(64 - min(max(bits[0], (16 * total).bit_length()), bits[1]))
        self.table = np.zeros(1 << (64 - int(self.shift) - 3), dtype=np.uint8)
        hashes = iter(hashes)
        while len(part := np.fromiter(islice(hashes, 100_000), dtype=np.int64).view(np.uint64)):
            at = part >> self.shift
            np.bitwise_or.at(self.table, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return self.table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1) == 1


def _window_rows(batches: Iterable[pd.DataFrame], names: np.ndarray, wanted: WindowFilter | None, replaced: bool) -> Iterator[pd.DataFrame]:
    """Windows of a batch of (id, text): id, hash, words, slots (null for plain words); only those whose hash the filter may hold, if one is given."""
    templates = Templates(names, replaced)
    # a batch is taken in slices, so that the words of only so many texts are held at once
    slices = (batch.iloc[i : i + SLICE] for batch in batches for i in range(0, len(batch), SLICE))
    for batch in slices:
        codes, texts = pd.factorize(batch["text"])
        docs = [marked_keys(t) if replaced else (word_keys(t), []) for t in texts]
        split = [i for i, (_, marks) in enumerate(docs) if any(JOINED in m for m in marks)]
        rows = []
        for of, own, verbatim in ((range(len(docs)), docs, True), (split, [_whole_numbers(*docs[i]) for i in split], False)):
            first = np.cumsum([0] + [len(d) for d, _ in own])
            for hashes, keep, slots in templates.windows(own, verbatim):
                if wanted is not None:
                    keep = keep & wanted.may_hold(hashes)
                starts = np.flatnonzero(keep)
                for i, o in zip(starts, np.searchsorted(first, starts, side="right") - 1, strict=True):
                    words = own[o][0][i - first[o] : i - first[o] + WINDOW]
                    chosen = None if slots is None else " ".join(w for w, s in zip(words, slots[i : i + WINDOW], strict=True) if s)
                    rows.append((of[o], hashes[i : i + 1].view(np.int64)[0], " ".join(words), chosen))
        found = pd.DataFrame(rows, columns=["code", "h", "words", "slots"]).drop_duplicates()
        ids = pd.DataFrame({"code": codes, "id": batch["id"].to_numpy()})
        yield ids.merge(found, on="code")[["id", "h", "words", "slots"]]


def context_table(items: DataFrame, text_col: str = "context") -> DataFrame:
    """Distinct non-empty contexts with an id of their word keys; copies in other alphabets share the id."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = [" ".join(word_keys(t)) for t in batch["text"]]
            ids = [xxhash.xxh64_intdigest(k) - (1 << 63) for k in keys]
            yield pd.DataFrame({"text": batch["text"], "id": ids, "n_words": [k.count(" ") + 1 for k in keys]})

    texts = items.select(F.col(text_col).alias("text")).where("trim(text) <> ''").distinct()
    return texts.mapInPandas(run, "text string, id bigint, n_words int")


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "context", filter_bits: tuple[int, int] = FILTER_BITS, replaced: bool = True) -> DataFrame:
    """Documents with the evaluation items whose template windows they hold.

    Columns: doc_id, item_id, verbatim (windows with equal words), reparameterised (pairs of windows whose
    template is equal and whose slots are replaced one to one). The hashes of the items' windows are sent to the scan
    of the corpus as a filter of bounded size; only the windows it lets through, with their words, are shuffled to the
    join. The names of the contexts are sent along as sorted numbers, eight bytes each: a table of the
    evaluation set's size, not the corpus's. Without `replaced` only verbatim windows are sought: windows meet by
    their template of numbers, units and names, and the slot check asks for equal values in every slot; other
    readings of names, which only new values need, are not taken.
    """
    contexts = context_table(items, item_text)
    names = np.unique(np.array([r[0] for r in contexts.select("text").mapInPandas(_name_numbers, "name bigint").distinct().toLocalIterator()], dtype=np.int64).view(np.uint64))
    wanted_rows = materialise(contexts.select("id", "text").mapInPandas(lambda b: _window_rows(b, names, None, replaced), "id bigint, h bigint, words string, slots string").distinct())
    hashes = wanted_rows.select("h").distinct()
    wanted = WindowFilter((r[0] for r in hashes.toLocalIterator()), hashes.count(), filter_bits)
    texts = docs.select(F.col(doc_id).alias("id"), F.col(doc_text).alias("text")).where("text IS NOT NULL AND id IS NOT NULL")
    kind = docs.schema[doc_id].dataType.simpleString()
    hits = spread(texts).mapInPandas(lambda b: _window_rows(b, names, wanted, replaced), f"id {kind}, h bigint, words string, slots string")
    hits = hits.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    salted = wanted_rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # the words of equal templates differ in their slots alone; a hash may also bring others together, so the words are compared in full
    same = (F.col("d.words") == F.col("e.words")) & F.col("d.slots").eqNullSafe(F.col("e.slots"))
    if replaced:  # with slots, windows of equal words are counted by their plain hash
        same &= F.col("d.slots").isNull()
        other = (F.col("d.words") != F.col("e.words")) & F.coalesce(_one_to_one(F.col("d.slots"), F.col("e.slots")), F.lit(False))
    else:
        other = F.lit(False)
    found = (
        hits.alias("d")
        .join(salted.alias("e"), (F.col("d.h") == F.col("e.h")) & (F.col("d.salt") == F.col("e.salt")))
        .select(F.col("d.id").alias(doc_id), F.col("e.id").alias("context"), "d.words", F.col("e.words").alias("of"), same.alias("same"), other.alias("replaced"))
        .where("same OR replaced")
        .distinct()
        .groupBy(doc_id, "context")
        .agg(F.count_if("same").alias("verbatim"), F.count_if("replaced").alias("reparameterised"))
    )
    of_item = items.select(F.col(item_id).alias(item_id), F.col(item_text).alias("text")).where(F.col(item_id).isNotNull()).distinct().join(contexts.select("text", F.col("id").alias("context")), "text").select(item_id, "context").distinct()
    return found.join(of_item, "context").groupBy(doc_id, item_id).agg(F.max("verbatim").alias("verbatim"), F.max("reparameterised").alias("reparameterised"))


def _one_to_one(a, b):
    """Whether two slot lists have one length and replace each value by one other value and no two by the same."""
    x, y = F.split(a, " "), F.split(b, " ")
    both = F.size(F.array_distinct(F.arrays_zip(x.alias("x"), y.alias("y"))))
    return (F.size(x) == F.size(y)) & (F.size(F.array_distinct(x)) == both) & (F.size(F.array_distinct(y)) == both)
