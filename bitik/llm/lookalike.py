"""Problem 7: one consistent form for text that looks the same but is stored with different characters.

`canonical_texts` is compatibility normalisation in composed form with mapped white space and without
default-ignorable characters, plus the look-alike folds of this project, run over the distinct values of
each Arrow batch. With `casefold=True` it ends with full case folding, the form for caseless comparison.
Raised, lowered and circled characters are visible and stay as they are.

Defined results: a null text has the form null; an empty text has the form "".
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from bitik.functions.alphabet import APOSTROPHES, FOLD_FROM, FOLD_TO, TUTUQ
from bitik.llm.charmap import CharMap
from bitik.operators import skew
from bitik.session import materialise, spread

# Unicode's default-ignorable code points, as ranges.
IGNORABLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
# Other spellings of a line break, and hyphens that look like the ASCII one.
LINE_BREAKS = "\x0b\x0c\x85  "
HYPHENS = "‐‑‒⁃−˗﹣－"
# Letters of Cyrillic and Greek that look like the Latin letter below them.
CYRILLIC_LIKE = "аеорсухіјѕԁԛԝӏАВЕКМНОРСТУХІЈЅԌԚԜӀҮ"
CYRILLIC_LATIN = "aeopcyxijsdqwlABEKMHOPCTYXIJSGQWIY"
GREEK_LIKE = "ονιαρυκϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ"
GREEK_LATIN = "oviapukjABEZHIKMNOPTYXC"

_MAPS: dict[str, CharMap] = {}


def _maps() -> dict[str, CharMap]:
    """The tables before and after normalisation, built once a process from Unicode's own data."""
    if not _MAPS:
        before: dict[int, str | None] = {c: None for lo, hi in IGNORABLE for c in range(lo, hi + 1)}
        visible: dict[int, str] = {}
        for c in range(0x80, 0x20000):
            ch = chr(c)
            kind = unicodedata.decomposition(ch).partition(" ")[0]
            if kind in ("<super>", "<sub>", "<circle>"):
                visible[c] = chr(0xF0000 + len(visible))  # private use, so normalisation leaves it alone
            elif unicodedata.category(ch) == "Zs":
                before[c] = " "
        before |= visible | dict.fromkeys(map(ord, LINE_BREAKS), "\n") | dict.fromkeys(map(ord, HYPHENS), "-")
        before |= {ord(c): TUTUQ for c in APOSTROPHES} | {ord("\t"): " "}
        after: dict[int, str] = dict(zip(map(ord, CYRILLIC_LIKE + GREEK_LIKE), CYRILLIC_LATIN + GREEK_LATIN, strict=True))
        after |= {ord(c): TUTUQ for c in APOSTROPHES}
        # composed letters in the same step: what their decomposed, mapped and composed form is
        for c in range(0x80, 0x2000):
            one = unicodedata.normalize("NFC", unicodedata.normalize("NFKD", chr(c)).translate(after))
            if c not in after and unicodedata.category(chr(c))[0] == "L" and one != chr(c):
                after[c] = one
        after |= {ord(v): chr(k) for k, v in visible.items()}
        fold = dict(zip(map(ord, FOLD_FROM), FOLD_TO, strict=True))
        _MAPS.update(before=CharMap(before), fold=CharMap(fold), after=CharMap(after))
    return _MAPS


_FOLDED = re.compile(f"[{FOLD_FROM}]")
_NOT_PLAIN = re.compile(r"[^\x00-\x0a\x0e-\x7f]")


def canonical(text: str, casefold: bool = False) -> str:
    """The one form of `text`."""
    maps = _maps()
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if _NOT_PLAIN.search(text):
        text = unicodedata.normalize("NFKC", maps["before"](text))
        if _FOLDED.search(text):
            text = maps["fold"](text)
        text = unicodedata.normalize("NFC", maps["after"](text))
    else:
        text = text.replace("\t", " ").replace("'", TUTUQ).replace("`", TUTUQ)
    return unicodedata.normalize("NFC", text.casefold()) if casefold else text


def canonical_texts(texts: pd.Series, casefold: bool = False) -> pd.Series:
    """Canonical forms of a batch: each distinct value is normalised once."""
    codes, values = pd.factorize(texts)
    forms = [canonical(v, casefold) for v in values]
    return pd.Series([None if c < 0 else forms[c] for c in codes], index=texts.index, dtype=object)


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", casefold: bool = False) -> DataFrame:
    """One row a document with text: its id, 128-bit hash of the canonical form and of the stored text.

    Texts leave the scan only into the normaliser; from there on only 32 bytes a document move.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes, values = pd.factorize(batch["text"])
            form, raw = [_digest(canonical(v, casefold)) for v in values], [_digest(v) for v in values]
            yield pd.DataFrame({"id": batch["id"], "form": [form[c] for c in codes], "raw": [raw[c] for c in codes]})

    rows = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL AND id IS NOT NULL"))
    return rows.mapInPandas(run, f"id {df.schema[id_col].dataType.simpleString()}, form binary, raw binary")


def canonical_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", casefold: bool = False) -> DataFrame:
    """Every row's canonical text: id, canonical_text, changed. Null text: null form, changed false."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            forms = canonical_texts(batch["text"], casefold)
            same = [a is None or a == b for a, b in zip(forms, batch["text"], strict=True)]
            yield pd.DataFrame({"id": batch["id"], "canonical_text": forms, "changed": [not s for s in same]})

    rows = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, canonical_text string, changed boolean").withColumnRenamed("id", id_col)


#: Copies of one stored text are spread over this many parts before they meet their partners.
SALTS = 16


def look_alike_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", casefold: bool = False) -> DataFrame:
    """One row a document whose text has a look-alike: id, class_id, stored_id, n_links.

    Documents of one class look the same, those of one stored_id are equal as stored; both are the first 128 bits of a
    hash, as hexadecimal text. n_links is the number of documents that look the same but are stored differently. With
    `casefold` letter case makes no difference either. Counts of members are taken by (form, raw) before any join, so
    a class with a third of all documents is one row until its size is joined back to its members.
    """
    prints = materialise(fingerprints(df, id_col, text_col, casefold))
    stored = materialise(prints.groupBy("form", "raw").agg(F.count("*").alias("n")))
    forms = stored.groupBy("form").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where("kinds > 1").select("form", "total")
    links = stored.join(forms, "form").select(F.hex("raw").alias("key"), F.hex("form").alias("class_id"), (F.col("total") - F.col("n")).alias("n_links"))
    members = prints.select("id", F.hex("raw").alias("stored_id"))
    found = skew.lookup(members, "stored_id", links, skew.hot_keys(members, "stored_id")).where("class_id IS NOT NULL")
    return found.select(F.col("id").alias(id_col), "class_id", "stored_id", "n_links")


def look_alike_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs (a < b) of ids whose texts differ as stored but have the same canonical form.

    The pairs are expanded from the classes of `look_alike_classes`, because every pair of members is asked for; members
    meet in salted parts. Rows with a null id or text are left out; equal ids never pair with themselves.
    """
    members = materialise(look_alike_classes(df, id_col, text_col).select(F.col(id_col).alias("id"), "class_id", "stored_id"))
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    left = members.select("class_id", salt.alias("salt"), F.col("id").alias("id_a"), F.col("stored_id").alias("stored_a"))
    right = members.select("class_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.col("id").alias("id_b"), F.col("stored_id").alias("stored_b"))
    both = left.join(right, ["class_id", "salt"]).where("stored_a <> stored_b AND id_a < id_b")
    return both.select(F.col("id_a").alias(f"{id_col}_a"), F.col("id_b").alias(f"{id_col}_b")).distinct()
