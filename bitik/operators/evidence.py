"""How well a typed form agrees with a lexicon word of its skeleton, unit by unit.

A unit is a letter or a digraph with the apostrophes that belong to it. Form and word share a skeleton (or the
word begins with it), so their units stand side by side and every pair of units is judged by a table: the typed
unit shows the word's letter (1), leaves it open (0) or speaks against it (-1). An apostrophe beyond the letter
shows the word's tutuq, or speaks against a word without one. Everything is a column expression: the units of a
form are made once, those of a word once, and a pair costs one pass over two short arrays.

Null input gives null; a form without letters has no units and the evidence 0.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from bitik.functions import text as tx, translit as tr
from bitik.functions.alphabet import APOSTROPHES, TUTUQ

# For each unit of a word the typed units that show it; s'h is a divided pair, o+ a letter with its own mark.
SHOWN = {"ş": "ş sh w", "ç": "ç ch", "ö": "ö ó ő o+", "ğ": "ğ gh ǵ g+", "sh": "s'h", "ch": "c'h", "gh": "g'h"}
# The typed units that leave it open; all others speak against it.
OPEN = {"ş": "s", "ç": "c", "ö": "o", "ğ": "g", "sh": "sh", "ch": "ch", "gh": "gh", "s": "s", "c": "c", "o": "o", "g": "g"}
# The same for the Cyrillic letters behind a unit; a letter in neither table leaves it open.
CYRILLIC_SHOWN = {"ş": "ш", "s": "с", "ç": "ч", "ö": "ў", "ğ": "ғ", "q": "қ", "h": "ҳ", "sh": "сҳ", "gh": "гҳ"}
CYRILLIC_AGAINST = {"ş": "с ц", "s": "ш", "o": "ў", "g": "ғ", "sh": "с ш ц цҳ цх", "gh": "г ғ"}

UNITS = "array<struct<key:string,units:array<string>>>"


def _pairs(table: dict[str, str]) -> list[str]:
    return [f"{word}>{typed}" for word, all_typed in table.items() for typed in all_typed.split()]


def _steps(pieces: Column, *steps: tuple[str, str]) -> Column:
    def one(p: Column) -> Column:
        for pattern, to in steps:
            p = F.regexp_replace(p, pattern, to)
        return p

    return F.transform(pieces, one)


_INNER, _OUTER = ("'+h", "'h"), ("'+$", TUTUQ)


def _pieces(text: Column) -> Column:
    plain = F.translate(text, APOSTROPHES, "'" * len(APOSTROPHES))
    return F.regexp_extract_all(plain, F.lit("[scg]'*h'*|[^']'*"), F.lit(0))


def word_units(word: Column) -> Column:
    """The units of a canonical word; a tutuq stays at the end of its unit."""
    return _steps(_pieces(word), _INNER, _OUTER)


def latin_units(low: Column) -> Column:
    """The units of a lower-case Latin form; the first apostrophe after o and g is their own mark."""
    return _steps(_pieces(low), ("^([og])'(?!'*h)", "$1+"), _INNER, _OUTER)


def cyrillic_readings(low: Column, recovery: bool = True) -> Column:
    """Key and units of every reading of a Cyrillic form; its units are the Cyrillic letters they are read from."""
    letters = F.split(low, "")
    # every Latin letter carries the Cyrillic one behind it, so that readings can be cut into units of both
    tagged = F.transform(tr.cyrillic_options(low, recovery), lambda options, i: F.transform(options, lambda o: F.regexp_replace(o, F.lit("(.)"), F.concat(F.lit("$1"), F.get(letters, i)))))
    pair = F.lit(f"(?:{TUTUQ}.)+|[scg].(?:{TUTUQ}.)*h.(?:{TUTUQ}.)*|.{{2}}(?:{TUTUQ}.)*")

    def one(reading: Column) -> Column:
        pieces = F.filter(F.regexp_extract_all(reading, pair, F.lit(0)), lambda p: ~F.startswith(p, F.lit(TUTUQ)))
        units = _steps(pieces, (f"^(?:[scg](.)(?:{TUTUQ}.)*h|.)(.)({TUTUQ}?).*$", "$1$2$3"))
        return F.struct(tx.skeleton_key(F.regexp_replace(reading, "(.).", "$1")).alias("key"), units.alias("units"))

    return F.transform(tr.readings(tagged), one)


def readings(low: Column, cyrillic: Column, recovery: bool = True) -> Column:
    """Skeleton and units of every reading of a form: one of a Latin form, several of a Cyrillic one."""
    latin = F.array(F.struct(tx.skeleton_key(low).alias("key"), latin_units(low).alias("units")))
    return F.when(cyrillic, cyrillic_readings(low, recovery)).otherwise(latin).cast(UNITS)


def _judge(word: Column, typed: Column, cyrillic: Column) -> Column:
    """Evidence of the letter and of the tutuq of one pair of units."""
    letter, mark = F.rtrim(word, F.lit(TUTUQ)), F.endswith(word, F.lit(TUTUQ))
    form, rest = F.rtrim(typed, F.lit(TUTUQ)), F.endswith(typed, F.lit(TUTUQ))
    own = mark & (form == F.concat(letter, F.lit("+")))  # read as the word's tutuq
    rest = rest | own | (F.endswith(form, F.lit("+")) & (F.length(letter) > 1))  # a pair has no mark of its own
    pair = F.concat_ws(">", letter, form)
    latin = F.when(pair.isin(_pairs(SHOWN)), 1).when(own | pair.isin(_pairs(OPEN)), 0).when(letter.isin(list(OPEN)), -1).otherwise(0)
    pair = F.concat_ws(">", letter, F.when(F.length(letter) == 1, F.substring(form, 1, 1)).otherwise(form))
    cyr = F.when(pair.isin(_pairs(CYRILLIC_SHOWN)), 1).when(pair.isin(_pairs(CYRILLIC_AGAINST)), -1).otherwise(0)
    tutuq = F.when(rest, F.when(mark, 1).otherwise(-1)).otherwise(0)
    return F.struct(F.when(cyrillic, cyr).otherwise(latin).alias("letter"), tutuq.alias("tutuq"))


def evidence(typed: Column, word: Column, cyrillic: Column) -> Column:
    """Struct of sum and min over the typed units beside the word's first units."""
    judged = F.transform(typed, lambda t, i: _judge(F.get(word, i), t, cyrillic))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("min"))
    add = lambda a, j: F.struct((a["sum"] + j["letter"] + j["tutuq"]).alias("sum"), F.least(a["min"], j["letter"], j["tutuq"]).alias("min"))
    return F.aggregate(judged, start, add)
