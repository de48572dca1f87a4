"""Column functions of the orthography: normalisation, tokens, scripts, letter case, skeleton keys.

Everything is built from Spark's own expressions, except composition to NFC, which sees only the texts
that hold a combining mark or another character that composition changes.
Null input gives null output throughout.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from bitik.functions.alphabet import APOSTROPHES, FOLD_FROM, FOLD_TO, JS_SPACE

APOS = "['`´‘’ʻʼʽʿ′]"
#: A letter or mark that is not itself an apostrophe.
LETTER = r"[\p{L}\p{M}&&[^ʻʼʽʿ]]"
DIGIT = r"[\p{Nd}\p{No}_]"
# A token is letters joined by apostrophes; it may end in an apostrophe after o or g, or in a tutuq. A token
# that opens after an apostrophe is quoted and takes no such end after o or g.
TOKEN = (
    rf"(?<!{APOS})(?<!{LETTER}){LETTER}++(?:{APOS}+{LETTER}+)*+(?:(?<=[oOgG]){APOS}|ʼ)?"
    rf"|(?<={APOS})(?<!{LETTER}){LETTER}++(?:{APOS}+{LETTER}+)*+(?:(?<![oOgG])ʼ)?"
)
GLUED = ""
# The top-level domains that make a run of characters an address.
TLDS = "uz|com|ru|org|net|io|me|info|tv|gov|edu|app|dev|ai|co|su|kz|tj|kg|tm|tr|de|uk|us|biz|pro|online|site|xyz"
ANCHOR = rf"(?i)://|(?<![\p{{L}}\p{{N}}_])www\.|[@#][\p{{L}}\p{{N}}_]|\.(?:{TLDS})(?![\p{{L}}\p{{N}}_])"
BREAK = r"[.!?…\n]"
_COMPOSABLE = r"[\p{M}\x{0374}\x{037e}\x{0387}\x{1f00}-\x{1fff}\x{2000}\x{2001}\x{2126}\x{212a}\x{212b}\x{2329}\x{232a}\x{f900}-\x{faff}]"


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Composed form; texts without anything to compose are not sent to Python."""
    return F.coalesce(_nfc(F.when(text.rlike(_COMPOSABLE), text)), text)


def fold_confusables(text: Column) -> Column:
    return F.translate(text, FOLD_FROM, FOLD_TO)


def normalize(text: Column) -> Column:
    """Composition, then the fold of confusable letters. Apostrophes stay."""
    return fold_confusables(nfc(text))


def strip_apostrophes(text: Column) -> Column:
    return F.translate(text, APOSTROPHES, "")


def runs(text: Column) -> Column:
    """Alternating runs of white space and of other characters, covering the text."""
    return F.regexp_extract_all(text, F.lit(f"[{JS_SPACE}]+|[^{JS_SPACE}]+"), F.lit(0))


def is_protected_run(run: Column) -> Column:
    """A run that holds an address, mention or hashtag."""
    return run.rlike(ANCHOR)


def blank_protected(text: Column) -> Column:
    """The text with every protected run blanked; a text without any is not taken apart."""
    blanked = F.array_join(F.transform(runs(text), lambda r: F.when(is_protected_run(r), F.lit(" ")).otherwise(r)), "")
    return F.when(is_protected_run(text), blanked).otherwise(text)


def mark_glued(text: Column) -> Column:
    """P5: tokens beside a digit or underscore become one marker each."""
    marked = F.regexp_replace(text, rf"(?<={DIGIT})(?>{TOKEN})|(?>{TOKEN})(?={DIGIT})", GLUED)
    return F.when(text.rlike(f"{DIGIT}{LETTER}|{LETTER}{APOS}?{DIGIT}"), marked).otherwise(text)


def tokens_of(text: Column) -> Column:
    """The tokens of a text in order; a glued one is GLUED."""
    return F.regexp_extract_all(mark_glued(text), F.lit(f"{TOKEN}|{GLUED}"), F.lit(0))


def current_word(text: Column) -> Column:
    """Struct of the unfinished token at the end of a text ("" if it does not end in one), its place, and the token before it."""
    # bound once by a transform over one array
    bound = F.transform(F.array(F.struct(text.alias("t"), F.filter(tokens_of(text), lambda w: w != GLUED).alias("w"))), _last_two)
    return F.get(bound, F.lit(0))


def _last_two(x: Column) -> Column:
    last = F.try_element_at(x["w"], F.lit(-1))
    open_ = F.coalesce(F.endswith(x["t"], last), F.lit(False))
    buffer = F.when(open_, last).otherwise("")
    prev = F.when(open_, F.try_element_at(x["w"], F.lit(-2))).otherwise(last)
    return F.struct(buffer.alias("buffer"), (F.length(x["t"]) - F.length(buffer)).alias("start"), prev.alias("prev"))


def segments_of(run: Column) -> Column:
    """Pieces that cover one run exactly: tokens, and single other characters."""
    return F.regexp_extract_all(run, F.lit(rf"{TOKEN}|[\s\S]"), F.lit(0))


def is_token(piece: Column) -> Column:
    return piece.rlike(f"^{LETTER}")


def letters_of(token: Column) -> Column:
    """The letters of a token, without marks and apostrophes."""
    return F.regexp_replace(token, r"[^\p{L}]|[ʻʼʽʿ]", "")


def script_of_letters(letters: Column) -> Column:
    cyrillic = letters.rlike(r"[\x{0400}-\x{052f}]")
    latin = letters.rlike(r"[\x{0000}-\x{007f}\x{00c0}-\x{024f}\x{1e00}-\x{1eff}]")
    other = letters.rlike(r"[^\x{0400}-\x{052f}\x{0000}-\x{007f}\x{00c0}-\x{024f}\x{1e00}-\x{1eff}]")
    return F.when(other | (cyrillic & latin), "mixed").when(cyrillic, "cyrillic").when(letters.isNotNull(), "latin")


def case_of_letters(w: Column) -> Column:
    first, rest = F.substring(w, 1, 1), F.substr(w, F.lit(2))
    return (
        F.when(w == F.lower(w), "lower")
        .when(w == F.upper(w), F.when(F.length(w) == 1, "title").otherwise("upper"))
        .when((first == F.upper(first)) & (rest == F.lower(rest)), "title")
        .when(w.isNotNull(), "mixed")
    )


def detect_script(token: Column) -> Column:
    """Latin, cyrillic or mixed; letters of a third script make it mixed."""
    return script_of_letters(letters_of(token))


def case_pattern(token: Column) -> Column:
    """Lower, title, upper or mixed over the letters; one capital alone is title."""
    return case_of_letters(letters_of(token))


def letter_count(token: Column) -> Column:
    return F.length(strip_apostrophes(token))


# Letter classes of the skeleton.
CLASS_FROM, CLASS_TO = "sşwcçoöóőgğǵ", "SSSCCOOOOGGG"


def skeleton_key(word: Column) -> Column:
    """P10: the form of a lower-case Latin word without any distinction that a keyboard can lose."""
    k = strip_apostrophes(word)
    for pair in ("sh", "ch", "gh"):
        k = F.replace(k, F.lit(pair), F.lit(pair[0].upper()))
    return F.translate(k, CLASS_FROM, CLASS_TO)


def is_marked(word: Column) -> Column:
    return word.rlike("[şçöğʼ]")


def is_packable(word: Column) -> Column:
    return word.rlike("^[a-zşçöğʼ]{1,255}$")


def bare(word: Column) -> Column:
    """Every mark removed."""
    return F.translate(word, "şçöğʼ", "scog")


def ascii_form(word: Column) -> Column:
    """As typed on a plain keyboard with digraphs."""
    return F.translate(F.replace(F.replace(word, F.lit("ş"), F.lit("sh")), F.lit("ç"), F.lit("ch")), "öğʼ", "og")


def stripped_pattern(word: Column) -> Column:
    """A regular expression of all forms of `word` with some marks removed."""
    out = word
    for a, b in (("ş", "[şs]"), ("ç", "[çc]"), ("ö", "[öo]"), ("ğ", "[ğg]"), ("ʼ", "ʼ?")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.concat(F.lit("^"), out, F.lit("$"))


def russian_layout(text: Column) -> Column:
    """Cyrillic as typed without the four Uzbek letters."""
    return F.translate(text, "ўқғҳЎҚҒҲ", "укгхУКГХ")


def utf8_order(word: Column) -> Column:
    """Order of the packed lexicon: marked letters after plain ones, in the order ş ç ö ğ ʼ."""
    return F.translate(word, "şçöğʼ", "\u0080\u0081\u0082\u0083\u0084")


def heldout(text: Column) -> Column:
    """Whether the sha-1 of a text, as a number, is divisible by ten.

    Powers of 16 end in 6, so the last digit of the number is that of the last hexadecimal digit plus six
    times the sum of the others.
    """
    digits = F.split(F.sha1(text), "")
    value = F.aggregate(F.transform(digits, _hex), F.lit(0), lambda acc, d: acc + d)
    last = _hex(F.element_at(digits, -1))
    return (last + 6 * (value - last)) % 10 == 0


def _hex(digit: Column) -> Column:
    return F.conv(digit, 16, 10).cast("int")


def quantise(count: Column, top: Column) -> Column:
    """ln(count) on a scale of 1 to 255, 0 if absent."""
    scale = F.lit(255.0) / F.log(F.greatest(F.lit(2.0), top.cast("double")))
    return F.when(count > 0, F.greatest(F.lit(1.0), F.least(F.lit(255.0), F.rint(F.log(count.cast("double")) * scale)))).otherwise(F.lit(0.0)).cast("int")


def cut(text: Column, n: int) -> Column:
    """The first n characters (code points)."""
    return F.substring(text, 1, n)


def html_escape(text: Column) -> Column:
    """P46."""
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def marks_in(text: Column) -> Column:
    """Letters of the new alphabet that cost two key presses each."""
    return F.regexp_count(text, F.lit("[şçöğʼŞÇÖĞ]"))


def quoted_word(text: Column) -> Column:
    """The first word between double quotes."""
    return F.regexp_extract(text, '"([^"]+)"', 1)


def same_letters(a: Column, b: Column) -> Column:
    """Equal up to the kind of apostrophe."""
    marks = "'" * len(APOSTROPHES)
    return F.translate(a, APOSTROPHES, marks) == F.translate(b, APOSTROPHES, marks)

