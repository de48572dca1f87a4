"""Column functions of script conversion: new Latin, old Latin and Cyrillic, with all readings of a token."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from bitik.functions.alphabet import APOSTROPHES, OKINA, TUTUQ
from bitik.functions.text import APOS, case_pattern, fold_confusables, skeleton_key

# One Latin spelling for each Cyrillic letter that has one whatever its neighbours.
CYRILLIC = dict(zip("абвгджзийклмнопрстуфхчшўқғҳэёюя", "a b v g d j z i y k l m n o p r s t u f x ç ş ö q ğ h e yo yu ya".split(), strict=True))
# Cyrillic letters outside the Uzbek alphabet.
FOREIGN = dict(zip("щыәөүұңіїєґҗҷӣѓќђћљњџјѕӂӑӗҫ", "ş i a ö u u ng i yi ye g j j i g k d ç l n j y z j a e s".split(), strict=True))
FOREIGN_CLASS = "[щыәөүұңіїєґҗҷӣѓќђћљњџјѕӂӑӗҫ]"
CYRILLIC_VOWELS = "аеёиоуэюяў"
# Letters that a Russian keyboard types for two Uzbek ones.
RECOVERY = {"у": ("u", "ö"), "к": ("k", "q"), "х": ("x", "h")}
READING_LIMIT = 4096
# private-use characters stand for finished letter pairs while rules still run
_SH, _YE, _TS = "\ue000", "\ue006", "\ue007"


def _single(table: dict[str, str]) -> tuple[str, str]:
    """The one-letter entries of a table as arguments of translate()."""
    return "".join(k for k, v in table.items() if len(v) == 1), "".join(v for v in table.values() if len(v) == 1)


_SINGLE = _single(CYRILLIC)



def _letter(chars: Column, c: Column, i: Column) -> Column:
    """The Latin spelling of the Cyrillic letter c at place i of chars."""
    before, after = F.get(chars, i - 1), F.get(chars, i + 1)
    after_vowel = before.rlike(f"[{CYRILLIC_VOWELS}ъь]|{APOS}")
    out = (
        F.when(c == "е", F.when(before.isNull() | after_vowel, "ye").otherwise("e"))
        .when(c == "ц", F.when(before.rlike(f"[{CYRILLIC_VOWELS}]"), "ts").otherwise("s"))
        .when((c == "ъ") | c.rlike(APOS), F.when(after.rlike("[еёюя]"), "").otherwise(TUTUQ))
        .when(c == "ь", F.when(after == "о", "y").otherwise(""))
    )
    for letter, value in CYRILLIC.items():
        if len(value) > 1:
            out = out.when(c == letter, value)
    return out


def cyrillic_options(low: Column, recovery: bool = True) -> Column:
    """For each letter of a lower-case Cyrillic token, the array of its possible Latin spellings."""
    chars = F.split(low, "")

    def options(c: Column, i: Column) -> Column:
        single = F.array(F.coalesce(_letter(chars, c, i), F.translate(c, *_SINGLE)))
        if not recovery:
            return single
        out = F.when(c == "у", F.array(F.lit("u"), F.lit("ö")))
        out = out.when(c == "к", F.array(F.lit("k"), F.lit("q"))).when(c == "х", F.array(F.lit("x"), F.lit("h")))
        return out.otherwise(single)

    return F.transform(chars, options)


def cyrillic_to_new(low: Column) -> Column:
    """A lower-case Cyrillic word in new Latin; letters outside the alphabet stay.

    A chain of replacements: letters that depend on their neighbours come first, while those still stand.
    """
    out = F.regexp_replace(low, f"(?<=[{CYRILLIC_VOWELS}])ц", _TS)
    out = F.regexp_replace(out, f"(?:^|(?<=[{CYRILLIC_VOWELS}ъь'`´‘’ʻʼʽʿ′]))е", _YE)
    out = F.regexp_replace(out, f"[ъ'`´‘’ʻʼʽʿ′](?=[еёюя{_YE}])", "")
    out = F.regexp_replace(F.translate(out, "ъ" + APOSTROPHES, TUTUQ * (1 + len(APOSTROPHES))), "ь(?=о)", "y")
    out = F.translate(out, _SINGLE[0] + "ець", _SINGLE[1] + "es")
    for mark, pair in ((_TS, "ts"), (_YE, "ye"), ("ё", "yo"), ("ю", "yu"), ("я", "ya")):
        out = F.replace(out, F.lit(mark), F.lit(pair))
    return out


def has_foreign_cyrillic(low: Column) -> Column:
    return low.rlike(FOREIGN_CLASS)


def cyrillic_rule(low: Column) -> Column:
    """Any Cyrillic in new Latin, letters outside the Uzbek alphabet included."""
    out = cyrillic_to_new(low)
    for a, b in FOREIGN.items():
        if len(b) > 1:
            out = F.replace(out, F.lit(a), F.lit(b))
    return F.translate(out, *_single(FOREIGN))


def old_to_new(low: Column) -> Column:
    """Old Latin in new Latin; a literal s and h that an apostrophe divides stays s h."""
    out = F.regexp_replace(low, f"s{APOS}h", "")
    out = F.replace(F.replace(out, F.lit("sh"), F.lit("ş")), F.lit("ch"), F.lit("ç"))
    out = F.regexp_replace(F.regexp_replace(out, f"o{APOS}", "ö"), f"g{APOS}", "ğ")
    return F.replace(literal(out), F.lit(""), F.lit("sh"))


def literal(low: Column) -> Column:
    """Every apostrophe as a tutuq."""
    return F.translate(low, APOSTROPHES, TUTUQ * len(APOSTROPHES))


def new_to_old(word: Column) -> Column:
    """P16."""
    out = F.replace(word, F.lit("sh"), F.lit("s" + TUTUQ + "h"))
    for a, b in (("ş", "sh"), ("ç", "ch"), ("ö", "o" + OKINA), ("ğ", "g" + OKINA)):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


# The Cyrillic letter of each letter of new Latin.
LATIN_FROM, LATIN_TO = "abdfgijklmnopqrstuvxyzhşçöğʼcw", "абдфгижклмнопқрстувхйзҳшчўғъкв"
# Accented letters and their base.
ACCENTED, BASE = "áàâäãåéèêëíìîïóòôõőúùûüýñńǵčšžćśźłđřťďě", "aaaaaaeeeeiiiiooooouuuuynngcszcszldrtde"
_IOTATED = {"ye": "", "yo": "", "yu": "", "ya": ""}


def new_to_cyrillic(word: Column) -> Column:
    """A lower-case new Latin word in Cyrillic; every Latin letter gets a Cyrillic one."""
    out = F.translate(word, ACCENTED, BASE)
    out = F.regexp_replace(out, "c(?=[eiy])", "ц")
    out = F.regexp_replace(out, "(?<=[^aeiouöʼ])ye", "")
    for pair, mark in _IOTATED.items():
        out = F.replace(out, F.lit(pair), F.lit(mark))
    out = F.regexp_replace(out, "(?:^|(?<=[aeiouö\ue001-\ue005]))e", "э")
    out = F.translate(F.translate(out, LATIN_FROM, LATIN_TO), "e", "е")
    return F.translate(F.replace(out, F.lit(""), F.lit("ъе")), "", "еёюя")


def apply_case(s: Column, pattern: Column) -> Column:
    """P18."""
    return F.when(pattern == "upper", F.upper(s)).when(pattern == "title", F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2)))).otherwise(s)


def canonical(low: Column, source: str) -> Column:
    """The reading of a lower-case token written in `source`: new, old or cyrillic."""
    return {"cyrillic": cyrillic_rule, "old": old_to_new, "new": literal}[source](low)


def render(word: Column, script: str, pattern: Column, exception: Column | None = None) -> Column:
    """A canonical word in an output script and letter case; `exception` is its listed Cyrillic spelling, if any."""
    out = {"old": new_to_old, "cyrillic": new_to_cyrillic, "new": lambda w: w}[script](word)
    return apply_case(out if exception is None else F.coalesce(exception, out), pattern)


def readings(options: Column, limit: int = READING_LIMIT) -> Column:
    """AR1: every spelling that picks one option at each place; beyond the limit only the first options."""
    count = F.aggregate(options, F.lit(1).cast("double"), lambda n, o: n * F.size(o))
    use = F.when(count > limit, F.transform(options, lambda o: F.slice(o, 1, 1))).otherwise(options)
    return F.aggregate(use, F.array(F.lit("")), lambda acc, o: F.flatten(F.transform(acc, lambda p: F.transform(o, lambda x: F.concat(p, x)))))


def _either(pair: str):
    """A function from a key to all keys with either letter of the pair wherever one of them stands."""
    a, b = F.lit(pair[0]), F.lit(pair[1])
    return lambda key: readings(F.transform(F.split(key, ""), lambda c: F.when((c == a) | (c == b), F.array(a, b)).otherwise(F.array(c))))


def skeleton_keys(token: Column, script: Column, recovery: bool = True, fuzzy_qk: bool = False, fuzzy_xh: bool = False) -> Column:
    """The sorted set of keys of a token."""
    low = F.lower(fold_confusables(token))
    keys = F.when(script == "cyrillic", F.transform(readings(cyrillic_options(low, recovery)), skeleton_key)).otherwise(F.array(skeleton_key(low)))
    for wanted, pair in ((fuzzy_qk, "qk"), (fuzzy_xh, "xh")):
        if wanted:
            keys = F.flatten(F.transform(keys, _either(pair)))
    return F.array_sort(F.array_distinct(keys))


def rule_token(raw: Column, to: str, source: str = "old") -> Column:
    """P20: transliteration of one token without correction.

    A token with letters of a third script, or already in the target script, comes back as typed. Mixed
    case or script is converted run by run, a run being letters of one script and case with what follows them.
    """
    text = fold_confusables(raw)
    low = F.lower(text)
    cyrillic, latin = low.rlike(r"[\x{0400}-\x{052f}]"), low.rlike(r"[a-zÀ-ɏḀ-ỿ]")
    other = F.regexp_replace(low, r"[\x{0400}-\x{052f}A-Za-zÀ-ɏḀ-ỿʻʼʽʿ]", "").rlike(r"\p{L}")
    cy_lo, cy_up = r"[\x{0400}-\x{052f}&&\p{Ll}]", r"[\x{0400}-\x{052f}&&\p{Lu}]"
    la_lo, la_up = r"[\p{Ll}&&[^\x{0400}-\x{052f}]]", r"[\p{Lu}&&[^\x{0400}-\x{052f}]]"
    rest = r"(?:[^\p{L}]|[ʻʼʽʿ])"
    pieces = F.regexp_extract_all(text, F.lit("|".join(f"(?:{c}{rest}*)+" for c in (cy_lo, cy_up, la_lo, la_up)) + f"|{rest}+"), F.lit(0))
    one = lambda s: _simple_rule(s, to, source)
    mixed = (case_pattern(raw) == "mixed") | (cyrillic & latin)
    out = F.when(mixed & (F.size(pieces) > 1), F.array_join(F.transform(pieces, one), "")).otherwise(one(text))
    as_typed = other | ~(cyrillic | latin) | (~latin if to == "cyrillic" else (~cyrillic if to == "new" else F.lit(False)))
    marks = "'" * len(APOSTROPHES)
    same = F.lower(F.translate(out, APOSTROPHES, marks)) == F.translate(low, APOSTROPHES, marks)
    return F.when(as_typed | same, raw).otherwise(out)


def _simple_rule(text: Column, to: str, source: str) -> Column:
    low = F.lower(text)
    cyrillic, latin = low.rlike(r"[\x{0400}-\x{052f}]"), low.rlike(r"[a-zÀ-ɏḀ-ỿ]")
    canon = F.when(cyrillic, cyrillic_rule(low)).otherwise(literal(low) if source == "new" else old_to_new(low))
    pattern = case_pattern(text)
    out = render(canon, to, F.when(pattern == "mixed", "lower").otherwise(pattern))
    keep = ~(cyrillic | latin) | (~latin if to == "cyrillic" else (~cyrillic if to == "new" else F.lit(False)))
    return F.when(keep, text).otherwise(out)
