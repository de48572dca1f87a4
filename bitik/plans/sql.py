"""SQL for the oracle: the orthography's rules as expressions and tables of the checking engine.

The rules are stated here a second time, in another way than in the column functions, so that a comparison says something.
"""

from __future__ import annotations

import unicodedata

from bitik.functions.alphabet import APOSTROPHES, FOLD_FROM, FOLD_TO
from bitik.functions.text import TLDS
from bitik.functions.translit import ACCENTED, BASE, CYRILLIC, FOREIGN, LATIN_FROM, LATIN_TO

A = "[''`´‘’ʻʼʽʿ′]"
L = r"[\p{Lu}\p{Ll}\p{Lt}\p{Lo}\p{M}]"
D = r"[\p{Nd}\p{No}_]"
SPACE = r"\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
ANCHOR = rf"(?i)://|(?:^|[^\p{{L}}\p{{N}}_])www\.|[@#][\p{{L}}\p{{N}}_]|\.(?:{TLDS})(?:[^\p{{L}}\p{{N}}_]|$)"
_APOS = APOSTROPHES.replace("'", "''")
_TEN = "ʼ" * 10


def normalize(x: str) -> str:
    return f"translate(nfc_normalize({x}), '{FOLD_FROM}', '{FOLD_TO}')"


def literal(x: str) -> str:
    return f"translate({x}, '{_APOS}', '{_TEN}')"


def letters(x: str) -> str:
    return rf"regexp_replace({x}, '[^\p{{L}}]|[ʻʼʽʿ]', '', 'g')"


def case_pattern(x: str) -> str:
    w = letters(x)
    return (
        f"(CASE WHEN {x} IS NULL THEN NULL WHEN {w} = lower({w}) THEN 'lower' WHEN {w} = upper({w}) THEN CASE WHEN length({w}) = 1 THEN 'title' ELSE 'upper' END "
        f"WHEN {w}[1:1] = upper({w}[1:1]) AND {w}[2:] = lower({w}[2:]) THEN 'title' ELSE 'mixed' END)"
    )


def script(x: str) -> str:
    w = letters(x)
    return (
        rf"(CASE WHEN {x} IS NULL THEN NULL WHEN regexp_matches({w}, '[^\x{{400}}-\x{{52f}}\x{{0}}-\x{{7f}}\x{{c0}}-\x{{24f}}\x{{1e00}}-\x{{1eff}}]') THEN 'mixed' "
        rf"WHEN regexp_matches({w}, '[\x{{400}}-\x{{52f}}]') THEN CASE WHEN regexp_matches({w}, '[\x{{0}}-\x{{7f}}\x{{c0}}-\x{{24f}}\x{{1e00}}-\x{{1eff}}]') THEN 'mixed' ELSE 'cyrillic' END ELSE 'latin' END)"
    )


def key(x: str) -> str:
    """Digraphs first, then one class a letter."""
    x = f"translate({x}, '{_APOS}', '')"
    return f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, 'sh|ş|w', 'S', 'g'), 'ch|ç', 'C', 'g'), 'gh|ğ|ǵ|g', 'G', 'g'), '[oöóő]', 'O', 'g'), 's', 'S', 'g'), 'c', 'C', 'g')"


def old_to_new(x: str) -> str:
    """One piece at a time: the pieces are the digraphs, the letters with their mark and single characters."""
    pieces = f"regexp_extract_all({x}, 's{A}h|sh|ch|[og]{A}|(?s:.)')"
    return (
        f"array_to_string(list_transform({pieces}, lambda p: CASE WHEN p = 'sh' THEN 'ş' WHEN p = 'ch' THEN 'ç' WHEN length(p) = 3 THEN 'sh' "
        f"WHEN length(p) = 2 THEN CASE p[1:1] WHEN 'o' THEN 'ö' ELSE 'ğ' END ELSE {literal('p')} END), '')"
    )


def new_to_old(x: str) -> str:
    pieces = f"regexp_extract_all({x}, 'sh|(?s:.)')"
    return f"array_to_string(list_transform({pieces}, lambda p: CASE p WHEN 'sh' THEN 'sʼh' WHEN 'ş' THEN 'sh' WHEN 'ç' THEN 'ch' WHEN 'ö' THEN 'oʻ' WHEN 'ğ' THEN 'gʻ' ELSE p END), '')"


def _chars(x: str) -> str:
    return f"regexp_extract_all({x}, '(?s:.)')"


def _latin_letter(chars: str) -> str:
    """The Latin spelling of letter c at place i of a list of Cyrillic letters."""
    vowels = "аеёиоуэюяў"
    one, two = [(k, v) for k, v in CYRILLIC.items() if len(v) == 1], [(k, v) for k, v in CYRILLIC.items() if len(v) > 1]
    prev, nxt = f"({chars})[i - 1]", f"({chars})[i + 1]"
    return (
        f"CASE WHEN c = 'е' THEN CASE WHEN i = 1 OR regexp_matches({prev}, '[{vowels}ъь]|{A}') THEN 'ye' ELSE 'e' END "
        f"WHEN c = 'ц' THEN CASE WHEN i > 1 AND regexp_matches({prev}, '[{vowels}]') THEN 'ts' ELSE 's' END "
        f"WHEN c = 'ъ' OR regexp_matches(c, '{A}') THEN CASE WHEN regexp_matches(coalesce({nxt}, ''), '[еёюя]') THEN '' ELSE 'ʼ' END "
        f"WHEN c = 'ь' THEN CASE WHEN {nxt} = 'о' THEN 'y' ELSE '' END "
        + " ".join(f"WHEN c = '{k}' THEN '{v}'" for k, v in two)
        + f" ELSE translate(c, '{''.join(k for k, _ in one)}', '{''.join(v for _, v in one)}') END"
    )


def cyrillic_to_new(x: str) -> str:
    chars = _chars(x)
    return f"array_to_string(list_transform({chars}, lambda c, i: {_latin_letter(chars)}), '')"


def readings(x: str) -> str:
    """All readings of a Cyrillic form typed on a Russian keyboard; only the first of each letter if they are too many."""
    chars = _chars(x)
    pair = " ".join(f"WHEN c = '{c}' THEN ['{a}'] || CASE WHEN length(regexp_replace({x}, '[^укх]', '', 'g')) <= 12 THEN ['{b}'] ELSE [] END" for c, a, b in (("у", "u", "ö"), ("к", "k", "q"), ("х", "x", "h")))
    options = f"list_transform({chars}, lambda c, i: CASE {pair} ELSE [{_latin_letter(chars)}] END)"
    return f"list_reduce({options}, lambda a, o: flatten(list_transform(a, lambda p: list_transform(o, lambda y: p || y))))"


def cyrillic_rule(x: str) -> str:
    out = cyrillic_to_new(x)
    for k, v in FOREIGN.items():
        out = f"replace({out}, '{k}', '{v}')"
    return out


def new_to_cyrillic(x: str) -> str:
    pieces = f"regexp_extract_all(translate({x}, '{ACCENTED}', '{BASE}'), 'y[eoua]|(?s:.)')"
    prev = f"({pieces})[i - 1]"
    return (
        f"array_to_string(list_transform({pieces}, lambda p, i: CASE "
        f"WHEN p = 'ye' THEN CASE WHEN i = 1 OR regexp_matches({prev}, '[aeiouöʼ]$') THEN 'е' ELSE 'ъе' END WHEN p = 'yo' THEN 'ё' WHEN p = 'yu' THEN 'ю' WHEN p = 'ya' THEN 'я' "
        f"WHEN p = 'e' THEN CASE WHEN i = 1 OR regexp_matches({prev}, '[aeiouö]$') THEN 'э' ELSE 'е' END "
        f"WHEN p = 'c' THEN CASE WHEN regexp_matches(coalesce(({pieces})[i + 1], ''), '^[eiy]') THEN 'ц' ELSE 'к' END "
        f"ELSE translate(p, '{LATIN_FROM}', '{LATIN_TO}') END), '')"
    )


def stripped_from(g: str, w: str) -> str:
    """Whether w is g with some marks removed."""
    p = f"replace(replace(replace(replace(replace({g}, 'ş', '[şs]'), 'ç', '[çc]'), 'ö', '[öo]'), 'ğ', '[ğg]'), 'ʼ', 'ʼ?')"
    return f"regexp_full_match({w}, {p})"


def canonical_form(x: str) -> str:
    low = f"lower({x})"
    cyr = f"CASE WHEN NOT regexp_matches({low}, '[^абвгдеёжзийклмнопрстуфхцчшъьэюяўқғҳ''`´‘’ʻʼʽʿ′]') THEN {cyrillic_to_new(low)} END"
    lat = f"CASE WHEN NOT regexp_matches({old_to_new(low)}, '[^abdefghijklmnopqrstuvxyzşçöğʼ]') THEN {old_to_new(low)} END"
    return f"(CASE WHEN {case_pattern(x)} <> 'mixed' THEN nullif(ltrim(CASE {script(low)} WHEN 'cyrillic' THEN {cyr} WHEN 'latin' THEN {lat} END, 'ʼ'), '') END)"


_PIECES = f"'{A}*{L}+(?:{A}+{L}+)*{A}*|{A}+|[^''`´‘’ʻʼʽʿ′\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}\\p{{Lo}}\\p{{M}}]+'"
_TAIL = f"regexp_extract(p, '{A}*$')"
_TAKEN = (
    f"CASE WHEN NOT regexp_matches(p, '^{A}') THEN CASE WHEN {_TAIL} <> '' AND regexp_matches(p, '[oOgG]{A}+$') THEN {_TAIL}[1:1] WHEN {_TAIL}[1:1] = 'ʼ' THEN 'ʼ' ELSE '' END "
    f"WHEN {_TAIL}[1:1] = 'ʼ' AND NOT regexp_matches(p, '[oOgG]{A}+$') THEN 'ʼ' ELSE '' END"
)


def tokens(table: str = "documents", keys: str = "doc_id, register", where: str = "text <> ''") -> str:
    """Common table expressions up to toks(keys, sent, pos, surface), surface null for a glued token."""
    return f"""
texts AS (SELECT {keys}, {normalize("text")} AS t FROM {table} WHERE {where}),
blanked AS (SELECT {keys}, array_to_string(list_transform(regexp_extract_all(t, '[{SPACE}]+|[^{SPACE}]+'), lambda r: CASE WHEN regexp_matches(r, '{ANCHOR}') THEN ' ' ELSE r END), '') AS t FROM texts),
chunks AS (SELECT {keys}, unnest(c) AS chunk, generate_subscripts(c, 1) - 1 AS sent FROM (SELECT {keys}, string_split_regex(t, '[.!?…\\n]+') AS c FROM blanked)),
pieces AS (SELECT {keys}, sent, regexp_extract_all(chunk, {_PIECES}) AS ps FROM chunks),
placed AS (SELECT {keys}, sent, unnest(ps) AS p, generate_subscripts(ps, 1) AS i, ps FROM pieces),
found AS (SELECT {keys}, sent, i, regexp_extract(p, '{L}+(?:{A}+{L}+)*') || {_TAKEN} AS surface,
    (NOT regexp_matches(p, '^{A}') AND i > 1 AND regexp_matches(ps[i - 1], '{D}$')) OR (length({_TAIL}) = length({_TAKEN}) AND regexp_matches(coalesce(ps[i + 1], ''), '^{D}')) AS glued
  FROM placed WHERE regexp_matches(p, '{L}')),
toks AS (SELECT {keys}, sent, row_number() OVER (PARTITION BY {keys}, sent ORDER BY i) - 1 AS pos, CASE WHEN NOT glued THEN surface END AS surface FROM found)"""


def analysed() -> str:
    """Continues tokens(): forms(surface, canon, letter_case) of the distinct surfaces."""
    return f"forms AS (SELECT surface, {case_pattern('surface')} AS letter_case, {canonical_form('surface')} AS canon FROM (SELECT DISTINCT surface FROM toks WHERE surface IS NOT NULL))"


def _class(category: str, cyrillic: bool) -> str:
    """All letters of a category inside or outside the Cyrillic block, as a class of ranges."""
    codes = [c for c in range(0x30000) if unicodedata.category(chr(c)) == category and (0x400 <= c <= 0x52F) == cyrillic]
    runs: list[list[int]] = []
    for c in codes:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


def ruled(source: str) -> str:
    """Common table expressions from `source` (surface) up to ruled(surface, new, old, cyrillic): every form by the rules alone."""
    cyr, lat, rest = r"[\x{400}-\x{52f}]", "[a-zÀ-ɏḀ-ỿ]", r"(?:[^\p{L}]|[ʻʼʽʿ])"
    pieces = "|".join(f"(?:{c}{rest}*)+" for c in (_class("Ll", True), _class("Lu", True), _class("Ll", False), _class("Lu", False))) + f"|{rest}+"
    low_other = r"regexp_replace(low, '[\x{400}-\x{52f}A-Za-zÀ-ɏḀ-ỿʻʼʽʿ]', '', 'g')"
    shown = {"new": "canon", "old": new_to_old("canon"), "cyrillic": new_to_cyrillic("canon")}
    stays = {"new": "NOT c", "old": "false", "cyrillic": "NOT l"}
    cased = {to: f"CASE WHEN NOT (c OR l) OR ({stays[to]}) THEN s WHEN pat = 'upper' THEN upper({x}) WHEN pat = 'title' THEN upper(({x})[1:1]) || ({x})[2:] ELSE {x} END" for to, x in shown.items()}
    folded = f"translate(lower({{}}), '{_APOS}', '{chr(8217) * 10}')"
    final = ", ".join(f"CASE WHEN other OR NOT (c OR l) OR ({stays[to]}) OR {folded.format(to)} = {folded.format('low')} THEN surface ELSE {to} END AS {to}" for to in shown)
    return f"""
r0 AS (SELECT DISTINCT surface, translate(surface, '{FOLD_FROM}', '{FOLD_TO}') AS text FROM {source} WHERE surface IS NOT NULL),
r1 AS (SELECT *, regexp_matches(low, '{cyr}') AS c, regexp_matches(low, '{lat}') AS l, regexp_matches({low_other}, '\\p{{L}}') AS other, regexp_extract_all(text, '{pieces}') AS ps FROM (SELECT *, lower(text) AS low FROM r0)),
r2 AS (SELECT surface, CASE WHEN ({case_pattern('surface')} = 'mixed' OR (c AND l)) AND len(ps) > 1 THEN ps ELSE [text] END AS ps FROM r1),
r3 AS (SELECT *, lower(s) AS low, {case_pattern('s')} AS pat, regexp_matches(lower(s), '{cyr}') AS c, regexp_matches(lower(s), '{lat}') AS l FROM (SELECT surface, unnest(ps) AS s, generate_subscripts(ps, 1) AS i FROM r2)),
r4 AS (SELECT *, CASE WHEN c THEN {cyrillic_rule('low')} ELSE {old_to_new('low')} END AS canon FROM r3),
r5 AS (SELECT surface, {', '.join(f"string_agg({x}, '' ORDER BY i) AS {to}" for to, x in cased.items())} FROM r4 GROUP BY surface),
ruled AS (SELECT surface, {final} FROM r5 JOIN r1 USING (surface))"""
