"""Problem 4: every sentence of every text, with its place.

Semi-Markov dynamic programming over the places of a paragraph where a sentence may end: the best way to cut
the paragraph into whole spans is the one with the largest sum of span scores, and a span is scored jointly on
its length, its opening words, its closing words and the balance of its quotation marks and brackets. No span
border lies between a quotation mark or bracket and its partner, however long the quotation is.

An empty line ends a sentence, a single line break does not. Scripts without letter case end sentences by
their own marks, Thai by a blank.

Defined results: null, empty and blank texts have no sentences; equal texts have equal sentences.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from bitik.session import spread

#: Score of words that close or open no sentence.
NEVER = -9.0

# Abbreviations after which a name or number follows, so that they end no sentence.
BEFORE_NAME = frozenset(
    """prof akad dots dot mr mrs ms dr st jr inj gen sh ul im i o'qit muh tel fig no vol pp vs cf q
    проф акад доц дотс ген ш ул им инж см рис табл стр напр гр г-н г-жа др-р тел тыс руб т.н т.е е қ""".split()
)
# Abbreviations that may stand inside a sentence and at its end.
ANYWHERE = frozenset(
    """km kg sm mm mln mlrd ming h.k hk b y yy asr a va.b p.m a.m p a etc co inc ltd
    км кг см мм млн млрд минг ҳ.к ҳк б й г гг в вв а т.д т.п др пр""".split()
)
# Endings of Uzbek finite verbs and predicates, which close a sentence.
CLOSING = re.compile(
    r"(?:di|dilar|gan|ganlar|yapti|yaptilar|moqchi|moqçi|adi|ydi|edi|kerak|y[oö][ʻ‘’'`´ʼ]?q|bor|emas|sin|"
    r"ди|дилар|ган|ганлар|япти|яптилар|моқчи|мокчи|ади|йди|эди|керак|йўқ|йук|бор|эмас|син)$",
    re.I,
)

_MARK = ".!?…。！？؟।॥۔｡"
_CLOSER = "»”“\"'’)\\]」』›"
_END = re.compile(rf"[{_MARK}]+(?:[ \t]+[।॥])?(?:[{_CLOSER}]+[.!?…]*)*")
_THAI_GAP = re.compile(r"(?<=[฀-๿])[\s​]+(?=\S)|(?<=\S)[\s​]+(?=[฀-๿])")
_LAST_WORD = re.compile(r"[^\s.!?…«»“”„\"()\[\]—–-]+(?:[.-][^\s.!?…«»“”„\"()\[\]—–-]+)*$")
_WIDE_MARK = set("。！？｡")
_DASH = "—–―-"
_OPENERS = "«„([「『“"
_REPORT = re.compile(r"^[^。！？，、「」]{1,10}(?:说|問|问|道|喊|叫|答|言いました|聞きました|言った)")
_NUMERAL = re.compile(r"^(?:\d+(?:\.\d+)*|[IVXLCDM]+|[IVXLCDMІХ]+|[A-Za-zА-Яа-я])$")
_QUOTES = re.compile(r"[«»„“”\"()\[\]「」『』]")
_PARAGRAPH = re.compile(r"\S(?:[^\n]|\n(?![^\S\n]*(?:\n|$)))*")
_WHOLE_WORD = re.compile(r"[^\W\d_]+(?:['`´‘’ʻʼʽʿ′-][^\W\d_]+)*['`´‘’ʻʼʽʿ′]?")
_BLANKS = re.compile(r"\s*")
_INITIALS = re.compile(r"(?:(?:[SC]h|[GO][ʻ‘’'`´ʼ]|[^\W\d_])\.?)+")


def _places(text: str) -> list[int]:
    """Ends of all stretches after which a sentence may end; the last is the end of the paragraph."""
    ends = set()
    for m in _END.finditer(text):
        end, after = m.end(), text[m.end() : m.end() + 1]
        if not after or after.isspace():
            ends.add(end)
        elif set(m.group()) & _WIDE_MARK or m.group()[0] in "।॥":
            ends.add(end)
        elif m.group()[0] in _MARK:
            # no blank after the mark: a new sentence only if a whole word stands on either side
            word = _LAST_WORD.search(text, max(0, m.start() - 40), m.start())
            follows = re.match(r"[—–]?\s?[«„“\"(]?[^\W\d_]{2,}", text[end : end + 12])
            inner = after in "«„(" or after.isupper() or after in _DASH
            if word and len(word.group()) >= 3 and _WHOLE_WORD.fullmatch(word.group()) and inner and follows and text[m.start() - 1].islower() and re.search(r"[^\W\d_]", follows.group())[0].isupper():
                ends.add(end)
    for m in _THAI_GAP.finditer(text):
        ends.add(m.start())
    ends.add(len(text))
    return sorted(ends)


def _closing(text: str, end: int, following: str) -> float:
    """How well the words before `end` close a sentence."""
    m = re.search(rf"([{_MARK}]+)([ \t]*[।॥])?[{_CLOSER}.!?…]*$", text[max(0, end - 12) : end])
    if not m:
        return 2.0  # a Thai blank
    mark = m.group(1)
    at = max(0, end - 12) + m.start()
    score = 0.5 if m.end() - m.start() > len(mark) else 0.0
    head = text[max(0, at - 60) : at].replace("-\n", "")  # a word divided at a line end is one word
    word = _LAST_WORD.search(head)
    if mark in ("...", "…", "..", "……") or set(mark) <= {".", "…"} and len(mark) > 1:
        return score + (2.0 if word and CLOSING.search(word.group()) else 0.0)
    if mark != ".":
        return score + 3.0
    if not word:
        return score + 1.0
    raw, low = word.group(), word.group().lower()
    before = head[: word.start()].split()
    if _NUMERAL.match(raw) and not before and at <= 60:
        return -9.0  # the number of a heading
    if low in ("k", "к") and before and before[-1].lower() in ("h.", "ҳ."):
        return 1.0
    if low in ("b", "б") and before and before[-1].lower() in ("va", "ва"):
        return 1.0
    if low in ("д", "п") and before and before[-1].lower() == "т.":
        return 1.0
    if low in ("г", "в", "y", "й") and before and before[-1].isdigit():
        return 0.0
    if low in BEFORE_NAME:
        return -9.0
    if low in ANYWHERE and len(low) > 1:
        return 1.0
    cased = raw[0].lower() != raw[0].upper()
    if cased and (len(raw) == 1 or raw[0].isupper() and _INITIALS.fullmatch(raw) and (len(raw) <= 2 or "." in raw)):
        return -9.0  # initials, or a part of an abbreviation
    if re.search(r"\d-?[йy]?$", low):
        return -9.0 if following[:1].isdigit() or "-" in raw else -1.0
    return score + 2.0


def _opening(text: str, start: int) -> float:
    """How well the words from `start` open a sentence."""
    rest = text[start : start + 40].lstrip()
    if not rest:
        return 0.0
    head = rest.lstrip(_OPENERS + "\"'‘")
    dashed = rest[0] in _DASH
    if dashed:
        head = rest[1:].lstrip().lstrip(_OPENERS + "\"'‘")
    if rest[0] == "と" or _REPORT.match(rest) and text[max(0, start - 40) : start].rstrip()[-1:] in "」』”":
        return -9.0
    c = head[:1]
    if not c or c in ",;:)" or c.islower():
        return -9.0
    if c.isdigit():
        return 0.5
    return 1.0


#: Which marks each closing mark may be the partner of.
_PARTNERS = {"»": "«", "“": "„", "”": "“„", ")": "(", "]": "[", "」": "「", "』": "『"}


def _held(text: str) -> tuple[bytearray, list[int]]:
    """For each character position, whether a border there would part a quotation mark or bracket from its partner;
    and the places of straight marks whose partner is uncertain. Other marks without a partner count alike in every division."""
    held = bytearray(len(text) + 1)
    open_marks: list[tuple[str, int]] = []
    loose = {m.start() for m in re.finditer('"', text)}
    for m in _QUOTES.finditer(text):
        c, at = m.group(), m.start()
        before, after = text[at - 1 : at] if at else "", text[at + 1 : at + 2]
        # a straight mark closes after a non-blank character and opens before one
        partners = ('"' if before.strip() and before not in _OPENERS else "") if c == '"' else _PARTNERS.get(c, "")
        k = next((k for k in range(len(open_marks) - 1, -1, -1) if open_marks[k][0] in partners), None) if partners else None
        if k is not None:
            start = open_marks[k][1]
            held[start + 1 : at + 1] = b"\1" * (at - start)
            loose -= {start, at}
            del open_marks[k:]
        elif c == '"' and (after.isalnum() or after and after in _OPENERS) or c != '"' and c in _OPENERS:
            open_marks.append((c, at))
    return held, sorted(loose)


def _length(words: int) -> float:
    return (-2.0, -2.0, -0.6)[words] if words < 3 else -0.02 * max(0, words - 40)


def paragraph_spans(text: str) -> list[tuple[int, int]]:
    """The best division of one paragraph into whole sentence spans, as (start, end)."""
    ends = _places(text)
    starts = [0] + [_BLANKS.match(text, e).end() for e in ends[:-1]]
    k = len(ends)
    if k == 1:
        return [(0, len(text))]
    counts = [max(1, len(text[s:e].split())) for s, e in zip(starts, ends)]
    wide = [bool(re.search(r"[぀-ヿ一-鿿฀-๿]", text[s:e])) for s, e in zip(starts, ends)]
    close = [_closing(text, e, text[n : n + 3]) for e, n in zip(ends[:-1], starts[1:])] + [0.0]
    opening = [0.0] + [_opening(text, s) for s in starts[1:]]
    held, loose = _held(text)
    # borders, as numbers of stretches before them
    at = [0] + [j for j in range(1, k) if not held[ends[j - 1]] and close[j - 1] > NEVER and opening[j] > NEVER] + [k]
    words_to = [0]
    for n, w in zip(counts, wide):
        words_to.append(words_to[-1] + n + 4 * w)
    loose_to = [0] + [bisect_left(loose, e) for e in ends]
    best, back = [0.0] + [float("-inf")] * (len(at) - 1), [0] * len(at)
    reach = [0.0] * len(at)  # the most that a span opening at this border or an earlier one starts from
    for b in range(1, len(at)):
        j = at[b]
        bracketed = text[ends[j - 1] - 1 : ends[j - 1]] in ")]" and j < k
        for a in range(b - 1, -1, -1):
            i = at[a]
            words = words_to[j] - words_to[i]
            if reach[a] + close[j - 1] + (_length(words) if words >= 3 else 0.0) <= best[b]:
                break  # no longer span can be better
            score = best[a] + opening[i] + close[j - 1] + _length(words) - 6.0 * ((loose_to[j] - loose_to[i]) % 2)
            if bracketed and text[starts[i]] not in "([":
                score -= 4.0
            if score > best[b]:
                best[b], back[b] = score, a
        reach[b] = max(reach[b - 1], best[b] + (opening[j] if j < k else 0.0))
    out, b = [], len(at) - 1
    while b:
        out.append((starts[at[back[b]]], ends[at[b] - 1]))
        b = back[b]
    return out[::-1]


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of every sentence, in characters; both ends are non-blank characters."""
    out = []
    for m in _PARAGRAPH.finditer(text):
        para = m.group().rstrip()
        out += [(m.start() + a, m.start() + b) for a, b in paragraph_spans(para)]
    return out


def sentences(df: DataFrame, id_col: str = "book_id", text_col: str = "text") -> DataFrame:
    """One row for every sentence: id, sent_no, start_pos, end_pos, sentence."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes, values = pd.factorize(batch["text"])
            found = [sentence_spans(v) for v in values]
            rows = [(i, n, a, b, values[c][a:b]) for i, c in zip(batch["id"], codes, strict=True) for n, (a, b) in enumerate(found[c])]
            yield pd.DataFrame(rows, columns=names)

    names = ["id", "sent_no", "start_pos", "end_pos", "sentence"]
    texts = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL AND id IS NOT NULL"))
    kind = df.schema[id_col].dataType.simpleString()
    return texts.mapInPandas(run, f"id {kind}, sent_no int, start_pos bigint, end_pos bigint, sentence string").withColumnRenamed("id", id_col)
