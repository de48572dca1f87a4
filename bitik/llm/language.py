"""Problem 3: the language of each document and of each segment in another language, with a confidence.

Compression classification: a segment is compressed by zstandard with the raw-content dictionary of each
language of its script; the language whose dictionary gives the smallest output is its language, and the
relative distance to the next is the confidence. Below MARGIN the segment is rejected (language and confidence null).

The dictionaries are fitted on all labelled rows and whole texts. Tags may be wrong, so their sentences are first
classified by dictionaries of a few hundred hand-written words a language, and only sentences whose class is
their tag are used. The words of all these sentences are counted, and a dictionary is filled with a sentence for each
word in the order of the counts: the shortest that holds it, unless it has words that are far more frequent in
another language, which wrong tags brought in. A raw-content dictionary has a fixed size, DICTIONARY_BYTES, so
the rarest words of all rows are what it may not hold.

Defined results: null, empty and blank texts have no segments; a text without letters has none either.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from bitik.functions.alphabet import APOSTROPHES
from bitik.llm.charmap import CharMap
from bitik.session import materialise, spread

LANGUAGES = ("uz", "ru", "en", "kk", "tg", "tr", "kaa")
#: Bytes of a dictionary.
DICTIONARY_BYTES = 96_000
LEVEL = 12
MARGIN = 0.02
#: Words of a whole sentence that makes its language one of the text's languages.
LEAST_WORDS = 6
#: A word whose share of a language's words is under this part of its share in another language came there by wrong tags.
LEAST_SHARE = 0.2
#: Texts whose stretches are held and classified together.
SLICE = 500

# Common words and plain sentences of each language, written for this purpose.
SEEDS = {
    "uz": """va bilan uchun haqida lekin chunki agar keyin ham emas edi kerak yo'q bor bo'lib bo'ldi qildi qiladi qilgan dedi deb bu shu o'sha biz siz ular menga sizga ularning kitobni kitobda kitobdan kitobga kitoblar kitoblarni kitobimiz kitobimizni
    bugun ertaga kecha juda yaxshi katta kichik yangi eski odamlar bolalar onam otam maktabga uyda ko'p oz qayerda nima kim boradi keladi yozadi o'qiydi kelgan ketdi oldi berdi borgan edi yozmoqchi kelyapti aytdilar
    va bilan uçun haqida çunki ağar keyin bölib böldi kerak yöq bor edi qilmoqçi öqidi öqiydi yaxşi kişi şu öşa katta kiçik oçiq asta-sekin
    ва билан учун ҳақида лекин чунки агар кейин ҳам эмас эди керак йўқ бор бўлиб бўлди қилди қилади қилган деди деб бу шу ўша биз сиз улар менга сизга уларнинг китобни китобда китобдан китобга китоблар китобларни китобимиз
    бугун эртага кеча жуда яхши катта кичик янги эски одамлар болалар онам отам мактабга уйда кўп қаерда нима ким боради келади ёзади ўқийди келган кетди олди берди борган эди ёзмоқчи келяпти айтдилар очиқ аста-секин булиб кабул килди хакида йук укиди""",
    "ru": """и в во на не что чтобы потому так как но это был была были быть для от до по из у около рядом под над за перед после мы вы они он она его её их этот эта эти который которая когда если хотя уже ещё очень все весь вчера сегодня завтра
    новый новая новую старый большой дом школа книга письмо вода город люди дети сказал сказала купили нашли открыли показали работали пришли принесли сделали получили забыли в прошлом году на этой неделе рано утром поздно вечером""",
    "en": """the of and to in a an is was were are be been that this these those it they we you he she his her their our with for from on at by as because although but so when if which who what where there not no one two many some all every
    yesterday today tomorrow last year this morning new old big small house school book letter water city people children said bought found opened showed worked came brought made received near behind under over before after""",
    "kk": """және мен бен бірақ өйткені себебі сондықтан үшін туралы кейін дейін бұл осы ол олар біз сіз бір екі барлық көп аз жоқ бар еді екен болды болып қалды келді кетті алды берді айтты деді кеше бүгін ертең былтыр
    үлкен кіші жаңа ескі үй мектеп кітап хат су қала адамдар балалар жұмыс ауыл көрші өзен тау жерде уақыт ешкім бәрі қызық маңызды жолы кезде үйде мектепте кітапты сатып тапты көрсетті дайындады ұмытты""",
    "tg": """ва дар аз ба бо барои то ки ин он мо шумо онҳо вай як ду ҳама бисёр аммо зеро чунки агар вақте хеле буд буданд шуд шуданд кард карданд гирифт гирифтанд овард дид диданд гуфт рафт омад имрӯз дирӯз фардо пагоҳӣ бегоҳӣ
    хона мактаб китоб нома об шаҳр мардум кӯдакон кор деҳа ҳамсоя дарё кӯҳ нав кӯҳна калон хурд муҳим муҳимро китобро обро хонаро ҳафтаи гузашта соли гузашта тобистон зимистон ҳамсояҳои мо""",
    "tr": """ve ile için ama fakat çünkü bu şu o bir iki çok az daha en gibi kadar sonra önce değil var yok idi oldu oldular yaptı yaptılar aldı aldılar gördü gördüler verdi geldi gitti dedi dün bugün yarın geçen yıl geçen hafta
    büyük küçük yeni eski ev okul kitap mektup su şehir insanlar çocuklar iş köy komşu nehir dağ bizim onun kendi herkes kimse zaman önemli belgeleri evde okulda kitabı pazarda satın buldular açtılar gösterdiler unuttular""",
    "kaa": """hám menen ushın biraq sebebi sonlıqtan óytkeni keyin deyin bul usı ol olar biz siz bir eki barlıq kóp az joq bar edi eken boldı bolıp qaldı keldi ketti aldı berdi ayttı dedi keshe búgin erteń ótken jılı
    úlken kishi jańa eski úy mektep kitap xat suw qala adamlar balalar jumıs awıl qońsı dárya taw jerde waqıt hesh kim hámmesi qızıqlı áhmiyetli úyde mektepte kitaptı satıp taptı kórsetti tayarladı umıttı""",
}

_EMOJI = r"☀-➿⬀-⯿️\U0001F000-\U0001FAFF"
_UNIT = re.compile(rf"[^\n.!?…{_EMOJI}]+(?:\.(?=\S)[^\n.!?…{_EMOJI}]+)*")
_ADDRESS = re.compile(r"\S*://\S+|(?<!\S)[@#]\S+|www\.\S+")
_QUOTED = re.compile(r"[«“„\"](?=[^«»“”„\"\n]{1,80}[»”“\"])(?:[^«»“”„\"\s]+ ?){1,5}[»”“\"]")
_WORD = re.compile(r"[^\W\d_]+(?:['`´‘’ʻʼʽʿ′-][^\W\d_]+)*")
_LETTER = re.compile(r"[^\W\d_]")
_CYRILLIC = re.compile(r"[Ѐ-ԯ]")
_CLEAN = re.compile(r"[^\w]+|\d+|_")
# spellings of one alphabet that writers mix are brought together before compression
_HABITS = {ord(c): None for c in APOSTROPHES} | {ord("ş"): "sh", ord("ç"): "ch"} | str.maketrans("öğўқғҳ", "ogукгх")

#: A stretch without end marks longer than this is cut before capitalised words, and still longer ones by count.
LONG_UNIT, WINDOW_WORDS = 12, 24


def plain(text: str) -> bytes:
    return _CLEAN.sub(" ", text.lower().translate(_HABITS)).strip().encode()


def is_cyrillic(text: str) -> bool:
    cyrillic = len(_CYRILLIC.findall(text))
    return 2 * cyrillic > len(_LETTER.findall(text))


def units(text: str) -> Iterator[tuple[int, int, int, int]]:
    """(unit, start, end, words) of the stretches to classify; stretches of one unit are not divided by an end mark."""
    for k, m in enumerate(_UNIT.finditer(text)):
        words = list(_WORD.finditer(text, m.start(), m.end()))
        if not words:
            continue
        cuts, counts, since = [words[0].start()], [], 0
        if len(words) > LONG_UNIT:
            for a, b in zip(words, words[1:]):
                since += 1
                if since >= WINDOW_WORDS or (since >= 3 and text[b.start()].isupper() and text[a.start()].islower()):
                    cuts.append(b.start())
                    counts.append(since)
                    since = 0
        counts.append(len(words) - sum(counts))
        for start, end, n in zip(cuts, [*cuts[1:], m.end()], counts):
            yield k, start, end, n


_LETTERS = np.array([chr(c).isalnum() and not chr(c).isdecimal() for c in range(0x30000)])
_CYRILLIC_LETTERS = (np.arange(0x30000) >= 0x400) & (np.arange(0x30000) < 0x530)
_HABIT_MAP = CharMap({k: chr(v) if isinstance(v, int) else v for k, v in _HABITS.items()})
_CLEAN_LINES = re.compile(r"[^\w\n]+|\d+|_")


def prepared(text: str, spans: list[tuple[int, int]]) -> tuple[list[bytes], list[bool]]:
    """`plain` and `is_cyrillic` of the stretches of a text, none of which holds a line break, in one pass over the text."""
    codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 0x2FFFF)
    edges = np.array(spans).reshape(-1, 2)
    cyrillic, letters = (np.concatenate([[0], np.cumsum(t[codes])])[edges] for t in (_CYRILLIC_LETTERS, _LETTERS))
    lines = _CLEAN_LINES.sub(" ", _HABIT_MAP("\n".join(text[a:b] for a, b in spans).lower()))
    coded = [line.strip().encode() for line in lines.split("\n")]
    return coded, (2 * (cyrillic[:, 1] - cyrillic[:, 0]) > letters[:, 1] - letters[:, 0]).tolist()


class Classifier:
    """The dictionaries of all languages; sizes and margins of a stretch of text."""

    def __init__(self, dictionaries: dict[tuple[str, bool], bytes], level: int = LEVEL):
        self.by_script: dict[bool, list[tuple[str, zstandard.ZstdCompressor]]] = defaultdict(list)
        for (lang, cyrillic), content in sorted(dictionaries.items()):
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=level)
            self.by_script[cyrillic].append((lang, zstandard.ZstdCompressor(dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False)))

    def __call__(self, text: str) -> tuple[str | None, float]:
        """The language of the smallest output and its relative distance to the next; null if that is under MARGIN."""
        return self.many([plain(text)], [is_cyrillic(text)])[0]

    def many(self, coded: list[bytes], cyrillic: list[bool]) -> list[tuple[str | None, float]]:
        """The same of many prepared stretches, one dictionary after the other, so that each stays in the processor's cache."""
        sizes = np.full((len(coded), 2), np.iinfo(np.int64).max)  # the smallest and the next
        langs = np.full(len(coded), -1)
        names = [lang for group in self.by_script.values() for lang, _ in group]
        at = 0
        for script, group in self.by_script.items():
            mine = [i for i, k in enumerate(cyrillic) if k == script and coded[i]]
            for _, compressor in group:
                one = compressor.compress
                found = np.array([len(one(coded[i])) for i in mine], dtype=np.int64)
                best, other = sizes[mine, 0], sizes[mine, 1]
                langs[mine] = np.where(found < best, at, langs[mine])
                sizes[mine, 1] = np.where(found < best, best, np.minimum(found, other))
                sizes[mine, 0] = np.minimum(found, best)
                at += 1
        out: list[tuple[str | None, float]] = []
        for lang, (best, other) in zip(langs.tolist(), sizes.tolist(), strict=True):
            margin = 0.0 if lang < 0 else 1 - best / (other if other < np.iinfo(np.int64).max else 2 * best)
            out.append((names[lang] if margin >= MARGIN else None, margin))
        return out


def fit(sentences: Iterable[tuple[str, bool, str]]) -> dict[tuple[str, bool], bytes]:
    """Raw contents by language and script of sentences (language, whether Cyrillic, `plain` text), the most useful last, and of the seed words."""
    parts: dict[tuple[str, bool], list[bytes]] = defaultdict(list)
    for lang, cyrillic, text in sentences:
        parts[lang, cyrillic].append(text.encode())
    for lang, text in SEEDS.items():
        for line in text.split("\n"):
            parts[lang, is_cyrillic(line)].append(plain(line))
    # the most useful content belongs at the end of a zstandard dictionary
    return {k: b" ".join(dict.fromkeys(v))[-DICTIONARY_BYTES:] for k, v in parts.items()}


def _words(sentences: list[str]) -> tuple[Counter[str], dict[str, str]]:
    """The words of sentences with their counts, and the shortest sentence, the first in order of these, that holds each."""
    counts, shortest = Counter(), {}
    for sentence in sorted(sentences, key=lambda s: (len(s), s)):
        words = sentence.split()
        counts.update(words)
        shortest.update(dict.fromkeys(set(words).difference(shortest), sentence))
    return counts, shortest


def confirmed_words(df: DataFrame, text_col: str = "text", lang_col: str = "lang_tag") -> DataFrame:
    """lang, cyrillic, word, n, sentence: every word of the sentences whose tag the seed words confirm, its count, and the shortest sentence that holds it."""
    seeds = fit([])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classify = Classifier(seeds)
        for batch in batches:
            for i in range(0, len(batch), SLICE):
                pieces: list[tuple[str, bytes, bool]] = []
                for lang, text in zip(batch["lang"].iloc[i : i + SLICE], batch["text"].iloc[i : i + SLICE], strict=True):
                    if spans := [(start, end) for _, start, end, n in units(text) if n >= LEAST_WORDS]:
                        pieces += [(lang, *ready) for ready in zip(*prepared(text, spans), strict=True)]
                judged = classify.many([coded for _, coded, _ in pieces], [cyrillic for _, _, cyrillic in pieces])
                sure: dict[tuple[str, bool], list[str]] = defaultdict(list)
                for (tag, coded, cyrillic), (lang, _) in zip(pieces, judged, strict=True):
                    if lang == tag:
                        sure[tag, cyrillic].append(coded.decode())
                for (lang, cyrillic), sentences in sure.items():
                    counts, shortest = _words(sentences)
                    yield pd.DataFrame({"lang": lang, "cyrillic": cyrillic, "word": list(shortest), "n": [counts[w] for w in shortest], "sentence": list(shortest.values())})

    rows = spread(df.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isin(*LANGUAGES) & F.col("text").isNotNull()))
    found = rows.mapInPandas(run, "lang string, cyrillic boolean, word string, n bigint, sentence string")
    least = F.min(F.struct(F.length("sentence").alias("length"), "sentence"))["sentence"]
    return found.groupBy("lang", "cyrillic", "word").agg(F.sum("n").alias("n"), least.alias("sentence"))


def dictionary_sentences(df: DataFrame, text_col: str = "text", lang_col: str = "lang_tag") -> list[tuple[str, bool, str]]:
    """(language, whether Cyrillic, sentence) of the most frequent words of all rows, the most frequent last; of each language and script as much as a dictionary holds.

    A word is its language's own unless its share of the language's words is under LEAST_SHARE of that in another one; sentences of own words only are taken.
    """
    order = Window.partitionBy("lang", "cyrillic").orderBy(F.desc("n"), "sentence")
    words = materialise(confirmed_words(df, text_col, lang_col))
    totals = words.groupBy("lang", "cyrillic").agg(F.sum("n").alias("total"))
    shares = words.join(F.broadcast(totals), ["lang", "cyrillic"]).withColumn("share", F.col("n") / F.col("total"))
    own = F.col("share") >= LEAST_SHARE * F.max("share").over(Window.partitionBy("cyrillic", "word"))
    judged = shares.withColumn("own", own).select("lang", "cyrillic", "word", "n", "sentence", "own")
    chosen = judged.where("own").groupBy("lang", "cyrillic", "sentence").agg(F.max("n").alias("n"))
    parts = chosen.withColumn("word", F.explode(F.split("sentence", " "))).join(judged.select("lang", "cyrillic", "word", "own"), ["lang", "cyrillic", "word"])
    once = parts.groupBy("lang", "cyrillic", "sentence", "n").agg(F.bool_and("own").alias("own")).where("own")
    # six words and the blanks behind them are twelve bytes at least
    first = once.withColumn("r", F.row_number().over(order)).where(F.col("r") <= DICTIONARY_BYTES // (2 * LEAST_WORDS))
    before = F.sum(F.octet_length("sentence") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1))
    held = first.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < DICTIONARY_BYTES)
    rows = held.select("lang", "cyrillic", "sentence", "r").collect()
    return [(r["lang"], r["cyrillic"], r["sentence"]) for r in sorted(rows, key=lambda r: (r["lang"], r["cyrillic"], -r["r"]))]


def text_segments(text: str, classify: Classifier) -> list[tuple[int, int, str | None, float, int]]:
    """(start, end, language, confidence, words) of a text: runs of stretches of one language.

    Addresses and quoted names and titles are left out of what is classified. Words are those of the
    longest stretch of the run that no end mark divides.
    """
    return segments_of([text], classify)[0]


def segments_of(texts: list[str], classify: Classifier) -> list[list[tuple[int, int, str | None, float, int]]]:
    """`text_segments` of many texts, whose stretches are classified together."""
    blank = lambda m: " " * len(m.group())
    divided, coded, scripts = [], [], []
    for text in texts:
        text = _QUOTED.sub(blank, _ADDRESS.sub(blank, text))
        parts = list(units(text))
        divided.append(parts)
        if long_ := [(start, end) for _, start, end, n in parts if n >= 3]:
            ready = prepared(text, long_)
            coded += ready[0]
            scripts += ready[1]
    judged = iter(classify.many(coded, scripts))
    return [_runs(parts, judged) for parts in divided]


def _runs(parts: list[tuple[int, int, int, int]], judged: Iterator[tuple[str | None, float]]) -> list[tuple[int, int, str | None, float | None, int]]:
    """Runs of one language; the confidence is the mean margin of the stretches, weighted by words, and null for a run without a language."""
    out: list[list] = []
    for unit, start, end, n in parts:
        lang, margin = next(judged) if n >= 3 else (None, 0.0)
        if out and out[-1][2] == lang:
            run = out[-1]
            run[6] = run[6] + n if run[5] == unit else n
            run[1], run[5] = end, unit
            run[4] = max(run[4], run[6])
        else:
            run = [start, end, lang, 0.0, n, unit, n, 0]
            out.append(run)
        run[3] += margin * n
        run[7] += n
    return [(start, end, lang, None if lang is None else weight / words, longest) for start, end, lang, weight, longest, _, _, words in out]


def segments(df: DataFrame, dictionaries: dict[tuple[str, bool], bytes], id_col: str = "crawl_id", text_col: str = "text") -> DataFrame:
    """Rows id, start_pos, end_pos, lang, confidence, longest of every segment of every text."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classify = Classifier(dictionaries)
        for batch in batches:
            codes, values = pd.factorize(batch["text"])
            found = [f for i in range(0, len(values), SLICE) for f in segments_of(list(values[i : i + SLICE]), classify)]
            rows = [(i, *s) for i, c in zip(batch["id"], codes, strict=True) for s in found[c]]
            yield pd.DataFrame(rows, columns=names)

    names = ["id", "start_pos", "end_pos", "lang", "confidence", "longest"]
    texts = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL"))
    kind = df.schema[id_col].dataType.simpleString()
    return texts.mapInPandas(run, f"id {kind}, start_pos int, end_pos int, lang string, confidence double, longest int").withColumnRenamed("id", id_col)


def language_segments(df: DataFrame, id_col: str = "crawl_id", text_col: str = "text", lang_col: str = "lang_tag") -> DataFrame:
    """Dictionaries fitted on all labelled rows of `df`, and the segments of all its texts."""
    return segments(df, fit(dictionary_sentences(df, text_col, lang_col)), id_col, text_col)


def document_languages(parts: DataFrame, id_col: str = "crawl_id") -> DataFrame:
    """id, lang, confidence: the languages in which a text has at least one whole sentence of six words or more."""
    return parts.where((F.col("longest") >= LEAST_WORDS) & F.col("lang").isNotNull()).groupBy(id_col, "lang").agg(F.max("confidence").alias("confidence"))


def wrong_labels(df: DataFrame, languages: DataFrame, no_prose: DataFrame, id_col: str = "crawl_id", lang_col: str = "lang_tag") -> DataFrame:
    """id, lang for texts, other than those of `no_prose`, whose tag is null, empty or not their only language."""
    found = languages.groupBy(id_col).agg(F.collect_set("lang").alias("langs"))  # at most seven
    tagged = df.select(id_col, F.nullif(F.trim(F.col(lang_col)), F.lit("")).alias("tag")).where(F.col(id_col).isNotNull())
    wrong = tagged.join(found, id_col).where(~F.coalesce((F.size("langs") == 1) & F.array_contains("langs", F.col("tag")), F.lit(False)))
    return wrong.join(no_prose.select(id_col), id_col, "left_anti").select(id_col, F.explode("langs").alias("lang")).distinct()
