"""Operators for training text on small tables: defined results for nulls, empty and repeated rows, and brute force."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitik.llm import cooccurrence as co, language as la, leakage as le, lookalike as lk, packing as pk, quality as qu, sentences as se

CRAWL = "crawl_id bigint, text string, lang_tag string, score double, row string, lang int, stat string"
DOCS = "doc_id bigint, text string, form string, raw string, salt int, id string, h bigint"


def docs(spark, texts):
    """Texts with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "f", "r", 1, "x", 2) for i, t in enumerate(texts)], DOCS)


# --- pairs -----------------------------------------------------------------------------------------------


def brute_pairs(rows):
    seen, counts, margin = {}, Counter(), Counter()
    for i, a, b, n in rows:
        if a is None or b is None or n is None or n < 1:
            continue
        a, b = (w.strip().lower().replace("'", "ʼ").replace("’", "ʼ") for w in (a, b))
        if a and b and a != b:
            x = (*sorted((a, b)), n)
            if i is None:
                counts[x[:2]] += n
            else:
                seen[i] = min(seen.get(i, x), x)
    for a, b, n in seen.values():
        counts[a, b] += n
    for (a, b), n in counts.items():
        margin[a] += n
        margin[b] += n
    total = sum(counts.values())
    return {p: (n, n * total / (margin[p[0]] * margin[p[1]])) for p, n in counts.items()}


@pytest.mark.parametrize("hot_share", [1000, 2])
def test_pairs_match_brute_force(spark, monkeypatch, hot_share):
    monkeypatch.setattr(co, "HOT_SHARE", hot_share)
    rng = random.Random(4)
    words = ["va", "Va ", "olma", "nok", "so'z", "so’z", " ", None, "behi", "uzum"]
    rows = [(rng.choice([None, n, n // 2]), rng.choice(words), rng.choice(words), rng.choice([None, -3, 0, 1, 5, 40])) for n in range(600)]
    df = spark.createDataFrame(rows, "row_id bigint, w1 string, w2 string, count bigint")
    got = {(r["w1"], r["w2"]): (r["count"], r["lift"]) for r in co.association(co.ordered_pairs(df)).collect()}
    expected = brute_pairs(rows)
    assert {p: v[0] for p, v in got.items()} == {p: v[0] for p, v in expected.items()}
    assert all(abs(got[p][1] - expected[p][1]) < 1e-9 for p in expected)


def test_no_pairs(spark):
    empty = spark.createDataFrame([], "row_id bigint, w1 string, w2 string, count bigint")
    assert co.association(co.ordered_pairs(empty), 30, 6.0).count() == 0


@pytest.mark.parametrize("part", [1000, 3])
def test_baskets_match_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(co, "BASKET_PART", part)
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *"abcdefghijklmnop"])) for _ in range(300)]
    expected = Counter()
    for k in (1, 2, 3):
        expected.update(itertools.combinations(sorted({v for i, v in rows if i == k and v}), 2))
    df = spark.createDataFrame([(*r, "x") for r in rows], "k int, v string, part string")
    got = co.basket_pairs(df, "k", "v").groupBy("w1", "w2").agg(F.sum("n").alias("n")).collect()
    assert {(r["w1"], r["w2"]): r["n"] for r in got} == expected


def test_basket_pairs(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "b"), (2, "a"), (3, None), (None, "a")], "k int, v string")
    assert [tuple(r)[:3] for r in co.association(co.basket_pairs(df, "k", "v")).collect()] == [("a", "b", 2)]


# --- quality ---------------------------------------------------------------------------------------------

PROSE = "Darsdan soʻng aka qora hikoyasini otalarga tekshirmadi. Kuzda mehmonlar mashhur bargni rassomlarga ketmadi, chunki pochtalar deyarli tekshiradi."
JUNK = ["olma;12;13.5\nnok;14;15", "boğ, boğ, boğ, boğ, boğ, boğ", "ljjllga jkaafdak faklfddd agfahjja sgaaklflksf slhhdshdlfaj gg dsa", "????? ???? ?? ????????? ???", "#a_b @c_d 🔥🔥 #e_f", "a3f9c2" * 20, "Bosh sahifa | Kirish | Aloqa | Xizmatlar | Qulf | Soz"]


def test_running_share():
    assert qu.text_statistics(PROSE)[-1] == 1.0
    assert qu.text_statistics(PROSE.upper())[-1] == 1.0
    assert all(qu.text_statistics(j)[-1] == 0.0 for j in JUNK)
    assert qu.text_statistics(" \n\t") is None


def test_exact_ranks_are_the_empirical_distribution(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["uz", "uz", "ru"]), float(rng.randrange(30)), rng.choice([None, 0.0, 1.0])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "lang string, a double, b double")
    got = {(r["lang"], r["stat"], r["value"]): (r["at_most"], r["at_least"], r["n"]) for r in qu.exact_ranks(df, ["a", "b"]).collect()}
    by = defaultdict(list)
    for lang, a, b in rows:
        by[lang, 0].append(a)
        if b is not None:
            by[lang, 1].append(b)
    expected = {(*k, v): (sum(x <= v for x in xs), sum(x >= v for x in xs), len(xs)) for k, xs in by.items() for v in set(xs)}
    assert got == expected


@pytest.mark.parametrize("broadcast_ranks", [10**6, 0])
def test_verdicts(spark, monkeypatch, broadcast_ranks):
    monkeypatch.setattr(qu.tails, "__defaults__", (broadcast_ranks,))
    texts = [PROSE] * 40 + JUNK + [None, "", "  "]
    df = spark.createDataFrame([(i, t, "uz" if i % 3 else None, 0.0, "r", 1, "s") for i, t in enumerate(texts)], CRAWL)
    got = {r["crawl_id"]: r["is_prose"] for r in qu.prose_verdicts(df).collect()}
    assert [got[i] for i in range(len(texts))] == [True] * 40 + [False] * len(JUNK) + [None] * 3
    assert qu.prose_verdicts(df.limit(0)).count() == 0


def test_verdicts_of_a_tag_that_is_mostly_copies(spark):
    texts = [JUNK[0]] * 70 + [PROSE] * 30
    df = spark.createDataFrame([(i, t, None, 0.0, "r", 1, "s") for i, t in enumerate(texts)], CRAWL)
    got = {r["crawl_id"]: r["is_prose"] for r in qu.prose_verdicts(df).collect()}
    assert [got[i] for i in range(100)] == [False] * 70 + [True] * 30


def test_the_score_decides(spark):
    """Texts below the bound are prose whatever their share; the score separates most texts on its own."""
    rows = qu.prose_verdicts(spark.read.parquet("/root/testdata/sf0.01/uz_crawl.parquet")).where("score IS NOT NULL").collect()
    cases = [r for r in rows if r["sentence_share"] < 0.5]
    assert sum(r["is_outlier"] for r in cases) >= 0.99 * len(cases)
    assert sum(r["is_outlier"] for r in rows) <= 0.6 * len(rows)
    assert all(r["is_prose"] for r in rows if not r["is_outlier"])


def test_weights_follow_the_labels():
    x = np.array([[0.1, 2.0], [0.2, 0.1], [3.0, 1.0], [2.5, 0.3]])
    w = qu.fit_weights(x, np.array([0.0, 0.0, 1.0, 1.0]))
    assert ((w[0] + x @ w[1:] > 0) == [False, False, True, True]).all()
    assert not qu.fit_weights(x, np.ones(4)).any()


def test_the_bound_holds_for_every_text(spark):
    """Whatever the order of the hashes: text that is no prose and looks like prose is found beyond any first thousands of its language."""
    rng = random.Random(6)
    rows = [(h, "uz", h, *[float(rng.randrange(20)) for _ in qu.STATS], 1.0) for h in range(4050)]
    rows += [(h, "uz", h, *[90.0 + h] * len(qu.STATS), 0.0) for h in range(-9, 0)]
    rows.append((9000, "uz", 9000, *[10.0] * len(qu.STATS), 0.2))
    stats = spark.createDataFrame(rows, "id bigint, lang string, h bigint, " + ", ".join(f"{s} double" for s in [*qu.STATS, "sentence_share"]))
    found = qu.outlier_scores(stats).where("sentence_share < 0.5").select("id", "is_outlier").collect()
    assert sorted(map(tuple, found)) == [(i, True) for i in (*range(-9, 0), 9000)]


# --- language --------------------------------------------------------------------------------------------

SENTENCES = {
    "uz": "Bugun maktabda yangi kitoblar haqida gapirdilar, chunki ular juda yaxshi edi.",
    "ru": "Вчера в школе дети нашли новую книгу, потому что они очень хотели читать.",
    "en": "Yesterday the children found a new book at the school because they wanted to read.",
    "tr": "Dün okulda çocuklar yeni bir kitap buldular, çünkü herkes bunu çok istiyordu.",
    "kk": "Кеше мектепте балалар жаңа кітапты тапты, өйткені олар үшін бұл маңызды болды.",
    "tg": "Дирӯз дар мактаб кӯдакон китоби навро диданд, зеро ки ин барои онҳо муҳим буд.",
    "kaa": "Keshe mektepte balalar jańa kitaptı taptı, sebebi olar ushın bul áhmiyetli boldı.",
}


def test_languages_of_sentences():
    classify = la.Classifier(la.fit([]))
    assert {lang: classify(s)[0] for lang, s in SENTENCES.items()} == {lang: lang for lang in SENTENCES}
    assert classify("Бугун мактабда янги китоблар ҳақида гапирдилар, чунки улар жуда яхши эди.")[0] == "uz"
    assert classify("12345 !!!") == (None, 0.0)


def test_wrong_labels(spark):
    s = SENTENCES
    rows = [(1, s["uz"], "uz"), (2, s["uz"], None), (3, s["uz"] + " " + s["ru"], "uz"), (4, s["en"], " "), (5, s["kk"], "ky"), (6, None, "uz"), (7, "", None), (8, s["uz"] + " «Тихая река» degan kitobni oʻqidilar va juda yaxshi dedilar.", "uz"), (9, s["ru"], "uz")]
    df = spark.createDataFrame([(*r, 0.0, "r", 1, "s") for r in rows], CRAWL)
    junk = spark.createDataFrame([(9,)], "crawl_id bigint")
    got = la.wrong_labels(df, la.document_languages(la.language_segments(df)), junk)
    assert sorted(map(tuple, got.collect())) == [(2, "uz"), (3, "ru"), (3, "uz"), (4, "en"), (5, "kk")]
    assert la.language_segments(df.limit(0)).count() == 0


def test_segments_have_places(spark):
    text = SENTENCES["uz"] + "\n" + SENTENCES["ru"]
    df = spark.createDataFrame([(1, text, "uz", 0.0, "r", 1, "s")], CRAWL)
    rows = la.language_segments(df).orderBy("start_pos").collect()
    assert [r["lang"] for r in rows] == ["uz", "ru"]
    assert text[rows[1]["start_pos"] :].startswith("Вчера") and rows[0]["confidence"] > la.MARGIN


def test_rejected_segments_have_no_confidence(spark):
    df = spark.createDataFrame([(1, "Va. " + SENTENCES["uz"] + " Xxx qqq zzz www.", "uz", 0.0, "r", 1, "s")], CRAWL)
    rows = la.language_segments(df).orderBy("start_pos").collect()
    assert {r["lang"] for r in rows} >= {None, "uz"} and all((r["lang"] is None) == (r["confidence"] is None) for r in rows)


def test_many_texts_are_classified_as_one_by_one():
    classify = la.Classifier(la.fit([]))
    texts = [*SENTENCES.values(), "", "12 !", "\n".join(SENTENCES.values()), "ş " * 50]
    assert la.segments_of(texts, classify) == [la.segments_of([t], classify)[0] for t in texts]
    for text in SENTENCES.values():
        assert la.prepared(text, [(0, len(text))]) == ([la.plain(text)], [la.is_cyrillic(text)])


def test_dictionaries_hold_the_words_of_every_row(spark):
    """Words that only a long labelled text, or only one row after hundreds, teaches are known."""
    new = ["blorxa", "drenpu", "kvalmi", "zotrig", "fumbek", "lisharn", "ömbrak", "qosvit"]
    sentence = "Bugun {} maktabda {} yangi kitoblar haqida gapirdilar, chunki ular juda yaxshi edi."
    long_ = " ".join(sentence.format(new[i % 4], new[(i + 1) % 4]) for i in range(400))
    late = [sentence.format(f"olma{i:04}"[:4], "nok") + f" {i}." for i in range(600)] + [sentence.format(a, b) for a, b in zip(new[4:], new[5:] + new[4:5])]
    texts = [(long_, "uz"), *((x, "uz") for x in late), (" ".join(new[:4] + new[1:3]).capitalize() + ".", None), (" ".join(new[4:] + new[5:7]).capitalize() + ".", None)]
    assert len(long_) > 20_000
    df = spark.createDataFrame([(i, x, lang, 0.0, "r", 1, "s") for i, (x, lang) in enumerate(texts)], CRAWL)
    got = {r["crawl_id"]: r["lang"] for r in la.language_segments(df).where(F.col("crawl_id") >= len(texts) - 2).collect()}
    assert got == {len(texts) - 2: "uz", len(texts) - 1: "uz"}
    words = {r["word"]: r["n"] for r in la.confirmed_words(df).collect()}
    assert words["blorxa"] == 200 and words["nok"] == 600


# --- sentences -------------------------------------------------------------------------------------------

CUTS = [
    ["Ota prof. I.N. Qirmizova bilan keldi!", "Narxi 8.2 mln.", "Bola 1747-y. 10-martda ketdi."],
    ["«Kitob yaxshi!» — dedi Zebo.", "Keyin u ketdi…", "— Qani?\n— soʻradi ota."],
    ["Suv, non va h. k. bor edi.", "Olma, uzum va h. k.", "Tunda yomgʻir yogʻdi."],
    ["Ota keldi (bola yoʻq edi!) va ketdi.", "“Ha,” dedi u."],
    ["Ota uzoq… yurdi.", "Dr. Brown came at 5 p.m. that day.", "It is 4.54 now?"],
    ["XII. Uzun yoʻl"],
    ["今天邻居来了。", "老师说：「昨天我买了书！」", "晚上他走了吗？"],
    ["मेरा मित्र आता है ।", "क्या वह आता है?"],
    ["ครูซื้อแอปเปิล", "ชาวนาปลูกต้นไม้"],
    ["هل رأى صديقي بيتا؟", "كتب الطبيب رسالة."],
]


@pytest.mark.parametrize("parts", CUTS)
def test_sentence_spans(parts):
    joint = "" if parts[0][0] in "今" else " "
    text = joint.join(parts)
    assert [text[a:b] for a, b in se.sentence_spans(text)] == parts


@pytest.mark.parametrize("opened, closed", ["«»", "„“", "“”", '""', "()"])
@pytest.mark.parametrize("inner", [3, 5, 60])
def test_long_quotations_are_one_sentence(opened, closed, inner):
    said = opened + " ".join(["Kitob juda yaxshi keldi!"] * inner) + closed
    parts = [f"{said} — dedi Zebo.", "Keyin u ketdi.", f"Ota {said} dedi.", "Ona ketdi."]
    text = " ".join(parts)
    assert [text[a:b] for a, b in se.sentence_spans(text)] == parts


def test_long_sentences_and_stray_marks():
    parts = ["Uyda " + ", ".join(["A. B. Karimov"] * 80) + " bor edi.", "«Ota keldi.", "Ona ketdi.", "Besh yil oʻtdi."]
    text = " ".join(parts)
    assert [text[a:b] for a, b in se.sentence_spans(text)] == parts


def test_empty_lines_and_breaks():
    text = "Bosh soʻz\n \nOta uzoq\nyurdi. Ona\nkeldi\n\n\n  \nTamom."
    assert [text[a:b] for a, b in se.sentence_spans(text)] == ["Bosh soʻz", "Ota uzoq\nyurdi.", "Ona\nkeldi", "Tamom."]
    assert se.sentence_spans("") == se.sentence_spans(" \n ") == []


def test_sentence_table(spark):
    df = spark.createDataFrame([(1, "Ota keldi. Ona ketdi.", "e"), (2, None, "e"), (3, "", "e"), (4, "Ota keldi. Ona ketdi.", "e"), (None, "A.", "e")], "book_id bigint, text string, sent_no string")
    got = sorted((r["book_id"], r["end_pos"]) for r in se.sentences(df).collect())
    assert got == [(1, 10), (1, 21), (4, 10), (4, 21)]


def test_long_text_is_linear():
    text = "Ota keldi. " * 5000
    assert len(se.sentence_spans(text)) == 5000


def test_many_stray_marks_are_linear():
    assert len(se.sentence_spans("«Ota keldi. " * 3000)) == 3000


# --- packing ---------------------------------------------------------------------------------------------


def test_fullest_is_the_best_subset():
    rng = random.Random(3)
    for _ in range(200):
        lengths = [rng.randrange(1, 40) for _ in range(rng.randrange(1, 9))]
        room = rng.randrange(1, 80)
        best = max((sum(c) for k in range(len(lengths) + 1) for c in itertools.combinations(lengths, k) if sum(c) <= room), default=0)
        chosen = pk.fullest(Counter(lengths), room)
        assert sum(n * k for n, k in chosen.items()) == best
        assert all(Counter(lengths)[n] >= k for n, k in chosen.items())


def test_packing_is_whole(spark):
    rng = random.Random(5)
    words = ["olma", "kitob", "maktab", "va", "qora", "тўғри", "yozdi"]
    texts = [" ".join(rng.choices(words, k=rng.choice([3, 40, 300, 2500]))) for _ in range(120)] + [None, "", texts_twice := "bir xil matn", texts_twice]
    out = pk.pack(docs(spark, texts).repartition(3)).toPandas()
    tokens = [len(pk.encoder().encode_ordinary(t)) if t else 0 for t in texts]
    assert out.groupby("doc_id").n_tokens.sum().to_dict() == dict(enumerate(tokens))
    assert (out.groupby("doc_id").size() == [max(1, -(-n // pk.CAPACITY)) for n in tokens]).all()
    for _, s in out[out.n_tokens > 0].sort_values("seq_pos").groupby("seq_no"):
        assert list(s.seq_pos) == [0, *s.n_tokens.cumsum()[:-1]] and s.n_tokens.sum() <= pk.CAPACITY
    for _, d in out.sort_values("part").groupby("doc_id"):
        assert list(d.first_token) == [0, *d.n_tokens.cumsum()[:-1]]
    assert pk.pack(docs(spark, []).limit(0)).count() == 0


# --- leaks -----------------------------------------------------------------------------------------------

CONTEXT = "Kuzda oʻqituvchi Komila Xinozoda yosh bolalarga 256 ta qiziq kitobni berdi, chunki maktabda katta kutubxona bor edi."
CYR = "Кузда ўқитувчи Комила Хинозода ёш болаларга 256 та қизиқ китобни берди, чунки мактабда катта кутубхона бор эди."


def test_word_keys_do_not_depend_on_the_alphabet():
    new = CONTEXT.replace("oʻ", "ö").replace("sh", "ş").replace("ch", "ç")
    forms = [CONTEXT, new, CYR, CONTEXT.replace("ʻ", ""), CONTEXT.upper(), "<p>" + CONTEXT.replace(" ", "  \n") + "</p>", CONTEXT.replace("a", "а").replace("o", "ο"), CYR.replace("а", "a").replace("р", "p").replace("с", "c"), "​".join(CONTEXT)]
    assert len({" ".join(le.word_keys(f)) for f in forms}) == 1


@pytest.mark.parametrize("filter_bits", [(10, 30), (3, 3)])
def test_leaks(spark, filter_bits):
    words = CONTEXT.split()
    texts = ["Boshida. " + CYR + " Oxirida.", " ".join(words[:12]), " ".join(words[:11]), " ".join(words[:8] + ["yana"] + words[8:]), CONTEXT.replace("256", "300"), None, "", CONTEXT]
    items = [("a", CONTEXT, "x"), ("b", CYR, "x"), ("c", None, "x"), ("d", "qisqa", "x"), ("a", CONTEXT, "x"), (None, CONTEXT, "x")]
    table = spark.createDataFrame(items, "item_id string, context string, text string")
    got = {(r["doc_id"], r["item_id"]): (r["verbatim"] > 0, r["reparameterised"] > 0) for r in le.leaks(docs(spark, texts), table, filter_bits=filter_bits).collect()}
    verbatim = {k for k, v in got.items() if v[0]}
    assert verbatim == {(d, i) for d in (0, 1, 7) for i in "ab"}
    assert got[4, "a"] == (False, True)
    assert le.leaks(docs(spark, []).limit(0), table).count() == 0


@pytest.mark.parametrize("filter_bits", [(10, 30), (3, 3)])
def test_leaks_with_new_names_and_written_numbers(spark, filter_bits):
    decimal = "Kuzda oʻqituvchi yosh bolalarga har kuni 12,5 kilo qiziq meva va 1 000 ta daftar berdi, chunki maktabda bor edi."
    other = CONTEXT.replace("256", "31")
    texts = [
        other.replace("Komila Xinozoda", "Sardor Toʻlqinov"), CYR.replace("Комила Хинозода", "Сардор Тўлқинов").replace("256", "31"), other.lower(), other.replace("bolalarga", "qizlarga").replace("kitobni", "daftarni"),
        decimal.replace("12,5", "7").replace("1 000", "90"), decimal.replace("12,5", "13,7").replace("1 000", "2 500"), CONTEXT.upper(),
    ]
    table = spark.createDataFrame([("a", CONTEXT), ("b", decimal)], "item_id string, context string")
    got = {(r["doc_id"], r["item_id"]): (r["verbatim"] > 0, r["reparameterised"] > 0) for r in le.leaks(docs(spark, texts), table, filter_bits=filter_bits).collect()}
    assert got == {(d, i): (d == 6, d != 6) for d, i in ((0, "a"), (1, "a"), (2, "a"), (4, "b"), (5, "b"), (6, "a"))}


def test_verbatim_windows_meet_by_their_template(spark):
    """The windows of p6_found are hashed with numbers, units and names typed, slots alone with their words; equal slots decide."""
    names = np.array(sorted(le._number(k) for k in le.name_keys(CONTEXT)), dtype=np.uint64)
    windows = lambda text: le.Templates(names, replaced=False).windows([(k := le.word_keys(text), [""] * len(k))], True)
    (hashes, _, slots), = windows(CONTEXT)
    (others, _, _), = windows(CONTEXT.replace("256", "31").replace("Komila Xinozoda", "Xinozoda Komila"))
    assert len(names) == 2 and (hashes == others).all() and slots.sum() == 4  # "ta" is a unit
    numbers = " ".join(map(str, range(100, 113)))
    assert (windows(numbers)[0][0] != windows(numbers.replace("10", "20"))[0][0]).any()
    table = spark.createDataFrame([("a", CONTEXT), ("n", numbers)], "item_id string, context string")
    texts = [CYR, CONTEXT.replace("256", "31"), " ".join(CONTEXT.replace("Komila", "Xinozoda").split()[:14]), numbers, numbers.replace("100", "7").replace("112", "8")[2:], CONTEXT.upper()]
    found = {replaced: {(r["doc_id"], r["item_id"], r["verbatim"]) for r in le.leaks(docs(spark, texts), table, replaced=replaced).where("verbatim > 0").collect()} for replaced in (True, False)}
    assert found[True] == found[False] and {f[:2] for f in found[False]} == {(0, "a"), (3, "n"), (5, "a")}


def test_marked_keys_are_the_word_keys():
    texts = [CONTEXT, CYR, CONTEXT.upper(), "<P>San'At G‘Afur &AMP; ʼOybek 1 000,5 Sʼham</P> BMT \ue000x", "Aʻ'B‘C 3.5ta Ye tS"]
    assert all(le.marked_keys(t)[0] == le.word_keys(t) for t in texts)


# --- look-alikes -----------------------------------------------------------------------------------------

SAME = [("kitob", "ki­tob"), ("ａｂｃ", "abc"), ("соя", "cоя"), ("şer", "şer"), ("a b", "a b"), ("o'zbek", "oʻzbek"), ("ﬁl", "fil"), ("a‐b", "a-b"), ("Ⅱ", "II"), ("qiș", "qiş"), ("ӯ", "ў"), ("a\r\nb", "a\nb"), ("ο", "о"), ("…", "...")]
DIFFERENT = [("m²", "m2"), ("a b", "ab"), ("a\nb", "a b"), ("ў", "у"), ("Kitob", "kitob"), ("olma.", "olma!"), ("352", "332"), ("қ", "к"), ("a–b", "a-b")]


def test_canonical_forms():
    assert all(lk.canonical(a) == lk.canonical(b) for a, b in SAME)
    assert all(lk.canonical(a) != lk.canonical(b) for a, b in DIFFERENT)
    assert lk.canonical("STRAẞE", casefold=True) == lk.canonical("strasse", casefold=True)
    assert all(lk.canonical(lk.canonical(x)) == lk.canonical(x) for p in SAME + DIFFERENT for x in p)


def test_look_alike_pairs(spark):
    texts = ["olma nok", "olma nok", "olma nok", "оlma nok", None, "", "boshqa", "​", "olma. nok"]
    got = sorted(map(tuple, lk.look_alike_pairs(docs(spark, texts)).collect()))
    expected = sorted((i, j) for i, j in itertools.combinations(range(len(texts)), 2) if texts[i] is not None and texts[j] is not None and texts[i] != texts[j] and lk.canonical(texts[i]) == lk.canonical(texts[j]))
    assert got == expected and (0, 1) in got and (0, 2) not in got and (5, 7) in got
    table = {r["doc_id"]: (r["canonical_text"], r["changed"]) for r in lk.canonical_table(docs(spark, texts)).collect()}
    assert table[4] == (None, False) and table[1] == ("olma nok", True) and table[0] == ("olma nok", False)


def test_look_alike_classes(spark):
    texts = ["olma nok", "olma nok", "оlma nok", None, "boshqa", "boshqa", "Olma nok"]
    got = {r["doc_id"]: r for r in lk.look_alike_classes(docs(spark, texts)).collect()}
    assert {i: r["n_links"] for i, r in got.items()} == {0: 1, 1: 1, 2: 2}
    assert len({r["class_id"] for r in got.values()}) == 1 and got[0]["stored_id"] == got[1]["stored_id"] != got[2]["stored_id"]
    assert {r["doc_id"]: r["n_links"] for r in lk.look_alike_classes(docs(spark, texts), casefold=True).collect()} == {0: 2, 1: 2, 2: 3, 6: 3}
    assert lk.look_alike_classes(docs(spark, []).limit(0)).count() == 0


def test_window_filter_holds_every_hash():
    rng = np.random.default_rng(1)
    inside, others = rng.integers(-(2**63), 2**63 - 1, 5000), rng.integers(-(2**63), 2**63 - 1, 50_000)
    for bits in ((10, 30), (3, 3)):
        wanted = le.WindowFilter(inside.tolist(), len(inside), bits)
        assert wanted.may_hold(inside.view(np.uint64)).all()
    assert le.WindowFilter(inside.tolist(), len(inside)).may_hold(others.view(np.uint64)).mean() < 0.1
    assert not le.WindowFilter([], 0).may_hold(others.view(np.uint64)).any()


def test_planted_copies_with_other_names_and_numbers_are_found(spark):
    """Recall of re-parameterised copies of evaluation contexts that hold a number: another number must be found, whatever else the text holds."""
    items = spark.read.parquet("/root/testdata/sf0.01/eval_items.parquet").where("context IS NOT NULL").select("item_id", "context")
    contexts = sorted({r["context"] for r in items.collect()})
    numbered = [c for c in contexts if any(w.isdigit() and len(w) > 1 for w in c.split()) and len(c.split()) >= 14]
    planted = [" ".join(str(int(w) + 1111) if w.isdigit() and len(w) > 1 else w for w in c.split()) for c in numbered]
    got = {r["doc_id"] for r in le.leaks(docs(spark, planted), items).where("reparameterised > 0").collect()}
    assert len(got) >= 0.9 * len(planted) and planted


def test_queries_on_the_small_tables(spark):
    """Every query runs over its whole tables, and its result has the form its problem states."""
    from bitik.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    read = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    got = {name: q(spark, sf).toPandas() for name, q in QUERIES.items()}
    crawl, books, documents = read("uz_crawl").toPandas(), read("uz_books_v2").toPandas(), read("documents").toPandas()
    assert len(got["p1_pairs"]) > 0 and (got["p1_pairs"].w1 < got["p1_pairs"].w2).all() and set(zip(got["p1_found"].w1, got["p1_found"].w2)) <= set(zip(got["p1_pairs"].w1, got["p1_pairs"].w2))
    assert (got["p1_baskets"].w1 < got["p1_baskets"].w2).all()
    assert len(got["p2_statistics"]) == len(crawl) and set(got["p2_found"].crawl_id) == set(got["p2_statistics"][got["p2_statistics"].is_prose == False].crawl_id)  # noqa: E712
    assert set(got["p3_found"].lang) <= set(la.LANGUAGES) and not set(got["p3_found"].crawl_id) & set(got["p2_found"].crawl_id)
    assert set(got["p3_segments"].crawl_id) <= set(crawl.crawl_id) and (got["p3_segments"].start_pos < got["p3_segments"].end_pos).all()
    filled = books[books.text.fillna("").str.strip() != ""]
    assert set(got["p4_sentences"].book_id) == set(filled.book_id) == set(got["p4_found"].book_id)
    texts = dict(zip(books.book_id, books.text))
    assert all(texts[r.book_id][r.start_pos : r.end_pos] == r.sentence and r.sentence == r.sentence.strip() for r in got["p4_sentences"].itertuples())
    assert set(got["p5_packing"].doc_id) == set(documents.doc_id) and got["p5_packing"].groupby("seq_no").n_tokens.sum().max() <= pk.CAPACITY
    leaks = got["p6_leaks"]
    assert set(zip(got["p6_found"].doc_id, got["p6_found"].item_id)) == set(zip(leaks[leaks.verbatim > 0].doc_id, leaks[leaks.verbatim > 0].item_id)) and len(leaks)
    assert (got["p6_reparameterised"].reparameterised > 0).all() if len(got["p6_reparameterised"]) else True
    pairs, classes = got["p7_found"], got["p7_classes"]
    assert (pairs.doc_id_a < pairs.doc_id_b).all() and set(pairs.doc_id_a) | set(pairs.doc_id_b) == set(classes.doc_id) and classes.n_links.sum() == 2 * len(pairs)
    assert set(classes.doc_id) <= set(got["p7_caseless"].doc_id) and len(got["p7_canonical"]) == len(documents)
