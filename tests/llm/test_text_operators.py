from __future__ import annotations

import datetime
import random
import time
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from granthika.llm import encoding_repair as E
from granthika.llm import language_labels as G
from granthika.llm import leakage as K
from granthika.llm import lookalikes as L
from granthika.llm import page_noise as P
from granthika.llm import personal_information as I
from granthika.llm import sentences as S
from granthika.llm import tokenize as T


# --- 7: tokenizer ---------------------------------------------------------------------------------------------------

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def bpe():
    path = f"{T.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
    ranks = T.read_ranks(path)
    return T.encoder(path), tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ours(enc, texts):
    flat, offsets = enc.encode(texts)
    return [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.characters(codec="utf-8"), max_size=60)), max_size=8))
def test_ids_equal_the_library(bpe, texts):
    assert ours(bpe[0], texts) == [bpe[1].encode_ordinary(t) if t else [] for t in texts]


def test_ids_of_real_shapes(bpe):
    texts = ["गर्‍यो। Rs. 9,47,966   \n\n  डा. को", "don't I'LL  we're 's", " " * 40, "\t\n x", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "<|endoftext|>", "汉字漢字 ﬁ é é ‍", "x" * 50_000]
    assert ours(bpe[0], texts) == [bpe[1].encode_ordinary(t) for t in texts]


def test_ids_operator(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, " ", "c"), (3, "water", "d")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in T.encode_texts(df).collect())
    assert got[0] == (1, []) and got[1] == (2, []) and [3, [220]] in [list(x) for x in got] and len(got) == 4
    assert T.encode_texts(df.limit(0)).count() == 0


# --- 5: encodings ---------------------------------------------------------------------------------------------------

CLEAN = ["“Stop!” shouted the registrar – 5.2 °C", "दफा १२.१४.२ मा ऊर्जा ऐन, २०६६ बमोजिम", "L'été dernier à Gurasedanda, déjà abîmés", "修订后的交通重建计划预算为2301万卢比"]


@pytest.mark.parametrize("codec", ["latin-1", "cp437", "mac_roman", "cp1251", "cp850"])
@pytest.mark.parametrize("text", CLEAN)
def test_wrong_decoding_is_undone(codec, text):
    bad = text.encode().decode(codec, "replace") if codec != "cp1251" else "".join(bytes([b]).decode("cp1251", "ignore") or chr(b) for b in text.encode())
    fixed, undone, lost, _ = E.Channel({}).repair("plain words. " + bad)
    assert undone and fixed == "plain words. " + text and not lost


@pytest.mark.parametrize("text", CLEAN)
def test_twice_wrong(text):
    once = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in text.encode())
    twice = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in once.encode())
    assert E.Channel({}).repair(twice)[0] == text


@pytest.mark.parametrize("text", [*CLEAN, "Νоw mаny hеаlth cardѕ", "Really?! Why?", "", None, "résumé naïve Ångström « Non »"])
def test_clean_text_stays(text):
    assert E.Channel({}).repair(text)[:3] == (text, [], False)


def test_losses_are_reported(spark):
    rows = [("a", "???? ?? ???????? ??"), ("b", "d�clar� hier"), ("c", "fine?"), ("d", None), ("e", "â€œStop!â€� shouted"), ("e", "â€œStop!â€� shouted")]
    df = spark.createDataFrame(rows, "block_id string, text string").withColumnRenamed("text", "t")
    got = {r.block_id: r for r in E.restore(df, "block_id", "t").collect()}
    assert set(got) == {"a", "b", "e"} and got["a"].lost and got["e"].restored.startswith("“Stop!”") and not got["e"].lost
    assert E.restore(df.limit(0), "block_id", "t").count() == 0


# --- 3: look-alikes -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "a, b",
    [("ＡＢ１２", "AB12"), ("éte", "éte"), ("ofﬁce", "office"), ("a​b﻿c", "abc"), ("x y z", "x y z"), ("low‑cost", "low-cost"), ("टारकाे", "टारको"), ("अा", "आ"), ("क़", unicodedata.normalize("NFC", "क़")), ("छन् |", "छन् ।")],
)
def test_same_look(a, b):
    assert L.fold(a) == L.fold(b)


@pytest.mark.parametrize("a, b", [("12", "१२"), ("m²", "m2"), ("The", "the"), ("e", "é"), ("कि", "की"), ("…", "...")])
def test_other_look(a, b):
    assert L.fold(a) != L.fold(b)


def test_mixed_tokens_need_the_vocabulary(spark):
    df = spark.createDataFrame([(1, "Ноw mаny hеаlth cards", "k"), (2, None, "k"), (3, "", "k"), (4, "Привет мир", "k"), (4, "Привет мир", "k")], "id long, text string, word string")
    words = spark.createDataFrame([("How", 3), ("many", 2), ("cards", 1)], "word string, n long")
    got = sorted((r.id, r.text) for r in L.unify(df, ["text"], words).collect())
    assert got == sorted([(1, "How many hеаlth cards"), (2, None), (3, ""), (4, "Привет мир"), (4, "Привет мир")], key=lambda x: (x[0], x[1] or "")) or {g[0]: g[1] for g in got} == {1: "How many hеаlth cards", 2: None, 3: "", 4: "Привет мир"}
    assert L.unify(df.limit(0), ["text"], words).count() == 0
    assert sorted((r.id, r.text) for r in L.unify(df, ["text"], words, most=0).collect() if r.text) == sorted((i, t) for i, t in got if t)


# --- 4: sentences ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, want",
    [
        ("Stop here.Is it so? Yes.", ["Stop here.", "Is it so?", "Yes."]),
        ("He said: “Go. Now.” Then left.", ["He said: “Go. Now.”", "Then left."]),
        ("“Has it paid?” asked the registrar. Done.", ["“Has it paid?” asked the registrar.", "Done."]),
        ("“付清了吗？”采购员问道。下一句。", ["“付清了吗？”采购员问道。", "下一句。"]),
        ("Dr. Roe met at 10.30 a.m. on 2 May, i.e. early. Rs. 5 paid.", ["Dr. Roe met at 10.30 a.m. on 2 May, i.e. early.", "Rs. 5 paid."]),
        ("न.पा. वडा नं. ४मा बैठक बस्यो। अर्को वाक्य।", ["न.पा. वडा नं. ४मा बैठक बस्यो।", "अर्को वाक्य।"]),
        ("\"तिर्यो?\" भनी उनले सोधे। छ।", ["\"तिर्यो?\" भनी उनले सोधे।", "छ।"]),
        ("Annex 8: Goat Sheds\nThe first line runs\nover two lines. End.", ["Annex 8: Goat Sheds", "The first line runs\nover two lines.", "End."]),
        ("1. ten seats;\n2. two seats\nName: Ann Lee", ["1. ten seats;", "2. two seats", "Name: Ann Lee"]),
        ("« Un. Deux », a dit M. Dupont. Fin.", ["« Un. Deux », a dit M. Dupont.", "Fin."]),
        ("", []),
        (" \n\t ", []),
    ],
)
def test_units(text, want):
    assert [text[a:b] for a, b in S.units(text)] == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB. \n?!।“”\"«»1क।,。-:é"), max_size=80))
def test_units_cover_the_text(text):
    last = 0
    for a, b in S.units(text):
        assert last <= a < b and text[a:b] == text[a:b].strip() and not text[last:a].strip()
        last = b
    assert not text[last:].strip()


def test_long_text_without_marks():
    t = "word " * 40_000
    assert S.units(t) == [(0, len(t) - 1)]


# --- 9: personal information ----------------------------------------------------------------------------------------

NAMES = [(g + e, "given", "latin") for g in ("Mi", "Ko", "Ta") for e in ("van", "rali", "shen")] + [(g + e, "family", "latin") for g in ("Korpe", "Thalu", "Ulpa") for e in ("li", "mel", "yan")] + [("मिवन", "given", "devanagari"), ("कोर्पेली", "family", "devanagari")]


@pytest.mark.parametrize(
    "text, want",
    [
        ("It was signed by Mivan R. Korpeli today.", [("Mivan R. Korpeli", "name")]),
        ("निवेदक श्री मिवन कोर्पेलीले भने", [("मिवन कोर्पेली", "name")]),
        ("Mr. and Mrs. Jhumachaur Trust vs. Mivan Korpeli Memorial", []),
        ("mail a.b+c@x.example.org, d_e(at)mail.example or f [at] g [dot] com at 12 @ Rs. 5", [("a.b+c@x.example.org", "email"), ("d_e(at)mail.example", "email"), ("f [at] g [dot] com", "email")]),
        ("Call +977-9185348154, 009779170279887, (01) 124-6622, 905.065.8723 or 01-1202931.", [("+977-9185348154", "phone"), ("009779170279887", "phone"), ("(01) 124-6622", "phone"), ("905.065.8723", "phone"), ("01-1202931", "phone")]),
        ("Letter no. 1683-4884-2295 replaces circular 911817456; plot 18013521, Rs. 9,012,345,678", []),
        ("Passport no. 088185973; PAN XP9053283; नागरिकता नं. ८२-०७-६३-७२०८३", [("088185973", "id_number"), ("XP9053283", "id_number"), ("८२-०७-६३-७२०८३", "id_number")]),
        ("Address: 41/6 Sirjan Lane, Aanbunagar\nof House No. 125, Sirjan Marg, Ward 7, Sallerigaun.", [("41/6 Sirjan Lane, Aanbunagar", "address"), ("House No. 125, Sirjan Marg, Ward 7, Sallerigaun", "address")]),
        ("ठेगाना: १८२ सिर्जन टोल, वडा नं. ५, बेसीपुर। १७ वटा सडक बत्ती", [("१८२ सिर्जन टोल, वडा नं. ५, बेसीपुर", "address")]),
    ],
)
def test_places(text, want):
    assert [(text[a:b], k) for a, b, k in I.Finder(NAMES).find(text)] == want


def test_offsets_with_invisible_characters():
    text = "Mobile: 92​1.982­.4489 by Μi⁠van Korpeli"
    got = [(text[a:b], k) for a, b, k in I.Finder(NAMES).find(text)]
    assert got == [("92​1.982­.4489", "phone"), ("Μi⁠van Korpeli", "name")]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6))
def test_permutation_is_a_bijection(n):
    if n <= 3:
        assert len({I.permute(f"{x:0{n}d}", b"k", "t") for x in range(10**n)}) == 10**n
    assert len(I.permute("9" * n, b"k", "t")) == n and I.permute("1" * n, b"k", "t").isdigit()


def test_dates_and_links():
    days = [datetime.date(2000, 1, 1) + datetime.timedelta(k) for k in range(300)]
    assert len({I.permute_date(d, b"k") for d in days}) == 300
    a, b = (I.redact(t, I.Finder([]).find(t), b"k") for t in ("Mobile: 9185348154.", "Mobile: 918-5348154."))
    assert "".join(c for c in a if c.isdigit()) == "".join(c for c in b if c.isdigit()) != "9185348154" and "[PHONE" in a


@pytest.mark.parametrize("a, b", [("Tel: 01-4123456.", "Tel: +977-1-4123456."), ("Tel: 9185348154.", "Tel: +977 9185348154."), ("Tel: 061-523456.", "Tel: 00977-61-523456.")])
def test_one_phone_number_in_two_forms_has_one_pseudonym(a, b):
    def national(t):
        red = I.redact(t, I.Finder([]).find(t), b"k")
        assert "[PHONE " in red and t[5:-1] not in red
        digits = "".join(c for c in red if c.isdigit())
        return digits[I._national(digits) :]

    assert national(a) == national(b)


def test_days_of_long_months_are_replaced_and_stay_apart():
    found = {I.permute_shape(y, m, 32, b"k") for y in range(2000, 2090) for m in range(1, 13)}
    assert len(found) == 90 * 12
    assert "2045-03-32" not in I.redact("Born on 2045-03-32.", [], b"k") and I.redact("Born on 2045-13-40.", [], b"k") == "Born on 2045-13-40."


def test_tags_have_many_bits():
    assert len({I._pseudonym(f"p{k}@x.np", "email", b"k") for k in range(100_000)}) == 100_000


def test_short_identity_numbers():
    t = "Citizenship no. 12345 was shown."
    assert [t[a:b] for a, b, k in I.Finder([]).find(t) if k == "id_number"] == ["12345"]


# --- 8: leaks -------------------------------------------------------------------------------------------------------

ITEM = (1, "The auditor found nine wells in Rampur. Funds lapse on 3 May unless the board pays. Wards 2 and 7 share ten boats.", "What was found?", "nine wells in Rampur")


@pytest.mark.parametrize(
    "text, leaked",
    [
        ("x. THE AUDITOR found nine wells in Rampur! And so on. Wards 2 and 7 share ten boats.", True),
        ("Funds lapse on 3 May unless the board pays. Something else. The аuditor found nine wells in Rampur", True),
        ("The auditor found nine wells in Rampur.", False),
        ("What was found?", False),
        ("", False),
    ],
)
def test_leaks(text, leaked):
    others = [(k, f"Ward {k} of Place{k} met on {k} June with {k * 7} people. Item {k} was moved to hall {k * 3}.", "", "") for k in range(2, 60)]
    assert bool(K.Index([ITEM, *others]).leaks(text)) == leaked


def test_leaks_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, ITEM[1]), (3, ITEM[1]), (4, (ITEM[1] + " ward ") * 3000)], "doc_id long, text string").withColumn("item_id", __import__("pyspark").sql.functions.lit("x"))
    items = spark.createDataFrame([(1, ITEM[1], None, None), (1, ITEM[1], None, None), (2, None, "q", "a"), (None, "x", None, None), (3, ITEM[1], None, "")], "item_id int, passage string, question string, answer string")
    got = {(r.doc_id, r.item_id) for r in K.find_leaks(docs, items).collect()}
    assert got == {(3, 1), (3, 3), (4, 1), (4, 3)}
    assert K.find_leaks(docs, items.limit(0)).count() == 0 and K.find_leaks(docs.limit(0), items).count() == 0


def test_places_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "Call 9185348154."), (3, "Call 9185348154.")], "doc_id long, text string")
    names = spark.createDataFrame([("Mivan", "given", "latin"), (None, "given", "latin")], "name_part string, part_kind string, script string")
    assert sorted(tuple(r) for r in I.find_places(docs, names).collect()) == [(3, 5, 15, "phone")] * 2
    assert I.find_places(docs, names.limit(0)).count() == 2 and I.find_places(docs.limit(0), names).count() == 0
    red = {r.doc_id: r.text for r in I.redact_texts(docs, names, "k").collect()}
    assert red[1] is None and red[2] == "" and red[3].startswith("Call [PHONE 9")


def test_labels_of_odd_tables(spark):
    rows = [("a", SAMPLES["en"][0], "en"), ("a", SAMPLES["en"][0], "en"), ("b", None, "ne"), ("c", "", None), ("d", "1234", "ne"), ("e", SAMPLES["zh"][0] * 500, "zh")]
    df = spark.createDataFrame(rows, "chunk_id string, text string, language string")
    got = {r.id: [s.language for s in r.segments] for r in G.label_segments(df, "chunk_id", "text", "language").collect()}
    assert got == {"a": ["en"], "b": [], "c": [], "d": ["ne"], "e": ["zh"]}
    assert G.label_segments(df.limit(0), "chunk_id", "text", "language").count() == 0


def test_units_of_odd_tables(spark):
    df = spark.createDataFrame([(1, None), (2, " \n"), (3, "One. Two."), (3, "One. Two.")], "doc_id long, text string")
    assert sorted(tuple(r) for r in S.sentence_units(df).collect()) == [(3, 0, 4), (3, 0, 4), (3, 5, 9), (3, 5, 9)]
    assert S.sentence_units(df.limit(0)).count() == 0


def _crowd(n):
    rnd = random.Random(8)
    names = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(400)]
    return [(k, f"Ward {k} of {rnd.choice(names)} met {rnd.choice(names)} with {k * 7} people. The {rnd.choice(names)} was moved to hall {k * 3} by {rnd.choice(names)} and {rnd.choice(names)}.", "", "") for k in range(1, n)]


def test_no_score_at_the_threshold_is_passed_over():
    items = _crowd(300)
    ix = K.Index(items)
    import numpy as np

    of_term = np.repeat(np.arange(len(ix.term)), [ix.postings[a:b].sum() for a, b in zip(ix.start, ix.start[1:])])
    rnd = random.Random(3)
    for _ in range(40):
        ws = [w for k in rnd.sample(range(len(items)), 3) for w in K.words(items[k][1]) if rnd.random() < 0.8]
        for p in ix.passages(ws):
            full = np.bincount(ix.who, weights=ix.impact * np.isin(of_term, p), minlength=ix.n)
            got = ix.search([p])[1]
            assert sorted(got.tolist()) == np.flatnonzero(full >= 1 - 1e-6).tolist()


def test_verified_sentences_are_retrieved():
    items = _crowd(200)
    ix = K.Index(items)
    rnd = random.Random(5)
    for _ in range(60):
        s = rnd.randrange(ix.n)
        ws = list(ix.sentences[s])
        for k in rnd.sample(range(len(ws)), rnd.randint(0, 3)):
            ws[k] = "other"
        text = ["a", "ward"] * rnd.randint(0, 40) + ws + ["people"] * 20
        places = {}
        for k, w in enumerate(text):
            places.setdefault(w, []).append(k)
        if K.similarity(list(ix.sentences[s]), ix.weights(s), text, places) >= K.VERIFY:
            assert s in ix.search(ix.passages(text))[1].tolist()


def test_most_postings_are_skipped_and_joined_texts_leak_the_same():
    items = _crowd(1500)
    ix = K.Index(items)
    alone = [ix.leaks(f"Some words of ward 7 before it. {items[k][1]} And then people met in hall 9.") for k in range(0, 1000)]
    assert 0 < ix.scored < ix.all / 4
    together = ix.leaks(" ".join(f"Some words of ward 7 before it. {items[k][1]} And then people met in hall 9." for k in range(0, 1000)))
    assert {x[0] for x in together} == {x[0] for found in alone for x in found} >= {items[k][0] for k in range(1000)}


def test_items_in_parts_give_the_same(spark, monkeypatch):
    items = _crowd(60)
    docs = spark.createDataFrame([(k, f"Before. {items[k][1]} After.") for k in range(40)], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id int, passage string, question string, answer string")
    want = {tuple(r) for r in K.find_leaks(docs, table).select("doc_id", "item_id").collect()}
    monkeypatch.setattr(K, "ITEMS_AT_ONCE", 7)
    monkeypatch.setattr(K, "PARTS_AT_ONCE", 3)
    assert {tuple(r) for r in K.find_leaks(docs, table).select("doc_id", "item_id").collect()} == want and len(want) >= 40


# --- 6: languages ---------------------------------------------------------------------------------------------------

SAMPLES = {
    "en": ["The registrar may not relocate trail bridges without written consent from the board.", "Households headed by women received half of the survey maps."],
    "fr": ["Le budget révisé de la commune s'élève à huit millions de roupies pour les passerelles.", "Il manque encore trois réverbères après la crue de l'été dernier."],
    "hi": ["बाढ़ ने दो नहरें तोड़ दी थीं और सड़क की बत्तियाँ की कमी है।", "शिक्षा योजना की अवधि अगले साल तक बढ़ा दी गई है।"],
    "ne": ["स्वास्थ्य संयोजकको लिखित स्वीकृति बिना बीउ नवीकरण गर्न पाइने छैन।", "महिला घरमूली भएका परिवारले कर रसिदको हिस्सा पाएका छन्।", "Upabhoktale shramadan garne bhayekale samitile biu bitaran garne nirnaya gareko ho.", "Mulko bahab ghatekale gunaso petika darta garenan bhanera lekheka chhan."],
    "zh": ["修订后的能源保护行动预算为四千万卢比，其中三成用于路灯。", "主任必须在年底之前提交粮仓清单！"],
}


def test_held_out_languages():
    rows = [(lang, f"{a} {b}" if lang != "ne" else a) for lang, xs in SAMPLES.items() for a in xs for b in xs] * 5
    coder = G.train(rows)
    held = {"en": "The auditor wrote that the wards share the maps until the board pays.", "fr": "Pourquoi le programme de la santé a-t-il été déplacé de la commune ?", "hi": "क्या आयोग ने सड़क की मरम्मत के लिए धन दिया है और बढ़ा दिया है?", "ne": "समितिले लिखित स्वीकृति बिना निर्णय गरेका छन्।", "zh": "采购员要求检查太阳能泵的清单。"}
    got = {k: [s[0] for s in G.classify(coder, [v])[0]] for k, v in held.items()}
    assert got == {k: [k] for k in held}
    mixed = SAMPLES["en"][0] + "\n" + SAMPLES["ne"][0] + " " + SAMPLES["zh"][0]
    assert [s[0] for s in G.classify(coder, [mixed])[0]] == ["en", "ne", "zh"]
    assert G.classify(coder, [None, "", "12 34"]) == [[], [], []]


def test_codewords_are_apart():
    c = G.codewords()
    assert min((c[a] != c[b]).sum() for a in range(len(c)) for b in range(a)) >= 4


def test_labels():
    assert [G.canonical(x) for x in ("NEP", " ne-NP ", "Chinese", "und", "", None, "MIXED")] == ["ne", "ne", "zh", None, None, None, "mixed"]


def _sample():
    return [(k, t) for k, ts in SAMPLES.items() for t in ts for _ in range(3)]


def test_languages_of_no_profile_are_told_apart():
    coder = G.train(_sample())
    own = [t for ts in SAMPLES.values() for t in ts]
    for t in ("Вчера мэр открыл новый мост через реку и посетил школу.", "மேயர் நேற்று புதிய பாலத்தை திறந்து வைத்தார்.", "هل أنت هنا؟ نعم أنا هنا الآن في المدينة."):
        assert all(s[1] < 0.5 and s[2] for s in G.classify(coder, [t], True)[0])
    # the sample is tiny, so one of its own texts may stand apart
    assert sum(s[1] > 0.5 and not s[2] for found in G.classify(coder, own, True) for s in found) >= len(own) - 1


def test_segments_have_places():
    coder = G.train(_sample())
    t = f"{SAMPLES['en'][0]} {SAMPLES['zh'][0]}"
    found = G.classify(coder, [t], True)[0]
    assert [(s[0], t[s[3] : s[4]].strip()) for s in found] == [("en", SAMPLES["en"][0]), ("zh", SAMPLES["zh"][0])]


def test_no_labels_give_no_language(spark):
    df = spark.createDataFrame([("a", "The office of the district gave meters.", None)], "chunk_id string, text string, language string")
    assert [r.segments for r in G.label_segments(df, "chunk_id", "text", "language").collect()] == [[]]


# --- 2: pages -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("line, page, want", [("– ५ –", 5, True), ("[3]", 3, True), ("20 | P a g e", 20, True), ("Page 7 of 33", 2, True), ("पृ. २/५", 2, True), ("v", 5, True), ("12", 13, True), ("2081.", 4, False), ("2053).", 8, False), ("16.", 3, False), ("Nepal", 1, False), ("", 1, False)])
def test_page_numbers(line, page, want):
    assert P.page_number(line, page) == want


def test_breaks():
    assert P.join_breaks("written con-\nsent of pro¬\n vince; the low-\ncost plan, गर्नुप- र्छ", {"low-cost"}) == ("written consent of province; the low-cost plan, गर्नुपर्छ", True)
    assert P.join_breaks("a – b - c, pre-war", set()) == ("a – b - c, pre-war", False)


def test_confusions():
    assert "relocate" in P.undo("re1ocate") and "health" in P.undo("hcalth") and "भएका" in P.undo("भएफा") and "श्रम" in P.undo("शरम") and "million" in P.undo("rnillion")


def test_noise_of_blocks(spark):
    body = "The registrar may not relocate the trail bridges\nwithout written con-\nsent from the board of the ward and the\nauditor of the town in the year."
    rows = [(f"b{i}", "d", f"d_page_{i:03d}", "text", f"Town Council Report\n{body}\n{i}") for i in range(1, 9)]
    rows += [("x", "d", "d_page_020", "text", "Tovvn Council Rep0rt\nThe registrar may not re1ocate the trail bridges\nof the board of the ward and the auditor\nof the town in the year."), ("n", None, None, "text", None), ("e", "d", None, "text", ""), ("t", "d", None, "table", "con-\nsent")]
    df = spark.createDataFrame([(*r, 50.0, True, "k") for r in rows], "block_id string, doc_id string, page_id string, block_type string, text string, conf_mean double, source_page_is_ocr boolean, kinds string")
    from granthika.llm.common import cut

    found = cut(P.noise(df))
    kinds = {(r.block_id, k) for r in found.collect() for k in r.kinds}
    heads = {r.block_id for r in P.running(found).collect() if r.kind == "header"}
    assert heads == {f"b{i}" for i in range(1, 9)} | {"x"}
    assert {k for b, k in kinds if b == "b1"} == {"hyphenation", "page_number"} and ("x", "misread") in kinds
    assert P.noise(df.limit(0)).count() == 0
    assert {(r.block_id, k) for r in P.noise(df, most=0).collect() for k in r.kinds} == kinds
    for most in (0, 1000):
        text = {r.block_id: r.paragraph for r in P.paragraphs(df, most).collect()}
        assert text["b1"] == text["b8"] == " ".join(body.split()).replace("con- sent", "consent") and text["x"].startswith("The registrar may not relocate")


def _pages(spark, rows):
    return spark.createDataFrame([(f"b{k:02d}", d, f"{d}_page_{n:03d}", "text", t, conf, ocr) for k, (d, n, t, conf, ocr) in enumerate(rows)], "block_id string, doc_id string, page_id string, block_type string, text string, conf_mean double, source_page_is_ocr boolean")


WRAPPED = "The registrar may not relocate the {} of the ward\nwithout the written consent of the whole board and of\nthe auditor of the town in the course of the year and\nof {} others"


def test_lines_that_look_like_headers_but_stand_once_stay(spark):
    one, two = "Water at 79.0 °C flowed 9,896 km, i.e. from Survabas to", "Plots above 477 m² in Maidipani pay 97,486 ‰ more"
    rows = [("d", k, f"{t}\n{WRAPPED.format(k, k * 7)}", 60.0, True) for k, t in enumerate((one, two), 1)]
    out = {r.block_id: r for r in P.paragraphs(_pages(spark, rows)).collect()}
    assert out["b00"].paragraph.startswith(one) and out["b01"].paragraph.startswith(two) and "header" not in out["b00"].noise + out["b01"].noise


def test_footers_and_fuzzy_headers(spark):
    heads = ["Bhirkogaun Labour Commission | Annual Report 2080", "Bhirkog1un Labour Cornmission | Annual Report 2079", "Bhirkogaun Lab0ur Commissiqn | Annual Rcport 2078", "A plain first line of text that no other page has in it"]
    feet = ["Printed by the Department of Printing"] * 3 + ["and that was all there was on this page"]
    rows = [("d", k, f"{h}\n{WRAPPED.format(k, k * 7)}\n{f}", 40.0, True) for k, (h, f) in enumerate(zip(heads, feet), 1)]
    found = {(r.block_id, r.kind) for r in P.running(P.noise(_pages(spark, rows))).collect()}
    assert found == {("b00", "header"), ("b01", "header"), ("b02", "header"), ("b00", "footer"), ("b01", "footer"), ("b02", "footer")}
    out = {r.block_id: r.paragraph for r in P.paragraphs(_pages(spark, rows)).collect()}
    assert all("Annual" not in out[b] and "Printed" not in out[b] for b in ("b00", "b01", "b02")) and out["b03"].startswith("A plain first line") and out["b03"].endswith("on this page")


def test_page_numbers_at_an_offset(spark):
    rows = [("d", k, f"{WRAPPED.format(k, k * 7)}\n{k + 41}", None, None) for k in range(1, 5)] + [("e", k, f"{WRAPPED.format(k, k * 7)}\n{n}", None, None) for k, n in ((1, 90), (2, 300), (3, 17))]
    found = {(r.block_id, r.kind) for r in P.running(P.noise(_pages(spark, rows))).collect()}
    assert found == {(f"b{k:02d}", "page_number") for k in range(4)}


def test_every_table_comes_out_in_one_form(spark, tmp_path):
    from granthika.llm.lookalikes import p3_unified

    for name, key, col in (("documents", "doc_id", "text"), ("chunks", "chunk_id", "text"), ("corpus_blocks", "block_id", "text"), ("proper_manual_qacite", "qa_id", "answer_exact")):
        spark.createDataFrame([("1", "the \uff2finvoice\u00a0of p\u0430per"), ("2", "paper" if name == "chunks" else None)], f"{key} string, {col} string").write.parquet(f"{tmp_path}/{name}.parquet")
    got = {tuple(r) for r in p3_unified(spark, str(tmp_path)).collect()}
    names = ("documents", "chunks", "corpus_blocks", "proper_manual_qacite")
    assert got == {(n, "1", "the Oinvoice of paper") for n in names} | {(n, "2", "paper" if n == "chunks" else None) for n in names}


def test_every_chunk_has_a_language(spark, tmp_path):
    en, ne = "The office of the district gave the water meters to every school of the valley.", "जिल्ला कार्यालयले उपत्यकाका सबै विद्यालयलाई पानीका मिटर उपलब्ध गराएको छ।"
    rows = [(f"t{k}", t, "text", lang) for k in range(5) for t, lang in ((en, "en"), (ne, "ne"))][:10]
    rows = [(f"{i}-{lang}", t, k, lang) for i, t, k, lang in rows]
    rows += [("null", None, "text", None), ("blank", " ", "text", "en"), ("digits", "12 34", "text", None)]
    rows += [("table", '{"rows":2,"cols":2,"data":[["The district office","water meters"],["The school of the valley","12"]]}', "table", "ne"), ("broken", '{"data', "table", None), ("empty", '{"data":[["1"]]}', "table", None)]
    spark.createDataFrame(rows, "chunk_id string, text string, chunk_type string, language string").write.parquet(f"{tmp_path}/chunks.parquet")
    got = {r.chunk_id: r for r in G.p6_segments(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows}
    assert got["table"].language == "en" and got["table"].label_right is False and got["table"].language_confidence > 0.5
    for i in ("null", "blank", "digits", "empty"):
        assert (got[i].seg_no, got[i].language, got[i].language_confidence, got[i].label_right) == (1, "und", 0.0, None)


def test_a_word_of_rare_characters_is_among_the_readings(spark):
    word = "कझाझिझ"  # 3 lost bytes: 125 readings, of which characters alone rank this one low
    bad = lambda t: t.encode().decode("cp1252", "replace")
    rows = [("a", "कँ कए कऐ " * 200 + f"{word} " * 3), ("b", f"the {bad(word)} here {bad(word)}"), ("c", bad(f"{word}।{word}"))]
    got = {r.block_id: r.restored for r in E.restore(spark.createDataFrame(rows, "block_id string, t string"), "block_id", "t").collect()}
    assert got == {"b": f"the {word} here {word}", "c": f"{word}।{word}"}


@pytest.mark.parametrize("alphabet", ["ab", "aaaa", "abcdefghij", " theingand", "नेपालसरकार", "0123"])
def test_long_words_merge_as_short_ones(bpe, alphabet):
    rnd = random.Random(alphabet)
    for _ in range(40):
        w = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(2, 40))).encode()
        assert bpe[0]._merge_long(w) == [*bpe[0].merge(w[:48])] if len(w) <= 48 else True


def test_one_word_of_a_hundred_thousand_letters(bpe):
    rnd = random.Random(1)
    w = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))
    began = time.time()
    ids, _ = bpe[0].encode([w])
    assert b"".join(bpe[0].bytes_of[i] for i in ids.tolist()) == w.encode() and time.time() - began < 10


#: Held out of the rules: texts of two sentences each.
FURTHER = [
    "هل أنت هنا؟|نعم أنا هنا الآن.",
    "میں گھر جا رہا ہوں۔|وہ اسکول میں ہے۔",
    "ሰላም ነው።|እንዴት ነህ፧",
    "ကျွန်တော် သွားမယ်။|သူ လာမယ်။",
    "ខ្ញុំទៅផ្ទះ។|គាត់មកសាលា។",
    "Ես տուն եմ գնում։|Նա դպրոցում է։",
    "ผมไปตลาดแล้ว|เขาอยู่ที่บ้าน",
    "สำนักงานปิดวันนี้ครับ|เราจะเปิดอีกครั้ง",
]


@pytest.mark.parametrize("parts", FURTHER)
def test_end_marks_of_further_scripts(parts):
    t = parts.replace("|", " ")
    assert [t[a:b] for a, b in S.units(t)] == parts.split("|")


def test_no_span_is_too_long():
    line = "the item number which is called thing and which was sent to the office by the post in the"
    t = "The list of items which were received by the office is\n" + "\n".join([line] * 400) + " end.\nAnother sentence is here."
    assert [t[a:b][-12:] for a, b in S.units(t)] == ["in the end.", "nce is here."] or len(S.units(t)) == 2


def test_many_breaks_take_little_time():
    for t in ("word\n" * 20000, "“word\n" * 20000):
        began = time.time()
        assert S.units(t) and time.time() - began < 20
