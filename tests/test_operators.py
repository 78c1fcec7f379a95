"""Operators on small rows with values worked out by hand, odd rows, and plain versions of the same rules."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from granthika.functions import scoring as K
from granthika.functions import text as T
from granthika.operators import answer, chunking, compose, layout, lexical, manifest, metrics, ops, qacite
from granthika.operators import search as V
from granthika.operators.udfs import query_segments, translate

ROOT = os.environ.get("TESTDATA_DIR", "/root/testdata")
DATA = f"{ROOT}/sf0.001"


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    return [r[0] for r in df.select(column(F.col("c"))).collect()]


def test_scripts(spark):
    assert one(spark, T.block_language, "स्वास्थ्य सेवा", "plain words", "ab कख", "", None, "12 34") == ["ne", "en", "mixed", "mixed", "mixed", "mixed"]
    assert one(spark, T.devanagari_ratio, "स्वास्थ्य सेवा")[0] == pytest.approx(13 / 7)
    assert one(spark, T.filename_language, "नियम_2070", "act_2070", "12") == ["ne", "en", "en"]


def test_noise(spark):
    assert one(spark, T.is_garbage, "short", "a b c d e f g h i j", "1234 5678 9012 3456", "This is a quite normal sentence.", None) == [True, True, True, False, True]
    assert one(spark, T.coherence, "", "two words", "these are some longer words here") == [0.0, 0.3, 1.0]


def test_reconstruction(spark):
    new, score = T.reconstruct(F.col("c"))
    r = spark.createDataFrame([("the rnan x vvalks",), ("plain words",)], "c string").select(new, score).collect()
    assert r[0][0] == "the man walks" and r[0][1] == 1.0 and tuple(r[1]) == ("plain words", 0.0)


def test_query_features(spark):
    assert one(spark, T.domain, "health law", "covid vaccine health", "nothing") == ["constitution", "covid", "general"]
    assert one(spark, T.is_tabular, "how many", "plain", "12345", "") == [True, False, True, False]
    assert one(spark, T.synonym_expansion, "public health now", "nothing") == ["public medical now", None]
    assert one(spark, lambda c: T.expansions(c, "en"), "health plan")[0] == ["health plan", "health sector health plan", "health plan medical services"]
    assert one(spark, T.target_language, "", None, "नियम के छ", "what is it") == ["en", "en", "ne", "en"]


@pytest.mark.parametrize("n, size, overlap, want", [(0, 10, 2, 1), (10, 10, 2, 1), (11, 10, 2, 2), (18, 10, 2, 2), (19, 10, 2, 3)])
def test_window_counts(spark, n, size, overlap, want):
    df = spark.createDataFrame([(1, " ".join(map(str, range(n))), 5)], "id int, text string, window_no_x int")
    rows = chunking.windows(df, "text", size, overlap).orderBy("window_no").collect()
    assert len(rows) == want and sum(r.token_count for r in rows) == n + overlap * (want - 1)


def test_chunk_numbers(spark):
    df = spark.createDataFrame([("d", "p2", "b1", 3), ("d", "p1", "b1", 2), ("d", "p1", "b2", 1), ("e", "p1", "b1", 1)], "doc string, page string, blk string, n int")
    got = {(r.doc, r.page, r.blk): r.first_chunk for r in chunking.numbered(df, "doc", "page", "blk", "n").collect()}
    assert got == {("d", "p1", "b1"): 0, ("d", "p1", "b2"): 2, ("d", "p2", "b1"): 3, ("e", "p1", "b1"): 0}


def test_table_text(spark):
    assert one(spark, chunking.table_text, '{"data":[["a","b"],["c","d"]]}', "no json", None) == ["[TABLE: 2 rows × 2 cols]\na\tb\nc\td", "[TABLE]\nno json", "[TABLE]"]


def greedy(rows, p):
    out, pages, docs = [], {}, {}
    for r in sorted(rows, key=lambda r: (-r[4], r[1])):
        if pages.get(r[2], 0) < p.per_page and docs.get(r[3], 0) < p.per_doc or r[4] > p.free_score:
            out.append(r[1])
            pages[r[2]] = pages.get(r[2], 0) + 1
            docs[r[3]] = docs.get(r[3], 0) + 1
            if len(out) >= 2 * p.k:
                break
    return out


@pytest.mark.parametrize("seed", range(4))
def test_caps_equal_the_greedy_loop(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(80):
        doc = rnd.randrange(4)
        rows.append(("q", f"c{i:02d}", f"d{doc}p{rnd.randrange(3)}", f"d{doc}", rnd.choice([0.2, 0.5, 0.9, 1.2, 1.6]) if rnd.random() < 0.5 else round(rnd.random(), 3)))
    p = V.SearchParams(k=8)
    df = spark.createDataFrame(rows, "query_id string, chunk_id string, page_id string, doc_id string, score double")
    got = [r.chunk_id for r in V.diversified(df, params=p).orderBy("rank").collect()]
    assert got == greedy(rows, p)


def test_overlaps(spark):
    iou = lambda *v: spark.range(1).select(K.interval_iou(*[F.lit(x).cast("int") for x in v])).first()[0]
    assert [iou(0, 10, 5, 15), iou(0, 10, 10, 20), iou(0, 10, None, None), iou(5, 5, 0, 10)] == [pytest.approx(1 / 3), 0.0, 0.0, 0.0]
    box = lambda a, b: spark.range(1).select(K.box_iou(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)))).first()[0]
    assert box([0.0, 0.0, 2.0, 2.0], [1.0, 1.0, 3.0, 3.0]) == pytest.approx(1 / 7) and box([0.0, 0.0, 1.0, 1.0], [2.0, 2.0, 3.0, 3.0]) == 0.0


def test_ndcg_by_hand(spark):
    df = spark.createDataFrame([("q", 1, 0.3), ("q", 2, 1.0), ("z", 1, 0.0)], "query_id string, rank int, rel double")
    got = {r.query_id: r.ndcg for r in metrics.ndcg(df).collect()}
    from math import log2

    assert got["q"] == pytest.approx((0.3 + 1 / log2(3)) / (1 + 0.3 / log2(3))) and got["z"] == 0.0


def test_lexical_phrases(spark):
    q = lexical.with_query_features(spark.createDataFrame([("q", "A b a")], "query_id string, query string"))
    assert sorted((p.p, p.k) for g in q.first().phrases for p in g) == [("a b", 2), ("a b a", 3), ("b a", 2)]
    q = lexical.with_query_features(spark.createDataFrame([("q", "word"), ("r", "")], "query_id string, query string"))
    assert [r.phrases for r in q.collect()] == [[], []]


def test_lexical_search_odd_rows(spark):
    q = spark.createDataFrame([("q", "water supply plan", "en", "auto")], "query_id string, query string, query_lang string, prefer string")
    rows = [("c1", "d", "p", "authoritative", "en", "the water supply plan of the town"), ("c1", "d", "p", "authoritative", "en", "the water supply plan of the town"), ("c2", "d", "p", None, None, None), ("c3", "d", "p", "x", "ne", ""), ("c4", "d", "p", "x", "ne", "water " * 20000)]
    df = spark.createDataFrame(rows, "chunk_id string, doc_id string, page_id string, source_authority string, language string, text string")
    for v in lexical.VARIANTS:
        got = [r.chunk_id for r in lexical.lexical_search(q, df, v).orderBy("rank").collect()]
        assert got[0] == "c1" and got.count("c1") == 1 and "c2" not in got
        assert lexical.lexical_search(q, df.limit(0), v).count() == 0


def test_answers(spark):
    rows = [("q", "d1", "d1_page_001", 1, "a" * 250, 0, 250), ("q", "d2", "d2_page_002", 2, "short", 3, 8), ("q", "d1", "d1_page_001", 3, "b", 0, 1)]
    df = spark.createDataFrame(rows, "query_id string, doc_id string, page_id string, rank int, span_text string, start_char int, end_char int")
    e = answer.round_robin(df)
    assert [r.rank for r in e.orderBy("pick").collect()] == [1, 2, 3]
    queries = spark.createDataFrame([("q", "en"), ("z", "ne")], "query_id string, query_lang string")
    got = {r.query_id: r for r in answer.answers(queries, e).collect()}
    assert got["q"].answer.split("\n")[1] == "• short [[doc:d2|page:2|span:3:8]]" and "..." in got["q"].answer and not got["q"].is_refusal
    assert got["z"].is_refusal and got["z"].evidence_count == 0
    cites = answer.citations(answer.answers(queries, e), "query_id", "answer").collect()
    assert [(c.doc_id, c.page_num, c.start_char, c.end_char) for c in sorted(cites, key=lambda c: c.pos)] == [("d1", 1, 0, 250), ("d2", 2, 3, 8), ("d1", 1, 0, 1)]


def test_changes(spark):
    m = spark.createDataFrame([("a", "1", 1), ("b", "2", 1), ("b", "3", 2), ("c", None, 1)], "doc_id string, sha256 string, at int")
    line = spark.createDataFrame([("a", "1", ["s"]), ("b", "2", ["s", "t"])], "doc_id string, sha256 string, shard_ids array<string>")
    ch = ops.changed(ops.latest(m, "doc_id", "at"), line)
    assert {(r.doc_id, r.change) for r in ch.collect()} == {("b", "modified"), ("c", "new")}
    assert {r.shard_id for r in ops.affected_shards(ch, line).collect()} == {"s", "t"}


def test_gates(spark):
    g = spark.createDataFrame([("a", 1.0, 0.05, True), ("b", 0.0, 0.05, True), ("c", None, 0.05, False), ("d", 1.0, 0.05, False)], "metric string, baseline double, threshold double, is_critical boolean")
    c = spark.createDataFrame([("a", 0.8), ("b", 0.1), ("d", 0.93), ("e", 1.0)], "metric string, current double")
    assert {(r.metric, r.severity, r.rollback) for r in ops.regressions(g, c).collect()} == {("a", "severe", True), ("d", "minor", False)}
    assert {r.metric for r in ops.metric_changes(g, c).collect()} == set("abcde")


def test_titles_and_years(spark):
    assert one(spark, manifest.title_of, "x/act_of-the_land.pdf", "एक_दुई.pdf") == ["Act of the Land", "एक दुई"]
    a, w, c = manifest.classified(F.col("c"))
    df = spark.createDataFrame([("en_wiki_x.pdf",), ("mohp_plan.pdf",), ("wp-content_x.pdf",), ("x.pdf",)], "c string")
    assert [tuple(r) for r in df.select(a, w, c).collect()] == [("non_authoritative", True, "high"), ("authoritative", False, "medium"), ("non_authoritative", False, "low"), ("non_authoritative", False, "low")]
    assert one(spark, manifest.year_of, "a 1999 b 2015.", "a_2015_b", "2015मा 2060", None) == [2015, None, None, None]


def test_quality_gates(spark):
    good = "Households received survey maps from every office because spring floods damaged bridges near villages"
    df = spark.createDataFrame([(good, 80.0), (good, 65.0), (good, 50.0), (good, None), ("12 34 56 78 90 11 22", 90.0), (None, 90.0)], "c string, conf double")
    got = [r[0] for r in df.select(qacite.text_quality(F.col("c"), F.col("conf"))).collect()]
    assert got[0] > got[1] > 0 and got[2:] == [0.0] * 4
    v = spark.createDataFrame([("survey maps from every office", good), ("entirely different wording here", good), ("", good), (None, good)], "a string, b string")
    assert [r[0] for r in v.select(qacite.valid_answer(F.col("a"), F.col("b"))).collect()] == [True, False, False, False]


def test_splits_cover(spark):
    df = spark.createDataFrame([(i,) for i in range(100)], "id int")
    got = {r.part: r["count"] for r in qacite.split_sets(df, "id").groupBy("part").count().collect()}
    assert got == {"train": 70, "dev": 15, "test": 15}


def test_spans_of_answers(spark):
    df = spark.createDataFrame([("Water supply now", "the water SUPPLY plan")], "a string, t string")
    assert [tuple(x) for x in df.select(compose.exact_spans(F.col("a"), F.col("t")).alias("s")).first().s] == [(4, 9), (10, 16)]
    assert df.select(compose.fuzzy_spans()(F.lit("vvater suply"), "t").alias("s")).first().s == [4, 16]


def test_arrow_operators(spark):
    df = spark.createDataFrame([("नेपाल health policy",), ("COVID-19 response",), (None,)], "q string")
    got = [[(x.text, x.language) for x in r.s] for r in df.select(query_segments()("q").alias("s")).collect()]
    assert got == [[("नेपाल", "ne")], [("COVID-", "en"), ("response", "en")], []]
    t = translate({"water": "पानी"})
    assert spark.createDataFrame([("Water 12 [[doc:a|page:1|span:0:2]] water.",), (None,)], "q string").select(t("q").alias("x")).collect()[0].x == "पानी 12 [[doc:a|page:1|span:0:2]] पानी"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
def test_signature_index_recall(spark):
    from granthika.plans import q_compose, q_search

    exact = {(r.query_id, r.row_id) for r in q_search.w2_nearest(spark, f"{ROOT}/sf0.1").filter("rank <= 10").collect()}
    near = {(r.query_id, r.row_id) for r in q_compose.m3_signature_index(spark, f"{ROOT}/sf0.1").collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_histogram_labels(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (0.5,), (1.0,), (None,)], "x double")
    assert {r.label: r.n for r in metrics.histogram(df, "x").collect()} == {"0.00-0.20": 2, "0.20-0.40": 0, "0.40-0.60": 1, "0.60-0.80": 0, "0.80-1.00": 1}
    assert [(r.label, r.n) for r in metrics.histogram(df.filter("x = 0.5"), "x").collect()] == [("0.50", 1)]
    assert metrics.histogram(df.limit(0), "x").count() == 0


def test_safety_report(spark):
    gates = spark.createDataFrame([("authority_purity", 0.9, 0.05, True), ("char_iou", None, 0.1, False), ("refusal_rate", 0.0, 0.1, False)], "metric string, baseline double, threshold double, is_critical boolean")
    bad = ops.regressions(gates, spark.createDataFrame([("authority_purity", 0.5)], "metric string, current double"))
    r = ops.safety_report(bad).first()
    assert (r.total, r.critical, r.severe, r.rollback, r.approval) == (1, 1, 1, True, True) and ops.METRIC_ADVICE["authority_purity"] in r.recommendations and r.recommendations.endswith(ops.ROLLBACK_ADVICE)
    assert ops.safety_report(bad.limit(0)).first().recommendations == ops.NO_REGRESSION
    c = {x.metric: (x.absolute, x.relative) for x in ops.metric_changes(gates, spark.createDataFrame([("refusal_rate", 0.5), ("char_iou", 0.5)], "metric string, current double")).collect()}
    assert c["refusal_rate"] == (0.5, 50000.0) and c["char_iou"] == (0.5, 50.0)


def test_upserted_lineage(spark):
    m = spark.createDataFrame([("a", "s1", 1), ("a", "s2", 3), ("b", "s1", 2)], "doc_id string, sha256 string, at int").selectExpr("doc_id", "sha256", "timestamp_seconds(at) retrieved_at")
    l = spark.createDataFrame([("a", "s1", "completed", ["x"], 1), ("c", "s9", "failed", None, 1)], "doc_id string, sha256 string, status string, shard_ids array<string>, at int").selectExpr("*", "timestamp_seconds(at) last_processed").drop("at")
    got = {r.doc_id: (r.sha256, r.status, r.added_at is not None and r.added_at.timestamp()) for r in ops.upserted(m, l).collect()}
    assert got == {"a": ("s2", "pending", 1.0), "b": ("s1", "pending", 2.0), "c": ("s9", "failed", False)}


def test_publish_and_roll_back(spark, tmp_path):
    old, less = spark.range(100), spark.range(10)
    enough = lambda a, b: b.count() >= 0.95 * a.count()
    assert compose.publish(old, str(tmp_path), "1", None) == "1"
    assert compose.publish(less, str(tmp_path), "2", enough) == "1" and compose.in_use(spark, str(tmp_path))[1].count() == 100
    assert compose.publish(spark.range(99), str(tmp_path), "3", enough) == "3" and compose.in_use(spark, str(tmp_path))[0] == "3"


def test_watermark_reasons(spark):
    rows = [("b1", "d", "p1", 0, "Times-Italic", 10.0, "some text", [0.0, 300.0, 10.0, 310.0]), ("b2", "d", "p2", 0, "Arial", 10.0, "DRAFT (c)", [0.0, 400.0, 10.0, 410.0])]
    o = spark.createDataFrame(rows, "block_id string, doc_id string, page_id string, pos int, font string, size double, text string, bbox array<double>")
    got = {r.block_id: set(r.reasons) for r in layout.drop_reasons(o).collect()}
    assert "rotation" in got["b1"] and "text_pattern" in got["b2"] and "rotation" not in got["b2"]
    faint = {tuple(r.reasons) for r in layout.drop_reasons(o.withColumn("flags", F.lit(0)).withColumn("colour", F.lit(100))).collect()}
    assert all("alpha" in x and "rotation" not in x for x in faint)


def test_domain_of_a_question(spark):
    q = spark.createDataFrame([("What does the Constitution say?",), ("कोभिड खोप",), ("Disaster relief",), ("Who?",), (None,)], "q string")
    assert [r.d for r in q.select(answer.domain_of(F.col("q")).alias("d")).collect()] == ["constitution", "covid", "emergency", "general", "general"]
