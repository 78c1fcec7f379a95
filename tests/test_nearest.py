"""The k nearest rows of each query: against brute force, and without a sort of all pairs."""

from __future__ import annotations

import math
import os
import random

import pytest

from granthika.operators import search as V
from granthika.plans import catalog, q_search


def vectors(n, seed, name):
    rnd = random.Random(seed)
    some = [[float(rnd.randint(-3, 3)) for _ in range(4)] for _ in range(20)]
    return [(f"{name}{i:03d}", rnd.choice(some) if rnd.random() < 0.5 else [float(rnd.randint(-9, 9)) for _ in range(4)]) for i in range(n)]


def frame(spark, rows, *cols):
    df = spark.createDataFrame(rows, f"{cols[0]} string, {cols[1]} array<float>")
    return df.withColumn(cols[2], V.norm(V.F.col(cols[1]))).filter(f"{cols[2]} > 0 or {cols[2]} is null")


def test_nearest_against_brute_force(spark):
    rows = vectors(400, 1, "r") + [("r-null", None), ("r-short", [1.0, 2.0])]
    rows += rows[:30]
    asked = vectors(12, 2, "q") + rows[5:10]
    got = {(r.query_id, r.row_id, r.cosine, r.rank) for r in V.nearest(frame(spark, asked, "query_id", "q_vec", "q_norm"), frame(spark, rows, "row_id", "vec", "norm").repartition(3), 7).collect()}
    want = set()
    dot = lambda a, b: sum((x * y for x, y in zip(a, b)), 0.0)
    for i, v in asked:
        near = {(-dot(v, w) / (math.sqrt(dot(v, v)) * math.sqrt(dot(w, w))), j) for j, w in rows if w is not None and len(w) == 4 and any(w) and any(v) and i != j}
        want |= {(i, j, -c, n + 1) for n, (c, j) in enumerate(sorted(near)[:7])}
    assert got == want and len(want) > 100


def test_nulls_come_last(spark):
    rows = [("a", [1.0, 0.0]), ("c", None), ("b", [1.0])]
    n = V.nearest(frame(spark, [("q", [1.0, 1.0])], "query_id", "q_vec", "q_norm"), frame(spark, rows, "row_id", "vec", "norm"), 3)
    assert [(r.row_id, r.cosine is None) for r in n.orderBy("rank").collect()] == [("a", False), ("b", True), ("c", True)]


def test_pairs_are_not_emitted(spark):
    rows = frame(spark, vectors(2000, 3, "r"), "row_id", "vec", "norm").repartition(9)
    asked = frame(spark, vectors(50, 4, "q"), "query_id", "q_vec", "q_norm")
    assert V.best_of_tasks(asked, rows, 3, "query_id", "row_id").count() <= 50 * 3 * spark.sparkContext.defaultParallelism


SMALL = os.environ.get("TESTDATA_DIR", "/root/testdata") + "/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")
@pytest.mark.parametrize("name", ["u3_candidate_concat", "u4_citation_union"])
def test_one_search_for_both_sides(spark, name):
    """The search is done once for both sides of a union, and its pairs are never a join's rows."""
    text = plan(catalog.queries()[name](spark, SMALL))
    assert "MapInArrow" not in text and "NestedLoopJoin" not in text


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")
@pytest.mark.parametrize("name", ["w3_split", "a19_faithfulness"])
def test_no_join_of_all_pairs(spark, name):
    assert "NestedLoopJoin" not in plan(catalog.queries()[name](spark, SMALL))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")
def test_faithfulness_searches_once_and_shuffles_texts_of_found_chunks_only(spark):
    assert "MapInArrow" not in plan(catalog.queries()["a19_faithfulness"](spark, SMALL))
    found = q_search.cut(q_search.results(spark, SMALL))
    asked, usual = q_search.evidence(spark, SMALL, found), q_search.evidence(spark, SMALL)
    assert "LeftSemi, BuildRight" in plan(asked)
    cols = ["query_id", "chunk_id", "qa_id", "start_char", "end_char", "rank", "span_text"]
    got = sorted(map(str, asked.select(cols).collect()))
    assert got == sorted(map(str, usual.select(cols).collect())) and got
