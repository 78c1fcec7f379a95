"""Running lines repeat fuzzily: every key of a document is a possible partner, wherever it stands in an order."""

from __future__ import annotations

import random

import pytest

from granthika.llm import page_noise as P


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def keys(seed):
    rnd = random.Random(seed)
    out = {}
    for d in "ab":
        made = []
        for _ in range(60):
            k = "".join(rnd.choice("abcनd") for _ in range(rnd.randint(1, 60)))
            if made and rnd.random() < 0.5:
                k = list(rnd.choice(made))
                for _ in range(rnd.randint(1, 9)):
                    at = rnd.randrange(len(k) + 1)
                    k[at : at + rnd.randint(0, 1)] = rnd.choice(["", "x", "न"])
                k = "".join(k)
            if k:
                made.append(k)
                low = rnd.choice([None, "p1", "p2", "p3"])
                out[d, k] = (d, k, 1 if rnd.random() < 0.9 else 2, low, low if rnd.random() < 0.9 else "p9", rnd.choice([0.0, 0.3, 1.0]))
    return list(out.values())


@pytest.mark.parametrize("group_keys", [20_000, 25])
def test_against_all_pairs(spark, group_keys):
    rows = keys(3)
    want = set()
    for d, k, pages, low, high, u in rows:
        near = [1 for e, o, _, l2, h2, v in rows if d == e and k != o and (low and l2 and low != l2 or high and h2 and high != h2) and edits(k, o) <= max(len(k), len(o)) * (P.EDITS + P.MORE_EDITS * max(u, v))]
        if pages >= P.PAGES or near:
            want.add((d, k))
    got = [tuple(r) for r in P._fuzzy(spark.createDataFrame(rows, "doc_id string, key string, pages long, low string, high string, unsure double"), group_keys).collect()]
    assert set(got) == want and len(got) == len(want) and 30 < len(want) < len(rows)


def test_misread_at_both_ends(spark):
    """Neither the beginnings nor the ends of two close keys are equal, so that no order brings them together."""
    one, two = "qministryoffinancebudgetspeechyx", "aministryoffinancebudgetspeechyz"
    rows = [("d", one, 1, "p1", "p1", 0.0), ("d", two, 1, "p2", "p2", 0.0), ("d", "somethingelsestandsonthispageonly", 1, "p3", "p3", 0.0)]
    got = {r.key for r in P._fuzzy(spark.createDataFrame(rows, "doc_id string, key string, pages long, low string, high string, unsure double")).collect()}
    assert got == {one, two}
