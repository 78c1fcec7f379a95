"""Corpus word counts: one narrow Python pass that adds up per slice, then one small shuffle by word."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

#: A lexical word: letters with their signs; digits, marks of punctuation and spaces part words.
WORD = r"(?:[^\W\d_]|[̀-ͯऀ-ःऺ-ॏ॑-ॗॢॣ‌‍])+"


def count_words(df: DataFrame, text_col: str = "text", pattern: str = WORD, where: str | None = None, rows: int = 4000, within: str | None = None) -> DataFrame:
    """(word, n): how often each match of pattern stands in the texts of all rows; with `where`, only words in which it is found.

    With `within`, a wider and simpler pattern, whose matches hold those of pattern whole: texts are cut by it, and pattern is
    applied once to each distinct cut.  Null texts count nothing; an empty table gives no rows."""
    inner = re.compile(pattern).findall if within else None
    pattern = within or pattern
    find, keep = re.compile(pattern).findall, re.compile(where).search if where else None

    def run(batches):
        total: Counter[str] = Counter()
        for b in batches:
            for at in range(0, b.num_rows, rows):
                for t in b.column(0).slice(at, rows).to_pylist():
                    if t:
                        total.update(find(t))
            if len(total) > 200_000:
                yield _batch(_inner(total, inner), keep)
                total = Counter()
        if total:
            yield _batch(_inner(total, inner), keep)

    return spread(df.select(text_col)).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _inner(total: Counter, find) -> Counter:
    if find is None:
        return total
    out: Counter[str] = Counter()
    for cut, n in total.items():
        for w in find(cut):
            out[w] += n
    return out


def _batch(total: Counter, keep) -> pa.RecordBatch:
    items = [(w, n) for w, n in total.items() if keep is None or keep(w)]
    return pa.RecordBatch.from_arrays([pa.array([w for w, _ in items], pa.string()), pa.array([n for _, n in items], pa.int64())], ["word", "n"])
