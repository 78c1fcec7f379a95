"""Every core query against its SQL on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from granthika.plans import catalog

DATA = os.environ.get("TESTDATA_DIR", "/root/testdata") + "/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    v = v.item() if hasattr(v, "item") else v
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def rows(df: pd.DataFrame):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(x) for x in r) for r in df[cols].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in SQL:
        assert rows(got) == rows(duck.execute(SQL[name]).df())
