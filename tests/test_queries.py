"""Every query with SQL against DuckDB on the smallest tables; every other runs."""

import math
import os

import duckdb
import pytest

from colloquy import queries as core

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.6f}"
    return str(v)


@pytest.mark.parametrize("name", list(core.queries()))
def test_query(spark, con, name):
    got = core.queries()[name](spark, DATA)
    rows = got.collect()
    sql = core.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    rel = con.sql(sql)
    cols = sorted(got.columns)
    assert cols == sorted(rel.columns)
    order = [rel.columns.index(c) for c in cols]
    want = sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in rows) == want
