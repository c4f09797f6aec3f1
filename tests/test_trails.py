"""The queries over events, orders and lines against their SQL, on the smallest tables."""

import os

import pytest

from crawlsight.plans import trails
from crawlsight.plans.queries import ORACLE, QUERIES

TABLES = "/root/testdata/sf0.001"
NAMES = [n for n, f in QUERIES.items() if f.__module__ == trails.__name__]


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def tables():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(TABLES):
        pytest.skip("no tables")
    con = duckdb.connect()
    for f in os.listdir(TABLES):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{TABLES}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_is_its_sql(spark, tables, name):
    got = QUERIES[name](spark, TABLES)
    told = tables.execute(ORACLE[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == sorted(got.columns)
    expected = sorted(repr([plain(v) for v in r]) for r in told.fetchall())
    assert expected and sorted(repr([plain(r[c]) for c in names]) for r in got.collect()) == expected


def test_readings_are_parted_at_their_own_commas():
    assert trails._columns("a AS x, f(a, b) AS y, 'p, (q' AS z") == ["a AS x", "f(a, b) AS y", "'p, (q' AS z"]
