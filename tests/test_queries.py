"""Every registered query that has SQL gives the SQL's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if hasattr(v, "item"):
        v = v.item()
    return str(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{sf}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(n for n in SQL if not n.startswith(("op", "pipeline"))))
def test_query(spark, sf, duck, name):
    got = entry.queries()[name](spark, sf).toPandas()
    want = duck.execute(SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (sorted(tuple(map(plain, r)) for r in x[cols].itertuples(index=False, name=None)) for x in (got, want))
    assert a == b
    assert len(want)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
