"""Every query with SQL equals DuckDB over the same tables."""
import datetime
import decimal
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for name in os.listdir(small):
        path = f"{small}/{name}"
        c.execute(f"create view {name.split('.')[0]} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, small, con, name):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = con.execute(SQL[name])
    theirs = [d[0] for d in rel.description]
    assert sorted(theirs) == cols
    want = Counter(tuple(plain(r[theirs.index(c)]) for c in cols) for r in rel.fetchall())
    assert got == want


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).limit(5).count() == 5
