"""Every registered query against its SQL, at the smallest size."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from quillon import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLE = catalogue.queries(), catalogue.oracle_sql()
SLOW = {"ft_kmeans_sizes"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else ("f", float(f"{float(v):.9g}"))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, sf, duck, name):
    if name in SLOW:
        pytest.skip("compared at round time")
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((repr(tuple(plain(r[c]) for c in columns)) for r in df.collect()))
    cur = duck.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in cur.fetchall())
    assert got == want


def test_all_oracles_have_queries():
    assert ORACLE.keys() <= QUERIES.keys()


def test_entry(spark, monkeypatch):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()
