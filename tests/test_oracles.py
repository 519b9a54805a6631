"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from millrace.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    sql = duck.sql(registry.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    at = [sql.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in sql.fetchall())


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
