"""Every query with SQL gives the same rows as DuckDB on the smallest data."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.sql(entry.oracle_sql()[name])
    assert sorted(found.columns) == columns
    places = [found.columns.index(c) for c in columns]
    ours = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    theirs = sorted(repr(tuple(plain(r[i]) for i in places)) for r in found.fetchall())
    assert ours == theirs


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_queries_without_sql_give_rows(spark):
    from mavuno.plans import ORACLES, QUERIES

    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, SF).count() > 0, name
