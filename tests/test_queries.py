"""Every registered query with SQL gives DuckDB's rows; the entry point runs."""

import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from briefwell.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, sf, name):
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in place) for r in found.fetchall()), key=repr)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and {r["section"] for r in rows} >= {"overall", "Product"}


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
