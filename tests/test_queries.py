"""Every query with SQL gives DuckDB's rows; the others keep their schema and are held to rules."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from strandline.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    mine = QUERIES[name](spark, DATA)
    theirs = duck.execute(SQL[name])
    names = [d[0] for d in theirs.description]
    assert sorted(mine.columns) == sorted(names)
    assert rows_of(mine.columns, mine.collect()) == rows_of(names, theirs.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs_without_sql(spark, name):
    first, again = (QUERIES[name](spark, DATA) for _ in range(2))
    a = rows_of(first.columns, first.collect())
    assert a and a == rows_of(again.columns, again.collect())
    if "valid" in first.columns:
        assert all(r[sorted(first.columns).index("valid")] for r in a)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
