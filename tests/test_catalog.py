"""Every registered query against its SQL on the smallest supplied tables."""

import math
import os

import pytest

import __spark_entry__ as entry_module

duckdb = pytest.importorskip("duckdb")

QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()
# Slow fits that have no SQL; exercised in test_model.
SKIP = {"explanation_confidence"}


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    return repr(float(v)) if isinstance(v, (int, float)) else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SKIP))
def test_query(spark, sf_dir, db, name):
    df = QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    assert got
    if name in SQL:
        res = db.execute(SQL[name])
        names = [d[0] for d in res.description]
        assert sorted(names) == sorted(df.columns)
        assert rows_of(df.columns, got) == rows_of(names, res.fetchall())


def test_entry(spark, sf_dir):
    assert entry_module.entry(spark).count() == 25
