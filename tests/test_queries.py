"""Every registered query at sf0.001: runs, and equals its DuckDB oracle where one exists."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_mod
from tablecheck.plans import ORACLES, QUERIES, TABLES

SF = "/root/testdata/sf0.001"


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in records), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_contract(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_against_oracle(spark, con, key):
    df = QUERIES[key](spark, SF)
    got = df.collect()
    assert got or key == "undeclared_sources"
    if key not in ORACLES:
        return
    cur = con.execute(ORACLES[key])
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _rows(df.columns, [tuple(r) for r in got]) == _rows(ocols, cur.fetchall())
