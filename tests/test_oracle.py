"""Queries against their SQL in DuckDB at the smallest scale."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from kinfold.plans import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for name in ("part", "customer", "orders"):
        c.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    clean = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else float(x) if isinstance(x, (bool, int, float)) else str(x)
    return sorted(map(str, (tuple(clean(v[k]) for k in order) for v in values)))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["pt06_lpt_bins", "pt07_simple_blocks", "sk03_diagnostics"])
def test_rows_only(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
