"""Registered queries against their DuckDB equivalents at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from chunkloom.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return bytes(value).hex() if isinstance(value, (bytes, bytearray)) else value


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    got = QUERIES[name](spark, SF)
    rows = sorted(map(str, (tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect())))
    assert rows
    if name in ORACLES:
        want = tables.sql(ORACLES[name])
        at = [want.columns.index(c) for c in sorted(want.columns)]
        assert sorted(want.columns) == sorted(got.columns)
        assert rows == sorted(str(tuple(plain(r[k]) for k in at)) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
