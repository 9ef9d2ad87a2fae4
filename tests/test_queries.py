"""Registered queries against their SQL oracles on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return connection


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return "NaN" if math.isnan(v) else round(v, 9)
        return v

    return sorted([tuple(repr(value(r[i])) for i in order) for r in rows])


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 60


def test_entry(spark):
    assert entry.entry(spark).first()["selected"] == 1500


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, duck, name):
    mine = entry.queries()[name](spark, SF)
    theirs = duck.sql(entry.oracle_sql()[name])
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert plain([tuple(r) for r in mine.collect()], mine.columns) == plain(theirs.fetchall(), theirs.columns)


@pytest.mark.parametrize("name", ["p1_store_files", "p3_unified", "parsed_tests", "recovered_contracts", "expression_issues", "unwrapped_fences"])
def test_runs_without_sql(spark, name):
    assert entry.queries()[name](spark, SF).count() >= 0
