"""Every registered query against its SQL at the smallest scale."""

import pytest
from oracle_check import compare, connect, run_sql

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert len(set(df.columns)) == len(df.columns)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    assert compare(df.columns, rows, *run_sql(con, sql)) is None


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(NAMES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["tag_a", "tag_b", "n"] and df.count() > 0
