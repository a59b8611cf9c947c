"""Every query with SQL gives DuckDB's rows at the smallest scale; entry() has a stable schema."""

import pytest

import __spark_entry__ as entry
from tests import oracle_check

SF = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()
NAMES = sorted(ORACLE)


@pytest.fixture(scope="module")
def con():
    return oracle_check.duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    ok, _, note = oracle_check.compare(spark, con, SF, name, entry.queries()[name], ORACLE[name])
    assert ok, note


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == entry.entry(spark).columns


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(entry.queries())
