"""Every registered query against its SQL; those without SQL must at least give rows."""

import pytest

import __spark_entry__ as entry
from compare import connect, of_spark, of_sql

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    columns, rows = of_spark(QUERIES[name](spark, SF_DIR))
    expected_columns, expected = of_sql(con, ORACLES[name])
    assert columns == expected_columns
    assert rows == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"daily_pipeline"}))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_daily_pipeline_runs(spark):
    assert "price" in QUERIES["daily_pipeline"](spark, SF_DIR).columns


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_a_stable_schema(spark):
    out = entry.entry(spark)
    assert out.columns[:2] == ["symbol", "ts"] and "FinBERT_Score" in out.columns
    out.count()
