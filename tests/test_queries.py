"""Every registered query against its DuckDB text, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        _, diff = compare(df, con, ORACLES[name])
        assert diff is None, diff
    else:
        assert df.columns
        df.collect()


def test_entry(spark):
    assert entry.entry(spark).count() == 20


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
