"""Every registered query runs; where SQL is given, both sides agree."""

import os

import pytest
from compare import connect, differences

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    df = QUERIES[key](spark, SF)
    if key in SQL:
        assert differences(df, con, SQL[key]) == []
    else:
        assert df.count() >= 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "status" in df.columns
