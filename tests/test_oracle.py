"""Every registered query gives the rows of its SQL."""

import os

import pytest

from tests.oracle import compare, connect
from workload import ORACLE, QUERIES

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLE:
        assert compare(df, connection, ORACLE[name]) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
