"""Every query against its SQL on the smallest tables. Queries without SQL have tests of their own."""

import os

import pytest
from compare import connect, difference

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = os.environ.get("TABFLOW_TABLES", "/root/testdata/sf0.001")
NAMES = sorted(queries())
SQLS = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n in NAMES if n in SQLS])
def test_matches_sql(spark, con, name):
    assert difference(queries()[name](spark, FOLDER), con, SQLS[name]) is None


def test_entry(spark):
    out = entry(spark)
    assert out.count() > 0
    assert "mjd_diff" in out.columns


def test_sql_names_are_queries():
    assert set(SQLS) <= set(NAMES)
