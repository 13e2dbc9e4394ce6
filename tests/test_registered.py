"""Every registered query against DuckDB, on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, duck
from ledgerlake.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", [n for n in queries() if n in QUERIES])
def test_query(spark, con, name):
    verdict, _, _ = compare(spark, con, SF_DIR, name)
    assert verdict == ("ok" if name in oracle_sql() else "rows only")


def test_entry(spark):
    assert entry(spark).count() > 0
