import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

import __spark_entry__ as spark_entry  # noqa: E402
from compare import difference, oracle  # noqa: E402


# The corpus queries, where they are installed, have tests of their own.
QUERIES = {name: plan for name, plan in spark_entry.queries().items() if name not in spark_entry._CORPUS[0]}
SQL = {name: sql for name, sql in spark_entry.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def connection(sf_dir):
    return oracle(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf_dir, connection, name):
    assert difference(QUERIES[name](spark, sf_dir), connection, SQL[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    row = spark_entry.entry(spark).first()
    assert row.drifted and row.or_value > 2


def test_every_sql_belongs_to_a_query():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())
