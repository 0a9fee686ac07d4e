"""Registered queries against their SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tools.compare import compare, connect


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, con, name):
    _, problem = compare(spark, con, name, SF)
    assert problem == ""
