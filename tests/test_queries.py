"""Every registered query against its SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
import oracle

QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return oracle.connect(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, folder, name):
    assert oracle.differences(spark, con, QUERIES[name], folder, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
