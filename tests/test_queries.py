"""Every registered query against its SQL on the smallest test folder."""

from __future__ import annotations

import pytest
from conftest import SMALL

import __spark_entry__ as contract
import oracle

QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    result = QUERIES[name](spark, SMALL)
    if name in SQL:
        assert oracle.difference(result, duck, SQL[name]) is None
    else:
        assert result.columns


def test_entry_gives_rows(spark):
    assert contract.entry(spark).count() > 0


def test_every_check_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
