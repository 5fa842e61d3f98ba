"""Every named query against its SQL on the smallest tables; tests/compare.py runs larger ones."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from riskloom.plans import oracle, queries as named
from tests.compare import difference
from tests.conftest import SF

QUERIES, ORACLE = named.all_queries(), oracle.all_sql()


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE) == {"full_build"}
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    problem = difference(spark, con, SF, name, QUERIES, ORACLE)
    assert problem is None or problem.startswith("EMPTY"), problem


def test_entry(spark):
    assert entry.entry(spark).count() > 0
