"""Queries with SQL against DuckDB over whole tables."""

from __future__ import annotations

import duckdb
import pytest

from riskloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.all_sql())
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(queries.all_sql()[name])
    columns = sorted(want.columns)
    rows = sorted(map(repr, want.project(", ".join(columns)).fetchall()))
    got = queries.all_queries()[name](spark, SF).select(*columns).collect()
    assert rows and sorted(repr(tuple(r)) for r in got) == rows
