"""Named queries against their SQL on planted tables, for cases that the smallest tables lack."""

from __future__ import annotations

import duckdb
import pytest

from riskloom.plans import oracle, queries as named
from tests.compare import difference

QUERIES, ORACLE = named.all_queries(), oracle.all_sql()


def planted(spark, folder, texts):
    """A folder with ``documents`` of these texts and their events, and a connection to it."""
    docs = [(i, text, "en", "web", len(text)) for i, text in enumerate(texts, start=1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(
        f"{folder}/documents.parquet"
    )
    spark.sql("SELECT id * 10 AS event_id, timestamp'2024-01-01' AS ts, id AS user_id, 'view' AS event_type, 1.0D AS value, '{}' AS props"
              " FROM range(1, 9)").coalesce(1).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    for name in ("documents", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return con


def test_snippets_of_contexts_that_differ_behind_the_cut(spark, folder):
    opening = "Licensse thin " + "longer " * 50
    con = planted(spark, folder, [opening + "one.", opening + "two.", "Licensse thin."])
    assert difference(spark, con, folder, "narrative_snippets", QUERIES, ORACLE) is None
    snippets = QUERIES["narrative_snippets"](spark, folder).collect()
    assert sorted(r["first_post"] for r in snippets) == ["1", "3"]


@pytest.mark.parametrize("name", ["build_stage_counts", "stage_funnel"])
def test_stages_are_counted_by_one_pass_over_the_posts(spark, folder, monkeypatch, name):
    texts = ["Licensse thin license.", "Licensse thin.", "thin", "ined", "worthlesss thin Licensse trash."]
    con = planted(spark, folder, texts)
    assert difference(spark, con, folder, name, QUERIES, ORACLE) is None
    judged, plain = [], named.evaluated
    monkeypatch.setattr(named, "evaluated", lambda spark, sf: judged.append(sf) or plain(spark, sf))
    assert not [f for f in QUERIES[name](spark, folder).inputFiles() if "documents" in f]
    assert len(judged) == 1
