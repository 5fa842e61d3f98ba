"""The store by entity, the serve plan over it, and the counts that a build reports."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from riskloom.operators import scoring as S
from riskloom.plans import queries as Q, serve, views as V
from riskloom.sources import store
from tests.conftest import SF


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def entities_of(df) -> list:
    return sorted((r["entity_id"], r["x"]) for r in df.collect())


def test_one_entity_is_replaced_and_read_alone(spark, folder):
    first = spark.createDataFrame([("1", 1), ("1", 2), ("01", 3), ("b", 4)], "entity_id string, x int")
    store.write_by_entity(first, f"{folder}/t")
    store.write_by_entity(spark.createDataFrame([("1", 9)], "entity_id string, x int"), f"{folder}/t")
    read = store.read_by_entity(spark, f"{folder}/t", first.schema)
    assert read.columns == ["entity_id", "x"]
    assert entities_of(read) == [("01", 3), ("1", 9), ("b", 4)]
    one = store.read_by_entity(spark, f"{folder}/t", entity_id="1")
    assert entities_of(one) == [("1", 9)]
    assert "PartitionFilters: [isnotnull(entity_key" in plan(one).replace("`", "")


def test_null_and_blank_ids_have_folders_of_their_own(spark, folder):
    rows = spark.createDataFrame([(None, 1), ("", 2), ("none", 3)], "entity_id string, x int")
    store.write_by_entity(rows, f"{folder}/t")
    found = {r["x"]: r["entity_id"] for r in store.read_by_entity(spark, f"{folder}/t").collect()}
    assert found == {1: None, 2: "", 3: "none"}
    assert store.read_by_entity(spark, f"{folder}/t", entity_id="").collect()[0]["x"] == 2


@pytest.fixture(scope="module")
def made(spark):
    return Q.built(spark, SF)


def test_a_build_counts_its_stages_while_writing(made):
    counts = {r["stage"]: r["rows"] for r in made.counts().collect()}
    tables = {
        "input_posts": made.posts, "kept_posts": made.kept, "dropped_posts": made.dropped,
        "entity_rows_after_resolution": made.expanded, "entity_rows_risk_relevant": made.accepted,
        "entity_rows_dropped_no_risk": made.rejected, "narratives": made.narratives,
    }
    assert counts == {name: df.count() for name, df in tables.items()}
    assert counts["kept_posts"] + counts["dropped_posts"] == counts["input_posts"]
    assert "Scan parquet" in plan(made.kept) and "Aggregate" not in plan(made.counts())


def test_serving_one_entity_gives_its_part_of_the_whole(spark, made, folder):
    store.save(made.clustered, made.narratives, folder)
    authors = V.authors(spark, SF)
    fields = ["narrative_id", "title", "summary", "score", "volume", "taxonomy_labels"]

    def scored(entity_id=None):
        page = serve.overview(spark, folder, authors, Q.TAXONOMY, Q.WEIGHTS, entity_id)
        return page, {r["narrative_id"]: r for r in page.narratives.select("entity_id", *fields).collect()}

    every, all_rows = scored()
    stored = {r["narrative_id"]: r for r in made.narratives.select("entity_id", *fields).collect()}
    assert all_rows == stored  # titles, labels and scores come back as they were stored
    entity = next(iter(stored.values()))["entity_id"]
    page, own = scored(entity)
    assert own == {k: r for k, r in stored.items() if r["entity_id"] == entity} and own
    assert page.posts.select("entity_id").distinct().count() == 1
    assert page.total_posts.first()[0] == sum(r["volume"] for r in own.values())
    assert page.table.count() == len(own) and every.posts_by_day.count() > 0
    for df in (page.narratives_by_type, page.confidence_histogram, page.median_confidence, page.daily_total_risk):
        df.collect()
    served = serve.served_posts(spark, folder, authors, entity)
    assert plan(served).count("PartitionFilters: [isnotnull(entity_key") >= 1


def test_new_followers_change_served_scores(spark, made, folder):
    store.save(made.clustered, made.narratives, folder)
    many = V.authors(spark, SF).withColumn("followers", F.lit(1e9))
    page = serve.overview(spark, folder, many, Q.TAXONOMY, Q.WEIGHTS)
    before = {r["narrative_id"]: r["score"] for r in made.narratives.collect()}
    after = {r["narrative_id"]: r["score"] for r in page.narratives.collect()}
    assert set(before) == set(after) and all(after[k] >= before[k] for k in before)


IDS = ["10", "9", "", "b", "a", "abcdefghijklmnop2", "abcdefghijklmnop1", "abcdefghijklmn", "é", None]


def test_order_numbers_follow_strings(spark):
    df = spark.createDataFrame([(i,) for i in IDS], "post_id string")
    rows = df.select("post_id", S._order_number(df, "post_id").alias("n")).filter("post_id is not null").collect()
    by_text = sorted(rows, key=lambda r: r["post_id"].encode())
    assert [r["n"] for r in by_text] == sorted(r["n"] for r in rows)


def test_the_first_row_gives_the_strings_and_nothing_is_sorted_by_text(spark):
    rows = [("e", 1, i, f"name {i}", "outage", 0.9) for i in IDS] + [(None, 2, "7", "other", "", 0.5), ("f", 3, None, "lost", "", None)]
    df = spark.createDataFrame(rows, "entity_id string, narrative_id long, post_id string, entity string, text string, resolution_confidence double")
    made = S.score(df, None, Q.TAXONOMY, Q.WEIGHTS)
    got = {r["narrative_id"]: (r["entity_id"], r["entity"], r["volume"]) for r in made.collect()}
    assert got == {1: ("e", "name", 10), 2: (None, "other", 1), 3: ("f", None, 1)}
    assert "SortAggregate" not in plan(made)


def test_global_ids_of_gated_rows_follow_first_posts(spark):
    rows = Q.gated(spark, SF)
    first = rows.groupBy("narrative_id").agg(F.min("post_id").alias("p"), F.countDistinct("entity_id").alias("e")).orderBy("narrative_id").collect()
    assert [r["p"] for r in first] == sorted(r["p"] for r in first) and {r["e"] for r in first} <= {1}
