from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from riskloom.operators import scoring as S
from riskloom.plans.seeds import TAXONOMY_KEYWORDS, TAXONOMY_WEIGHTS
from riskloom.session import numbered

LABELS = list(TAXONOMY_WEIGHTS)


def rows(spark, data, schema="entity_id string, narrative_id bigint, post_id string, text string, entity string, "
         "created_at string, author_id string, likes string, resolution_confidence double"):
    return spark.createDataFrame(data, schema)


BASE = [
    ("e", 1, "p1", "a fraud and a leak", "E", "2024-01-01 10:00:00", "a1", "10", 0.97),
    ("e", 1, "p2", "fraud again", "E", "2024-01-01 11:00:00", "a1", "x", 0.88),
    ("e", 1, "p3", "calm", "E", "2024-01-05", " a2 ", None, None),
    ("f", 2, "p4", "calm", "F", "bad date", "none", "1", 0.97),
]


def authors(spark):
    return spark.createDataFrame(
        [("a1", 100.0, 0), ("a1", 900.0, 1), ("a2", 50.0, 2)], "author_id string, followers double, load_order int"
    )


def test_score_of_a_small_narrative(spark):
    out = {r["narrative_id"]: r for r in S.score(rows(spark, BASE), authors(spark), TAXONOMY_KEYWORDS, TAXONOMY_WEIGHTS).collect()}
    one = out[1]
    assert (one["volume"], one["engagement"], one["entity"]) == (3, 10, "E")
    # an author counts once per post and the first duplicate wins: 100 + 100 + 50
    influence = round(min(20.0, math.log1p(250) * 2.5), 2)
    assert one["score_components"]["Author influence pressure"] == influence
    assert one["taxonomy_labels"] == ["Financial Integrity", "Data / Cyber"]
    assert one["score_components"]["Language signal: Data / Cyber"] == 3.75
    assert one["score"] == round(15 + 0.15 + influence + 4.0 + 3.75, 1)
    assert len(one["score_components"]) == 10
    mean = (0.97 + 0.88 + 0) / 3
    combined = 0.5 * mean + 0.5 * min(1, math.log1p(3) / math.log1p(12))
    assert one["risk_score_confidence"] == ("Medium" if combined >= 0.5 else "Low")
    assert out[2]["taxonomy_labels"] == ["Operational Resilience"]
    assert out[2]["title"] == "F: Operational Resilience"


def test_trend_shapes(spark):
    got = {r["narrative_id"]: r["trend"] for r in S.trend(rows(spark, BASE)).collect()}
    assert got[1] == [round(2 - i / 11, 2) for i in range(12)]  # two present days, the gap is not filled
    assert got[2] == [pytest.approx(i / 11) for i in range(12)]  # no dates: a ramp
    single = rows(spark, BASE[:2])
    assert S.trend(single).first()["trend"] == [2.0] * 12


def test_null_keys_are_a_group(spark):
    data = [(None, 1, "p", "t", "E", "2024-01-01", "a1", "1", 0.9), (None, 1, "q", "t", "E", "2024-01-01", "a1", "1", 0.9)]
    out = S.score(rows(spark, data), authors(spark), TAXONOMY_KEYWORDS, TAXONOMY_WEIGHTS).collect()
    assert [(r["entity_id"], r["volume"], r["trend"][0]) for r in out] == [(None, 2, 2.0)]


def test_own_followers_win_over_the_lookup(spark):
    df = rows(spark, BASE).withColumn("followers", F.lit("7"))
    assert {r["_followers"] for r in S.with_followers(df, authors(spark)).collect()} == {7.0}
    assert S.author_influence(df, authors(spark)).filter("narrative_id = 1").first()["influence"] == pytest.approx(math.log1p(21))


def test_label_validation_and_points(spark):
    df = spark.createDataFrame(
        [(1, [LABELS[1], "Nope", LABELS[0], LABELS[1], LABELS[2], LABELS[3]]), (2, ["Nope"])], "id int, raw array<string>"
    )
    got = {r[0]: r[1] for r in df.select("id", S.valid_labels(F.col("raw"), LABELS)).collect()}
    assert got == {1: [LABELS[1], LABELS[0], LABELS[2]], 2: []}
    # an unknown label gives no points but uses up its rank
    points = df.filter("id = 1").select(*S.label_points(F.col("raw"), TAXONOMY_WEIGHTS)).first()
    assert list(points) == [4.5, 4.0, 0.0, 0.0, 0.0, 0.0, 0.0]


def test_supplied_labels_win(spark):
    supplied = spark.createDataFrame([("e", 1, [" Customer Harm ", ""])], "entity_id string, narrative_id bigint, supplied_labels array<string>")
    out = S.score(rows(spark, BASE), authors(spark), TAXONOMY_KEYWORDS, TAXONOMY_WEIGHTS, supplied)
    assert {r["narrative_id"]: r["taxonomy_labels"] for r in out.collect()} == {1: ["Customer Harm"], 2: ["Operational Resilience"]}


def test_stored_titles_labels_and_first_row(spark):
    df = rows(spark, BASE).withColumns(
        {
            "narrative_title": F.when(F.col("post_id") == "p1", "It's “x”").otherwise("other"),
            "narrative_summary": F.lit(" s  'q' "),
            "narrative_taxonomy_labels": F.array(F.lit("Data / Cyber")),
        }
    )
    one = S.score(df, authors(spark), TAXONOMY_KEYWORDS, TAXONOMY_WEIGHTS).filter("narrative_id = 1").first()
    assert (one["title"], one["summary"], one["taxonomy_labels"]) == ("Its x", "s q", ["Data / Cyber"])


@pytest.mark.parametrize("title,used", [("", False), ("cut...", False), ("x" * 88 + "...", True), ("x" * 87 + "...", False), ("fine", True)])
def test_usable_titles(spark, title, used):
    assert spark.range(1).select(S.usable_title(F.lit(title))).first()[0] is used


def test_snippets_are_distinct_and_cut(spark):
    df = rows(spark, BASE).withColumn("risk_summary", F.lit("x" * 300))
    got = S.snippets(df).filter("narrative_id = 1").collect()
    assert [(r["snippet"], r["first_post"]) for r in got] == [("x" * 257 + "...", "p1")]


def test_numbering_is_whole_and_ordered(spark):
    df = spark.range(1000).selectExpr("id", "(id * 7919) % 1000 AS v")
    out = numbered(df, [F.col("v").desc(), F.col("id")], "rank").collect()
    assert sorted(r["rank"] for r in out) == list(range(1, 1001))
    assert all(r["rank"] == 1000 - r["v"] for r in out)


def test_metadata_misses_give_empty_text(spark):
    df = rows(spark, BASE)
    meta = spark.createDataFrame([(1, "t", "s")], "narrative_id bigint, title string, summary string")
    got = {r["post_id"]: r["narrative_title"] for r in S.attach_metadata(df, meta).collect()}
    assert got == {"p1": "t", "p2": "t", "p3": "t", "p4": ""}
