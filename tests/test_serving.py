from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from riskloom.operators import dashboard as D, detail as X, report as R
from riskloom.plans import queries as Q, seeds, views as V
from riskloom.plans.build import build, save
from riskloom.sources import readers, sinks
from tests.conftest import SF


def rows(spark, data):
    schema = ("narrative_id bigint, post_id string, created_at string, resolution_confidence double, text string, "
              "author_id string, likes double, entity string, platform string")
    return spark.createDataFrame(data, schema).withColumn("entity_id", F.lit("e"))


DATA = [
    (1, "p1", "2024-01-01 09:00:00", 0.9, "Short text", "a", 1.0, "B", "x"),
    (1, "p2", "2024-01-03", None, "short  TEXT", "a", 2.0, "A", " y "),
    (1, "p3", "not a date", 0.5, "nan", None, 4.0, "A", ""),
    (1, "p4", "2024-01-03", 0.7, " ".join(f"w{i}" for i in range(40)), "b", 8.0, "B", "x"),
]


def scored(spark):
    return spark.createDataFrame([("e", 1, 50.0)], "entity_id string, narrative_id bigint, score double")


def test_series_fill_gaps_and_default_confidence(spark):
    got = {str(r["date"]): r["risk"] for r in X.risk_series(rows(spark, DATA), scored(spark)).collect()}
    assert len(got) == 7 and min(got) == "2023-12-28"
    assert got["2024-01-01"] == pytest.approx(45.0) and got["2024-01-02"] == 0.0
    assert got["2024-01-03"] == pytest.approx(50 * (0.5 + 0.7) / 2)
    delta = D.risk_delta(rows(spark, DATA), scored(spark)).first()["risk_delta"]
    assert delta == pytest.approx(30.0)
    activity = {str(r["date"]): (r["posts"], r["authors"], r["engagement"]) for r in X.activity_series(rows(spark, DATA)).collect()}
    assert activity["2024-01-03"] == (2, 2, 10.0) and activity["2024-01-02"] == (0, 0, 0.0)


def test_header_facts(spark):
    r = X.header_facts(rows(spark, DATA)).first()
    assert (r["first_seen"], r["posts"], r["engagement"], r["authors"], r["platforms"]) == (
        "2024-01-01 09:00", 4, 15.0, 2, ["x", "y"],
    )


def test_majority_ties_take_the_smallest_name(spark):
    assert D.majority_entity(rows(spark, DATA)).first()["majority_entity"] == "A"


def test_quotes_fill_up_with_chunks(spark):
    long = DATA[3][4]
    got = {r["position"]: r["quote"] for r in X.quotes(rows(spark, DATA)).collect()}
    assert got == {1: "Short text", 2: long[:117] + "...", 3: " ".join(f"w{i}" for i in range(18))}


def test_quotes_without_usable_contexts_use_the_text(spark):
    df = rows(spark, DATA[:1]).withColumn("risk_context", F.lit(" None "))
    assert [r["quote"] for r in X.quotes(df).collect()] == ["Short text"]


def test_histogram_edges(spark):
    values = spark.createDataFrame([(0.0,), (0.05,), (0.051,), (1.0,), (None,), (1.7,), (0.15,), (-1.0,)], "resolution_confidence double")
    got = {r["bin"]: r["frequency"] for r in D.confidence_histogram(values).collect()}
    assert len(got) == 20 and {b: n for b, n in got.items() if n} == {1: 4, 2: 1, 3: 1, 20: 2}


def test_median_counts_values(spark):
    values = spark.createDataFrame([(0.1,), (0.2,), (0.4,), (None,)], "resolution_confidence double")
    assert D.median_confidence(values).first()[0] == pytest.approx(0.15)


def test_drivers_and_components(spark):
    parts = F.create_map(
        F.lit("Volume pressure"), F.lit(15.0), F.lit("Language signal: Data / Cyber"), F.lit(-20.0),
        F.lit("Engagement pressure"), F.lit(14.9), F.lit("Author influence pressure"), F.lit(15.0),
    )
    df = spark.range(1).select(F.lit(1).alias("narrative_id"), parts.alias("score_components"),
                               F.array(F.lit(" ")).alias("taxonomy_labels"))
    assert df.select(D.risk_drivers()).first()[0] == ["Language Risk: Data / Cyber", "High Volume", "Influential Authors"]
    r = D.type_and_drivers(df).first()
    assert (r["risk_types"], len(r["drivers"])) == (["Operational Resilience"], 3)
    ranked = {x["feature"]: x["strength"] for x in X.component_ranking(df).collect()}
    assert ranked["High Volume"] == pytest.approx(0.75) and ranked["Language Risk: Data / Cyber"] == 1.0


def test_keyword_classes(spark):
    words = {"A": ["one", "two"], "B": ["three"], "C": ["four"]}
    data = [(1, "p1", None, 0.9, "Three one one", "a", 1.0, "E", "x"), (2, "p2", None, 0.9, "nil", "a", 1.0, "E", "x"),
            (3, "p3", None, 0.9, "three", "a", 1.0, "E", "x"), (3, "p4", None, 0.9, "one two", "a", 1.0, "E", "x")]
    got = {r["narrative_id"]: r["type"] for r in X.classify_by_keywords(rows(spark, data), words).collect()}
    assert got == {1: "A", 2: "Operational Resilience", 3: "A"}
    head = {r["narrative_id"]: r["type"] for r in X.classify_by_keywords(rows(spark, data), words, 1).collect()}
    assert head[3] == "B"


def test_descriptions(spark):
    df = spark.createDataFrame(
        [(1, "", "Acme", 65.0, 4, ["Data / Cyber", "Customer Harm"]), (2, 'A "b"', "", 1.0, 1, [])],
        "narrative_id int, summary string, entity string, score double, volume int, taxonomy_labels array<string>",
    )
    got = {r[0]: r[1] for r in X.descriptions(df, seeds.IMPACT).collect()}
    assert got[1] == (
        "Across 4 matched posts, this Acme-linked narrative shows elevated risk centered on Data / Cyber with overlap "
        "into Customer Harm. The common pattern suggests reputation damage, customer trust loss, and remediation cost escalation."
    )
    assert got[2] == "A b"


def test_false_positive_marks(spark):
    marks = spark.createDataFrame(
        [("p1", None, 1), ("p2", "None", 1), ("p3", "Z", 1), ("p3", None, 2), ("p4", "None", 1), ("p4", "Z", 2)],
        "post_id string, entity string, at int",
    )
    got = {r["post_id"]: r["entity"] for r in X.without_false_positives(rows(spark, DATA), marks).collect()}
    assert got == {"p4": "Z"}


def test_matched_posts_keep_raw_times(spark):
    got = {r["post_id"]: r["created"] for r in X.matched_posts(rows(spark, DATA)).collect()}
    assert got["p1"] == "2024-01-01 09:00" and got["p3"] == "not a date"


def test_label_strings(spark):
    df = spark.createDataFrame([("['a', \"b\"]",), ("plain",), (" ",), (None,), ("[broken",)], "taxonomy_labels string")
    assert {r["label"]: r["count"] for r in R.label_counts(df).collect()} == {"a": 1, "b": 1, "plain": 1, "[broken": 1}


def test_missing_and_empty_files(spark, folder):
    assert readers.read_or_empty(spark, f"{folder}/none", readers.FEEDBACK).count() == 0
    os.makedirs(f"{folder}/zero")
    open(f"{folder}/zero/part.json", "w").close()
    assert readers.read_or_empty(spark, f"{folder}/zero", readers.FEEDBACK).count() == 0
    assert readers.load_artifacts(spark, f"{folder}/absent") is None


def test_feedback_is_appended(spark, folder):
    one = spark.createDataFrame([(1, 3)], "narrative_id bigint, rating int")
    for _ in range(2):
        sinks.append_feedback(one, f"{folder}/feedback")
    back = readers.read_or_empty(spark, f"{folder}/feedback", readers.FEEDBACK)
    assert X.feedback_summary(back).first().asDict() == {"narrative_id": 1, "ratings": 2, "mean_rating": 3.0}


def test_whole_build_and_reload(spark, folder):
    made = build(
        V.posts(spark, SF), V.authors(spark, SF), V.entities(spark), V.extra_aliases(spark), V.lexicon(spark),
        Q.TAXONOMY, Q.WEIGHTS, trials=1,
    )
    counts = {r["stage"]: r["rows"] for r in made.counts().collect()}
    assert counts["kept_posts"] + counts["dropped_posts"] == counts["input_posts"]
    assert counts["entity_rows_risk_relevant"] + counts["entity_rows_dropped_no_risk"] == counts["entity_rows_after_resolution"]
    assert all(0 <= r["score"] <= 100 for r in made.narratives.collect())
    save(made, folder)
    back = readers.load_artifacts(spark, folder)
    assert back.count() == made.clustered.count() == counts["entity_rows_risk_relevant"]
    assert "risk_embedding" not in back.columns
    files = readers.artifact_manifest(spark, folder)
    assert files.count() > 0 and readers.artifact_signature(spark, folder).first()["files"] == files.count()


def test_bad_decisions_stop_the_build(spark):
    decisions = spark.createDataFrame([], "id string, is_risk boolean, summary string")
    with pytest.raises(ValueError, match="missing_id"):
        build(
            V.posts(spark, SF), V.authors(spark, SF), V.entities(spark), V.extra_aliases(spark), V.lexicon(spark),
            Q.TAXONOMY, Q.WEIGHTS, decisions=decisions,
        )
