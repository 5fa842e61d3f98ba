from __future__ import annotations

import contextlib
import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from riskloom import session as X
from riskloom.operators import report, scoring, selection


@contextlib.contextmanager
def conf(spark, **values):
    """Settings of a block; dots are written as double underscores."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


PLAIN = {"spark__sql__autoBroadcastJoinThreshold": "-1", "spark__sql__adaptive__enabled": "false"}


def numbers(spark, values):
    return spark.createDataFrame([(v,) for v in values], "c double")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=1, max_size=30))
def test_median_equals_statistics(spark, values):
    middle = statistics.median_low(values) / 2 + statistics.median_high(values) / 2 if len(values) % 2 == 0 else statistics.median(values)
    assert selection.median(numbers(spark, values), F.col("c")) == middle


def test_median_of_many_values_and_of_none(spark):
    values = [random.Random(3).gauss(0, 1) ** 9 for _ in range(20_001)] + [0.25] * 9_000
    assert selection.median(numbers(spark, values), F.col("c")) == statistics.median(values)
    assert selection.median(numbers(spark, [None, float("nan")]), F.col("c")) is None
    assert selection.median(numbers(spark, [None, float("nan"), 2.0]), F.col("c")) == 2.0


def test_refinement_narrows_by_bins(spark):
    counts, bounds = selection.value_counts(numbers(spark, [float(x) for x in range(5_000)]), F.col("c"))
    assert bounds == {"low": 0.0, "high": 4999.0, "total": 5000}
    assert selection.ranked_values(counts, bounds, [0, 1, 2500, 4999]) == [0.0, 1.0, 2500.0, 4999.0]


def test_confidence_bins_without_and_with_a_range(spark):
    rows = spark.createDataFrame([("0.5",), ("0.5",), ("x",), (None,)], "resolution_confidence string")
    assert [tuple(r) for r in report.confidence_bins(rows).collect()] == [(0, 2)]
    assert report.confidence_bins(rows.filter("false")).count() == 0
    more = rows.union(spark.createDataFrame([("1.0",), ("0.52",)], "c string"))
    assert sorted(tuple(r) for r in report.confidence_bins(more).collect()) == [(0, 2), (1, 1), (24, 1)]


def skewed_posts(spark, rows=20_000):
    """90 % of the rows without an author; most of the rest by one; ids with blanks around them."""
    author = F.when(F.col("id") % 10 > 0, None).when(F.col("id") % 50 > 0, " busy ").otherwise(F.concat(F.lit("a"), F.col("id")))
    return spark.range(rows).repartition(4).select("id", author.alias("author_id"))


def authors(spark):
    return spark.createDataFrame([("busy", 7.0), ("a0", 3.0), ("a50", 4.0)], "author_id string, followers double")


def test_author_lookup_spreads_absent_and_heavy_authors(spark):
    rows = skewed_posts(spark)
    with conf(spark, **PLAIN):
        got = scoring.with_followers(rows, authors(spark)).withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == 20_000
    tasks = [r["task"] for r in got]
    largest, tasks_used = max(map(tasks.count, set(tasks))), int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert largest < 2 * len(got) / tasks_used
    for r in got:
        assert r["_followers"] == {" busy ": 7.0, "a0": 3.0, "a50": 4.0}.get(r["author_id"], 0.0)


def test_author_lookup_ways_agree(spark):
    rows = skewed_posts(spark, 2_000)
    ways = [sorted((r["id"], r["_followers"]) for r in scoring.with_followers(rows, authors(spark), heavy).collect()) for heavy in (True, False)]
    assert ways[0] == ways[1] and len(ways[0]) == 2_000
    assert scoring.with_followers(rows.filter("false"), authors(spark)).count() == 0


def test_dictionary_join_by_digest(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a"), (5, "")], "id int, t string")
    table = spark.createDataFrame([("a", 1.0), ("", 2.0), (None, 9.0)], "t string, v double")
    with conf(spark, **PLAIN):
        joined = X.dictionary_join(rows, table, "t", "v")
        assert sorted(tuple(r) for r in joined.collect()) == [(1, "a", 1.0), (2, "b", None), (3, None, None), (4, "a", 1.0), (5, "", 2.0)]
        plan = joined._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and all("hashpartitioning(_d_1" in line for line in dealt)


def test_dictionary_join_of_arrays(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0]), (2, [-0.0, 1.0]), (3, [2.0]), (4, None)], "id int, t array<double>")
    table = spark.createDataFrame([([0.0, 1.0], "x"), ([2.0], "y")], "t array<double>, v string")
    assert {r["id"]: r["v"] for r in X.dictionary_join(rows, table, "t", "v").collect()} == {1: "x", 2: "x", 3: "y", 4: None}


def test_a_shared_digest_is_never_taken_for_equality(spark, monkeypatch):
    monkeypatch.setattr(X, "digest_columns", lambda column, name: {f"{name}_1": F.length(column), f"{name}_2": F.lit(0)})
    rows = spark.createDataFrame([("a",)], "t string")
    table = spark.createDataFrame([("b", 1.0)], "t string, v double")
    with pytest.raises(PySparkException, match="share a digest"):
        X.dictionary_join(rows, table, "t", "v").collect()


def test_local_numbers_are_gapless_without_an_exchange(spark):
    rows = spark.range(1000).repartition(7).filter("id % 3 > 0")
    got = X.numbered_locally(rows, "numbers")
    assert sorted(r["position"] for r in got.collect()) == list(range(got.count()))
    assert "rangepartitioning" not in got._jdf.queryExecution().executedPlan().toString()
