from __future__ import annotations

import numpy as np
import pytest

from riskloom.operators import clustering as C


def vectors(spark, groups: dict[str, list]):
    rows = [(f"{e}{i:04d}", e, [float(x) for x in v]) for e, vs in groups.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "post_id string, entity_id string, risk_embedding array<double>")


@pytest.mark.parametrize("n,k", [(1, 1), (3, 1), (4, 2), (10, 3), (100, 15), (468, 40), (1000, 40)])
def test_cluster_counts(spark, n, k):
    df = spark.range(n).selectExpr("'e' AS entity_id")
    assert C.cluster_counts(df).first()["k"] == k


def test_unit_vectors(spark):
    df = vectors(spark, {"a": [[3, 4], [0, 0]]})
    assert [r["risk_embedding"] for r in C.l2_normalize(df).orderBy("post_id").collect()] == [[0.6, 0.8], [0.0, 0.0]]


def blobs(seed, n):
    rng = np.random.default_rng(seed)
    centers = np.eye(4)[:3]
    return [centers[i % 3] + rng.normal(0, 0.02, 4) for i in range(n)]


def test_separate_blobs_become_narratives(spark):
    groups = {"a": blobs(1, 30), "b": blobs(2, 30), "c": [[1, 0, 0, 0]] * 3}
    df = vectors(spark, groups).selectExpr("*", "'t' AS text", "'s' AS risk_summary")
    out = C.cluster(df).collect()
    assert len(out) == 63
    by_narrative: dict[int, set] = {}
    for r in out:
        by_narrative.setdefault(r["narrative_id"], set()).add((r["entity_id"], int(r["post_id"][1:]) % 3 if r["entity_id"] != "c" else 0))
    # merging joins what over-clustering split, and no narrative mixes blobs or entities
    assert all(len(members) == 1 for members in by_narrative.values())
    assert sorted(by_narrative) == list(range(1, 8))
    assert {r["cluster_context"] for r in out} == {"s"}


def test_kmeans_matches_numpy_lloyd(spark):
    """The distributed rounds give the centers of plain Lloyd iterations from the same start."""
    data = blobs(3, 60)
    df = vectors(spark, {"a": data})
    counts = C.cluster_counts(df)
    points = C.cut_lineage(C.distinct_points(df, counts))
    start = C.cut_lineage(C.initial_centroids(points, counts, 42, 1))
    step = C.cut_lineage(C.lloyd_step(points, start))
    x = np.array([np.array(v) / np.linalg.norm(v) for v in data])
    first = {r["cluster"]: np.array(r["vec"]) for r in start.collect()}
    labels = np.array([min(first, key=lambda c: ((p - first[c]) ** 2).sum()) for p in x])
    for r in step.collect():
        assert np.allclose(r["vec"], x[labels == r["cluster"]].mean(axis=0))
        assert r["n"] == (labels == r["cluster"]).sum()


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    df = vectors(spark, {"a": blobs(4, 60)})
    counts = C.cluster_counts(df)

    def cost():
        return C.grouped_kmeans(df, counts, trials=2)[1].first()["cost"]

    whole = cost()
    monkeypatch.setattr(C, "BROADCAST_VALUES", 0)
    assert cost() == pytest.approx(whole)
    monkeypatch.setattr(C, "BLOCK_VALUES", 20)
    assert cost() == pytest.approx(whole)


def test_rounds_of_few_centers_write_no_tables_and_agree_with_those_that_do(spark, monkeypatch):
    rng = np.random.default_rng(11)
    groups = {"a": blobs(6, 50), "near": (np.eye(4)[0] + rng.normal(0, 1e-4, (60, 4))).tolist(), "tiny": [[1, 0, 0, 0]] * 2}
    df = vectors(spark, groups)
    counts = C.cluster_counts(df)
    written, plain = [], C.pinned
    monkeypatch.setattr(C, "pinned", lambda rows, name: (written.append(name), plain(rows, name))[1])

    def centers():
        rows = C.grouped_kmeans(df, counts, trials=3)[1].orderBy("entity_id", "trial", "cluster").collect()
        keys = [(r["entity_id"], r["trial"], r["cluster"], r["n"]) for r in rows]
        return keys, np.array([[*r["vec"], r["cost"], r["first_cost"]] for r in rows])

    few = centers()
    assert "centers" not in written
    monkeypatch.setattr(C, "BROADCAST_VALUES", 0)
    many = centers()
    assert "centers" in written
    assert few[0] == many[0] and np.allclose(few[1], many[1])


def test_empty_clusters_are_refilled_with_the_farthest_point(spark):
    data = [[float(np.cos(a)), float(np.sin(a))] for a in (0.0, 0.01, 0.02, 0.03, 0.04, 1.5)]
    df = vectors(spark, {"a": data})
    points = C.distinct_points(df, C.cluster_counts(df))
    far_off = [-1.0, 0.0]  # nothing is nearest to the last two
    start = spark.createDataFrame(
        [("a", 0, 0, data[0]), ("a", 0, 1, data[1]), ("a", 0, 2, far_off), ("a", 0, 3, far_off)],
        "entity_id string, trial int, cluster int, vec array<double>",
    )
    once = {r["cluster"]: r for r in C.lloyd_step(points, start).collect()}
    assert np.allclose(once[2]["vec"], data[5]) and once[2]["n"] == 0 and once[2]["moved"] > 1
    assert np.allclose(once[3]["vec"], far_off) and once[3]["moved"] == 0  # one a round
    assert once[0]["n"] + once[1]["n"] == 6


def test_as_many_clusters_as_asked_for(spark):
    rng = np.random.default_rng(7)
    groups = {"near": (np.eye(3)[0] + rng.normal(0, 1e-4, (90, 3))).tolist(), "few": [[1, 0, 0], [0, 1, 0]] * 40, "wide": rng.normal(size=(70, 3)).tolist()}
    df = vectors(spark, groups)
    counts = C.cluster_counts(df)
    _, centers = C.grouped_kmeans(df, counts, trials=2)
    found = {r["entity_id"]: r["count"] for r in centers.filter("n > 0").groupBy("entity_id").count().collect()}
    assert found == {"near": 14, "few": 2, "wide": 12}


def test_starts_are_mutually_far(spark):
    df = vectors(spark, {"a": blobs(5, 60)})
    counts = C.cluster_counts(df, 3)
    start = C.initial_centroids(C.distinct_points(df, counts), counts, 42, 2, 3).collect()
    assert len(start) == 6
    for trial in (0, 1):
        assert {int(np.argmax(r["vec"])) for r in start if r["trial"] == trial} == {0, 1, 2}


def test_a_merging_round_only_moves_mutual_pairs(spark):
    rows = clusters(spark, [("a", 0, 0, 5), ("a", 1, 5, 5), ("a", 2, 9, 5), ("b", 0, 0, 5), ("b", 1, 1, 5), ("c", 4, 0, 1)])
    pairs = sorted((r["entity_id"], r["cluster"], r["target"]) for r in C.merge_pairs(rows, 0.95).collect())
    assert pairs == [("a", 2, 1), ("b", 1, 0)]


def test_copies_are_folded_into_weights(spark):
    df = vectors(spark, {"a": [[1, 0]] * 9 + [[0, 1]]})
    points = C.distinct_points(df, C.cluster_counts(df)).collect()
    assert sorted(p["weight"] for p in points) == [1, 9]


def clusters(spark, rows):
    """(entity, cluster, angle in degrees, size)"""
    data = [
        (e, c, [float(np.cos(np.radians(d)) * n), float(np.sin(np.radians(d)) * n)], float(n)) for e, c, d, n in rows
    ]
    df = spark.createDataFrame(data, "entity_id string, cluster int, total array<double>, n double")
    return df.withColumn("vec", C.unit("total"))


def merged(spark, rows, threshold=0.95):
    return {(r["entity_id"], r["cluster"]): r["kept"] for r in C.merge_clusters(clusters(spark, rows), threshold).collect()}


def test_mutual_nearest_pairs_merge_and_entities_stay_apart(spark):
    got = merged(spark, [("a", 0, 0, 5), ("a", 1, 5, 5), ("a", 2, 90, 5), ("b", 0, 0, 5)])
    assert got == {("a", 0): 0, ("a", 1): 0, ("a", 2): 2, ("b", 0): 0}


def test_large_pairs_need_a_margin(spark):
    # cos 15 degrees = 0.966: enough at 0.95, not at 0.98
    assert merged(spark, [("a", 0, 0, 20), ("a", 1, 15, 20)]) == {("a", 0): 0, ("a", 1): 1}
    assert merged(spark, [("a", 0, 0, 19), ("a", 1, 15, 20)]) == {("a", 0): 0, ("a", 1): 0}
    assert merged(spark, [("a", 0, 0, 20), ("a", 1, 10, 20)]) == {("a", 0): 0, ("a", 1): 0}


def test_merging_repeats_until_nothing_changes(spark):
    got = merged(spark, [("a", 3, 0, 1), ("a", 5, 2, 1), ("a", 7, 12, 1), ("a", 9, 14, 1)])
    assert got == {("a", 3): 3, ("a", 5): 3, ("a", 7): 3, ("a", 9): 3}


def test_nearest_ties_go_to_the_lowest_label(spark):
    near = {r["cluster"]: r["nearest"] for r in C.nearest_clusters(clusters(spark, [("a", 0, 0, 1), ("a", 1, 90, 1), ("a", 2, -90, 1)])).collect()}
    assert near[0] == 1


def test_text_mode_and_blank_texts(spark):
    rows = [(f"{i:03d}", "e", f"topic {i % 2} word{i % 2} again{i % 2}", f"topic {i % 2}") for i in range(12)]
    rows += [(f"9{i}", "blank", " ", "") for i in range(5)]
    df = spark.createDataFrame(rows, "post_id string, entity_id string, text string, mention_text string")
    out = C.cluster(df, trials=2).collect()
    parts = {r["narrative_id"] for r in out if r["entity_id"] == "e"}
    assert len(parts) == 2 and len({r["narrative_id"] for r in out if r["entity_id"] == "blank"}) == 1
    assert not parts & {r["narrative_id"] for r in out if r["entity_id"] == "blank"}


def test_empty_input(spark):
    df = spark.createDataFrame([], "post_id string, entity_id string, text string")
    out = C.cluster(df)
    assert out.count() == 0 and {"narrative_id", "cluster_context"} <= set(out.columns)
