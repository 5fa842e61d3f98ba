"""Narratives: grouped k-means over every entity at once, merging, relabelling, numbering.

A group's rows are never brought together. Points are distinct vectors with a weight; each entity's
points are spread over blocks of bounded size, which are rows with flat arrays. Centers are joined to
the blocks, blocks return partial sums, and the sums are added. Only cluster-level rows (at most ``max_clusters`` per entity)
are ever looked at as a whole. As long as all centers together are few, they travel as a broadcast variable, so that a
round is one job of two stages; beyond that they stay a table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Observation, Window as W, functions as F

from riskloom.functions.numeric import dot, unit
from riskloom.functions.text import blank
from riskloom.operators.risk import TEXT_FEATURES, context_chars, text_vectors
from riskloom.session import broadcast_if_small, cut_lineage, dictionary_join, numbered, pinned

# Cluster counts, restarts and merge thresholds.
MAX_CLUSTERS = 40
SMALL_GROUP = 3
GROWTH = 0.60
TRIALS = 10
SEED = 42
SUPPLIED_THRESHOLD, TEXT_THRESHOLD = 0.95, 0.90
LARGE_CLUSTER, LARGE_MARGIN = 20, 0.03

#: Rounds after which k-means gives up with an error; it stops when no center moves, which takes more rounds the more points there are.
ROUNDS = 5_000
#: Values of a block of points, which is one row; values of all centers that are sent to every task.
BLOCK_VALUES = 250_000
BROADCAST_VALUES = 8_000_000
#: Entities that a filter lists by name.
FEW_ENTITIES = 100
#: Squared distance below which a center counts as unmoved; candidates per cluster for the start.
STILL = 1e-18
CANDIDATES = 10


def cluster_counts(df: DataFrame, max_clusters: int = MAX_CLUSTERS) -> DataFrame:
    """(entity_id, n, k): 1 up to three rows, else n^0.6 within [2, max_clusters]."""
    n = F.col("n")
    k = F.least(F.lit(max_clusters), F.greatest(F.lit(2), F.floor(F.pow(n, GROWTH))), n)
    return df.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "k", F.when(n <= SMALL_GROUP, 1).otherwise(k).cast("int")
    )


def l2_normalize(df: DataFrame, column: str = "risk_embedding") -> DataFrame:
    return df.withColumn(column, unit(column))


def distinct_points(df: DataFrame, counts: DataFrame) -> DataFrame:
    """(entity_id, vec, weight, block): distinct unit vectors, copies folded into a weight."""
    points = (
        l2_normalize(df.select("entity_id", "risk_embedding"))
        .groupBy("entity_id", F.col("risk_embedding").alias("vec"))
        .agg(F.count(F.lit(1)).alias("weight"))
    )
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") * F.size("vec") / BLOCK_VALUES))
    return points.join(counts.filter("k > 1").select("entity_id", "n"), "entity_id").select(
        "entity_id", "vec", "weight", F.pmod(F.xxhash64("vec"), blocks).alias("block")
    )


def _farthest_first(group: pa.Table, trials: int) -> pa.Table:
    """Starts of one entity: trial t begins with its t-th candidate and goes on with the one farthest from those chosen."""
    group = group.sort_by("_r")
    x = _matrix(group["vec"])
    k = min(group["k"][0].as_py(), len(x))
    out = []
    for trial in range(trials):
        chosen = [trial % len(x)]
        away = ((x - x[chosen[0]]) ** 2).sum(axis=1)
        while len(chosen) < k:
            chosen.append(int(away.argmax()))
            away = np.minimum(away, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        out += [(trial, c, at) for c, at in enumerate(chosen)]
    trial, cluster, at = (np.array(v, np.int32) for v in zip(*out))
    return pa.table({
        "entity_id": group["entity_id"].take(at), "trial": trial, "cluster": cluster, "vec": group["vec"].take(at),
    })


def initial_centroids(
    points: DataFrame, counts: DataFrame, seed: int, trials: int, max_clusters: int = MAX_CLUSTERS
) -> DataFrame:
    """k distinct points per entity and trial, mutually far, out of a bounded number of candidates.

    Candidates are the ``CANDIDATES * max_clusters`` points with the least seeded hash. The rank limit is applied before
    rows are exchanged, so a large entity sends that many per task at most.
    """
    order = W.partitionBy("entity_id").orderBy("_h", "vec")
    candidates = (
        points.select("entity_id", "vec", F.xxhash64(F.lit(seed), "vec").alias("_h"))
        .withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= CANDIDATES * max_clusters)
        .join(counts.select("entity_id", "k"), "entity_id")
    )

    def start(group: pa.Table) -> pa.Table:
        return _farthest_first(group, trials)

    return candidates.groupBy("entity_id").applyInArrow(
        start, "entity_id string, trial int, cluster int, vec array<double>"
    )


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1)


def _lists(rows: np.ndarray) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.reshape(-1), pa.float64()))


def _pack(block: pa.Table) -> pa.Table:
    """The points of one block as one row with flat arrays."""
    whole = pa.array([len(block)], pa.int32())
    ends = pa.array([0, len(block)], pa.int32())
    flat = block["vec"].combine_chunks().flatten()
    return pa.table({
        "entity_id": block["entity_id"].combine_chunks().slice(0, 1), "points": whole,
        "values": pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat),
        "weights": pa.ListArray.from_arrays(ends, block["weight"].combine_chunks()),
    })


def packed(points: DataFrame) -> DataFrame:
    """(entity_id, points, values, weights): a row per block of points, so that centers can be joined to blocks."""
    if "values" in points.columns:
        return points
    return points.groupBy("entity_id", "block").applyInArrow(
        _pack, "entity_id string, points int, values array<double>, weights array<bigint>"
    )


def _with_centers(blocks: DataFrame, centers: DataFrame, small: bool) -> DataFrame:
    """Blocks with the centers of their entity as one array, sent to the tasks if their number is small."""
    per_entity = centers.groupBy("entity_id").agg(
        F.array_sort(F.collect_list(F.struct("trial", "cluster", "vec"))).alias("centers")
    )
    return packed(blocks).join(F.broadcast(per_entity) if small else per_entity, "entity_id")


def _assigned(batch: pa.RecordBatch):
    """Per block and trial: the block's row, trial, points, weights, labels, their clusters and squared distances."""
    for i in range(batch.num_rows):
        x = batch["values"][i].values.to_numpy().reshape(batch["points"][i].as_py(), -1)
        w = batch["weights"][i].values.to_numpy().astype(float)
        centers = batch["centers"][i].values
        trials, clusters = centers.field("trial").to_numpy(), centers.field("cluster").to_numpy()
        c = _matrix(centers.field("vec"))
        squares = (x * x).sum(axis=1)
        for trial in np.unique(trials):
            own = trials == trial
            gap = (c[own] ** 2).sum(axis=1) - 2.0 * x @ c[own].T
            best = gap.argmin(axis=1)
            away = np.maximum(gap[np.arange(len(x)), best] + squares, 0.0)
            yield i, int(trial), x, w, best, clusters[own], away


def _partial_sums(batches):
    for batch in batches:
        rows, totals, far = [], [], []
        for i, trial, x, w, best, clusters, away in _assigned(batch):
            for label in np.unique(best):
                own = best == label
                farthest = np.flatnonzero(own)[away[own].argmax()]
                rows.append((i, trial, clusters[label], w[own].sum(), (away[own] * w[own]).sum(), away[farthest]))
                totals.append(w[own] @ x[own])
                far.append(x[farthest])
        if rows:
            i, trial, cluster, n, cost, gap = zip(*rows)
            yield pa.RecordBatch.from_pydict({
                "entity_id": batch["entity_id"].take(pa.array(i)), "trial": pa.array(trial, pa.int32()),
                "cluster": pa.array(cluster, pa.int32()), "total": _lists(np.array(totals)), "n": pa.array(n, pa.float64()),
                "cost": pa.array(cost, pa.float64()), "gap": pa.array(gap, pa.float64()), "point": _lists(np.array(far)),
            })


def _labels(batches):
    for batch in batches:
        for i, _, x, w, best, clusters, _ in _assigned(batch):
            yield pa.RecordBatch.from_pydict({
                "entity_id": batch["entity_id"].take(pa.array([i] * len(x))), "vec": _lists(x),
                "weight": pa.array(w.astype(np.int64)), "cluster": pa.array(clusters[best], pa.int32()),
            })


def labelled_points(blocks: DataFrame, centers: DataFrame) -> DataFrame:
    """(entity_id, vec, weight, cluster): every distinct point with its nearest center."""
    small = (centers.agg(F.sum(F.size("vec"))).first()[0] or 0) <= BROADCAST_VALUES
    return _with_centers(blocks, centers, small).mapInArrow(
        _labels, "entity_id string, vec array<double>, weight bigint, cluster int"
    )


def lloyd_step(points: DataFrame, centers: DataFrame, small: bool = True) -> DataFrame:
    """(entity_id, trial, cluster, vec, n, cost, moved): centers after one round, with the costs under the old ones.

    ``vec`` is the mean of the points nearest to the old center. A center nothing is nearest to stays, except the first
    such one of a trial: it moves to the point farthest from its own center, so that every cluster gets points in the end.
    ``moved`` is the squared move, ``cost`` that of the whole trial.
    """
    sums = _with_centers(points, centers, small).mapInArrow(
        _partial_sums,
        "entity_id string, trial int, cluster int, total array<double>, n double, cost double, gap double, point array<double>",
    )
    key = ["entity_id", "trial", "cluster"]
    added = sums.groupBy(*key).agg(
        vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total"), F.sum("n").alias("n"),
        F.sum("cost").alias("cost"), F.max(F.struct("gap", "point")).alias("far"),
    )
    # a window holds the clusters of one trial, never more than the largest k
    trial = W.partitionBy("entity_id", "trial")
    empty = F.col("n").isNull()
    first_empty = F.row_number().over(trial.orderBy(F.desc(empty), "cluster")) == 1
    far = F.max("far").over(trial)
    joined = centers.select(*key, F.col("vec").alias("_old")).join(added, key, "left")
    seen = joined.withColumns({
        "_fill": empty & first_empty & (far.getField("gap") > STILL), "_far": far.getField("point"),
        "cost": F.sum("cost").over(trial),
    })
    mean = F.transform("total", lambda v: v / F.col("n"))
    new = seen.withColumn("vec", F.when(F.col("_fill"), F.col("_far")).when(empty, F.col("_old")).otherwise(mean))
    gap = F.zip_with("_old", "vec", lambda a, b: a - b)
    return new.select(*key, "vec", F.coalesce("n", F.lit(0.0)).alias("n"), "cost", dot(gap, gap).alias("moved"))


def grouped_kmeans(
    df: DataFrame, counts: DataFrame, seed: int = SEED, trials: int = TRIALS, rounds: int = ROUNDS,
    max_clusters: int = MAX_CLUSTERS,
) -> tuple[DataFrame, DataFrame]:
    """(blocks, centers): the best trial's centers per entity with ``first_cost`` and ``cost``.

    All entities and trials are moved together, each round by one job; a trial whose centers stand still is left out of
    later rounds. At most ``BROADCAST_VALUES`` numbers of centers are sent to the tasks; beyond that the centers stay a table
    and the rounds report the number of open trials through an observation.
    """
    points = pinned(distinct_points(df, counts), "points")
    blocks = pinned(packed(points), "blocks")
    width = F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("d")
    size = points.groupBy("entity_id").agg(width).join(counts, "entity_id").agg(F.sum(F.col("k") * F.col("d"))).first()[0]
    small = (size or 0) * trials <= BROADCAST_VALUES
    start = initial_centroids(points, counts, seed, trials, max_clusters)
    if small:
        return blocks, pinned(_settled(blocks, start, rounds), "chosen")
    unknown = F.lit(None).cast("double")
    state = pinned(
        start.select("*", F.lit(0.0).alias("n"), unknown.alias("cost"), unknown.alias("first_cost"), F.lit(False).alias("settled")),
        "centers",
    )
    for _ in range(rounds):
        state, still_open = _round(blocks, state, small)
        if not still_open:
            break
    else:
        raise RuntimeError(f"centers still move after {rounds} rounds; allow more")
    best = state.groupBy("entity_id").agg(F.min(F.struct("cost", "trial")).alias("_b"))
    chosen = state.drop("settled").join(best.select("entity_id", F.col("_b.trial").alias("trial")), ["entity_id", "trial"])
    return blocks, pinned(chosen, "chosen")


def _step(x: np.ndarray, w: np.ndarray, c: np.ndarray) -> list:
    """Totals, weights, cost, largest squared distance and its point of every trial, for ``c`` (trials, clusters, values)."""
    trials, k, width = c.shape
    flat = c.reshape(-1, width)
    gap = ((flat * flat).sum(axis=1) - 2.0 * x @ flat.T).reshape(len(x), trials, k)
    best = gap.argmin(axis=2)
    away = np.maximum(gap.min(axis=2) + (x * x).sum(axis=1)[:, None], 0.0)
    member = np.zeros((len(x), trials * k))
    member[np.arange(len(x))[:, None], best + np.arange(trials) * k] = w[:, None]
    far = away.max(axis=0)
    points = [max(map(tuple, x[np.flatnonzero(away[:, t] == far[t])])) for t in range(trials)]
    return [(member.T @ x).reshape(c.shape), member.sum(axis=0).reshape(trials, k), w @ away, far, np.array(points)]


def _added(a: list, b: list) -> list:
    """What ``_step`` says of two blocks together; of equally far points the greater one is kept."""
    later = [(bg, tuple(bp)) > (ag, tuple(ap)) for ag, ap, bg, bp in zip(a[3], a[4], b[3], b[4])]
    return [*(p + q for p, q in zip(a[:3], b[:3])), np.where(later, b[3], a[3]), np.where(np.array(later)[:, None], b[4], a[4])]


PARTIAL = "entity_id string, trial int, total array<double>, n array<double>, cost double, gap double, point array<double>"
MOVED = "entity_id string, trial int, vec array<double>, n array<double>, cost double, moved double"
MOVED_COLUMNS = ["entity_id", "trial", "vec", "n", "cost", "moved"]


def _moved(blocks: DataFrame, centers: dict) -> pa.Table:
    """One round of all open trials, ``centers`` being {entity: (trials, array of (trials, clusters, values))}.

    Tasks add up their blocks, the sums of a trial meet in one group, which moves its centers by the rule of ``lloyd_step``.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(centers)

    def partial(batches):
        held = {}
        for batch in batches:
            for i, entity in enumerate(batch["entity_id"].to_pylist()):
                if entity in shared.value:
                    x = batch["values"][i].values.to_numpy().reshape(batch["points"][i].as_py(), -1)
                    w = batch["weights"][i].values.to_numpy().astype(float)
                    found = _step(x, w, shared.value[entity][1])
                    held[entity] = _added(held[entity], found) if entity in held else found
        for entity, (total, n, cost, gap, point) in held.items():
            yield pa.RecordBatch.from_pydict({
                "entity_id": pa.array([entity] * len(n), pa.string()), "trial": pa.array(shared.value[entity][0], pa.int32()),
                "total": _lists(total.reshape(len(n), -1)), "n": _lists(n), "cost": pa.array(cost), "gap": pa.array(gap), "point": _lists(point),
            })

    def move(group: pa.Table) -> pa.Table:
        group = group.sort_by("cost")  # sums do not depend on the order of arrival
        trials, c = shared.value[group["entity_id"][0].as_py()]
        old = c[trials.index(group["trial"][0].as_py())]
        total, n = _matrix(group["total"]).sum(axis=0).reshape(old.shape), _matrix(group["n"]).sum(axis=0)
        new = np.where(n[:, None] > 0, total / np.maximum(n, 1.0)[:, None], old)
        gap, point = max(zip(group["gap"].to_pylist(), group["point"].to_pylist()))
        if (n == 0).any() and gap > STILL:
            new[(n == 0).argmax()] = point
        return pa.table({
            "entity_id": group["entity_id"].slice(0, 1), "trial": group["trial"].slice(0, 1), "vec": _lists(new.reshape(1, -1)),
            "n": _lists(n.reshape(1, -1)), "cost": pa.array([sum(group["cost"].to_pylist())], pa.float64()),
            "moved": pa.array([((new - old) ** 2).sum(axis=1).max()], pa.float64()),
        })

    if len(centers) <= FEW_ENTITIES:  # blocks of settled entities stay out of the workers
        blocks = blocks.filter(F.col("entity_id").isin(list(centers)))
    try:
        return blocks.mapInArrow(partial, PARTIAL).groupBy("entity_id", "trial").applyInArrow(move, MOVED).toArrow()
    finally:
        shared.destroy()


def _settled(blocks: DataFrame, start: DataFrame, rounds: int) -> DataFrame:
    """(entity_id, trial, cluster, vec, n, cost, first_cost) of the best trial of every entity, after rounds by ``_moved``.

    The driver only hands centers on, at most ``BROADCAST_VALUES`` numbers.
    """
    starts: dict = {}
    for row in start.toArrow().sort_by([("entity_id", "ascending"), ("trial", "ascending"), ("cluster", "ascending")]).to_pylist():
        starts.setdefault(row["entity_id"], {}).setdefault(row["trial"], []).append(row["vec"])
    open_trials = {entity: {t: np.array(c) for t, c in found.items()} for entity, found in starts.items()}
    first, best = {}, {}
    for _ in range(rounds):
        if not open_trials:
            break
        moved = _moved(blocks, {e: (list(found), np.stack(list(found.values()))) for e, found in open_trials.items()})
        for entity, trial, vec, n, cost, gap in zip(*(moved[c] for c in MOVED_COLUMNS)):
            entity, trial, cost = entity.as_py(), trial.as_py(), cost.as_py()
            n = n.values.to_numpy()
            c = vec.values.to_numpy().reshape(len(n), -1)
            open_trials[entity][trial] = c
            first.setdefault((entity, trial), cost)
            if gap.as_py() < STILL:
                del open_trials[entity][trial]
                found = (cost, trial, c, n)
                best[entity] = min(best.get(entity, found), found, key=lambda b: b[:2])
        open_trials = {entity: found for entity, found in open_trials.items() if found}
    if open_trials:
        raise RuntimeError(f"centers still move after {rounds} rounds; allow more")
    rows = [
        (entity, trial, i, c[i].tolist(), float(n[i]), cost, first[entity, trial])
        for entity, (cost, trial, c, n) in best.items() for i in range(len(n))
    ]
    kinds = {
        "entity_id": pa.string(), "trial": pa.int32(), "cluster": pa.int32(), "vec": pa.list_(pa.float64()),
        "n": pa.float64(), "cost": pa.float64(), "first_cost": pa.float64(),
    }
    columns = list(zip(*rows)) or [[]] * len(kinds)
    return blocks.sparkSession.createDataFrame(
        pa.table({name: pa.array(values, kind) for (name, kind), values in zip(kinds.items(), columns)}, schema=pa.schema(kinds))
    )


def _round(blocks: DataFrame, state: DataFrame, small: bool) -> tuple[DataFrame, int]:
    """The state after one round of the open trials, and how many of their centers are not settled."""
    open_trials = state.filter("not settled")
    costs = open_trials.select("entity_id", "trial", "cluster", "first_cost")
    trial = W.partitionBy("entity_id", "trial")
    moved = (
        lloyd_step(blocks, open_trials, small).join(costs, ["entity_id", "trial", "cluster"])
        .withColumns({"first_cost": F.coalesce("first_cost", "cost"), "settled": F.max("moved").over(trial) < STILL})
        .drop("moved")
    )
    report = Observation()
    observed = moved.observe(report, F.count(F.when(~F.col("settled"), 1)).alias("open"))
    after = pinned(state.filter("settled").unionByName(observed), "centers")
    return after, report.get["open"]


def centroids(labelled: DataFrame) -> DataFrame:
    """(entity_id, cluster, total, n, vec): size and unit centroid of every cluster."""
    return (
        labelled.groupBy("entity_id", "cluster")
        .agg(
            vector_to_array(
                Summarizer.sum(array_to_vector(F.transform("vec", lambda v: v * F.col("weight"))))
            ).alias("total"),
            F.sum("weight").cast("double").alias("n"),
        )
        .withColumn("vec", unit("total"))
    )


def nearest_clusters(clusters: DataFrame) -> DataFrame:
    """(entity_id, cluster, nearest, similarity): most similar other cluster, ties to the lowest label.

    An entity has at most ``max_clusters`` clusters, so the pairs of an entity are few.
    """
    other = clusters.select("entity_id", F.col("cluster").alias("nearest"), F.col("vec").alias("_other"))
    pairs = clusters.select("entity_id", "cluster", "vec").join(other, "entity_id").filter("cluster <> nearest")
    compared = pairs.select("entity_id", "cluster", "nearest", dot("vec", "_other").alias("similarity"))
    order = W.partitionBy("entity_id", "cluster").orderBy(F.desc("similarity"), "nearest")
    return compared.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def merge_pairs(clusters: DataFrame, threshold: float) -> DataFrame:
    """(entity_id, cluster, target): clusters that one merging round moves, and the lower label they go to.

    Two clusters merge if each is the other's nearest and they are similar enough; two large ones need a margin.
    """
    near = nearest_clusters(clusters).join(clusters.select("entity_id", "cluster", "n"), ["entity_id", "cluster"])
    other = near.select(
        "entity_id", F.col("cluster").alias("nearest"), F.col("nearest").alias("back"), F.col("n").alias("other_n")
    )
    both_large = (F.col("n") >= LARGE_CLUSTER) & (F.col("other_n") >= LARGE_CLUSTER)
    needed = F.when(both_large, threshold + LARGE_MARGIN).otherwise(threshold)
    return (
        near.join(other, ["entity_id", "nearest"])
        .filter((F.col("back") == F.col("cluster")) & (F.col("cluster") < F.col("nearest")))
        .filter(F.col("similarity") >= needed)
        .select("entity_id", F.col("nearest").alias("cluster"), F.col("cluster").alias("target"))
    )


def merge_round(state: DataFrame, threshold: float) -> DataFrame:
    """``state`` (entity_id, cluster, total, n, vec, members) after one round; ``target`` tells who moved into a cluster.

    Sums and sizes add up, so the points are not read again.
    """
    moved = state.join(merge_pairs(state, threshold), ["entity_id", "cluster"], "left")
    return (
        moved.groupBy("entity_id", F.coalesce("target", "cluster").alias("cluster"))
        .agg(
            vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total"), F.sum("n").alias("n"),
            F.flatten(F.collect_list("members")).alias("members"), F.count("target").alias("merged"),
        )
        .withColumn("vec", unit("total"))
    )


def merge_clusters(clusters: DataFrame, threshold: float) -> DataFrame:
    """(entity_id, cluster, kept): where every cluster ends up after merging to a fixpoint.

    In each round the clusters that are each other's nearest and similar enough become one, under
    the lower label. Sums and sizes add up, so the points are not read again.
    """
    state = pinned(clusters.select("entity_id", "cluster", "total", "n", "vec", F.array("cluster").alias("members")), "clusters")
    merged = None
    while merged != 0:  # every round with a pair removes a cluster, so this ends
        report = Observation()
        observed = merge_round(state, threshold).observe(report, F.coalesce(F.sum("merged"), F.lit(0)).alias("merged"))
        state = pinned(observed.drop("merged"), "clusters")
        merged = report.get["merged"]
    return state.select(
        "entity_id", F.explode("members").alias("member"), F.col("cluster").alias("kept")
    ).withColumnRenamed("member", "cluster")


def relabel(merged: DataFrame) -> DataFrame:
    """Adds ``local_id``: kept labels renumbered from 0 within the entity."""
    order = W.partitionBy("entity_id").orderBy("kept")
    return merged.withColumn("local_id", F.dense_rank().over(order) - 1)


def global_ids(rows: DataFrame) -> DataFrame:
    """Adds ``narrative_id``: from 1, entities in order of their lowest post id, then local id.

    ``rows`` are read twice, so they should be pinned.
    """
    groups = cut_lineage(rows.groupBy("entity_id", "local_id").agg(F.min("post_id").alias("_first")))
    # a window holds one entity's clusters, never more than the largest k
    first = F.min("_first").over(W.partitionBy("entity_id"))
    order = ["_entity_first", "entity_id", "local_id"]
    ids = numbered(groups.withColumn("_entity_first", first), order, "narrative_id").select(
        F.col("entity_id").alias("_eid"), F.col("local_id").alias("_lid"),
        F.col("narrative_id").cast("bigint").alias("narrative_id"),
    )
    same = (F.col("entity_id") == F.col("_eid")) & (F.col("local_id") == F.col("_lid"))
    return rows.join(broadcast_if_small(ids), same).drop("_eid", "_lid", "local_id")


def single_narratives(rows: DataFrame) -> DataFrame:
    """One narrative per entity: the small-group path, and the base of the exact checks."""
    return global_ids(rows.withColumn("local_id", F.lit(0)))


def vector_mode(rows: DataFrame) -> DataFrame:
    """(entity_id, supplied): whether every row of the entity carries a non-empty vector."""
    present = F.coalesce(F.size("risk_embedding") > 0, F.lit(False))
    return rows.groupBy("entity_id").agg(F.bool_and(present).alias("supplied"))


def cluster_vectors(
    rows: DataFrame, threshold: float, max_clusters: int = MAX_CLUSTERS, trials: int = TRIALS
) -> DataFrame:
    """Adds ``local_id`` to rows that carry vectors."""
    counts = cut_lineage(cluster_counts(rows, max_clusters))
    blocks, centers = grouped_kmeans(rows, counts, trials=trials, max_clusters=max_clusters)
    labelled = pinned(labelled_points(blocks, centers), "labelled")
    final = relabel(merge_clusters(centroids(labelled), threshold))
    point = F.struct("entity_id", "_vec")
    by_point = labelled.join(final, ["entity_id", "cluster"]).withColumnRenamed("vec", "_vec").select(point.alias("_point"), "local_id")
    keyed = rows.withColumn("_vec", unit("risk_embedding"))
    keyed = keyed.withColumn("_point", F.when(F.col("_vec").isNotNull(), point)).drop("_vec")
    return dictionary_join(keyed, by_point, "_point", "local_id").drop("_point").withColumn("local_id", F.coalesce("local_id", F.lit(0)))


def cluster(
    rows: DataFrame, max_clusters: int = MAX_CLUSTERS, trials: int = TRIALS
) -> DataFrame:
    """Rows with ``cluster_context`` and ``narrative_id``; narratives never cross entities.

    Entities whose rows all carry a vector use it; the others are clustered on their contexts.
    """
    if "entity_id" not in rows.columns:
        rows = rows.withColumn("entity_id", F.col("entity") if "entity" in rows.columns else F.lit(""))
    rows = rows.withColumn("entity_id", F.coalesce("entity_id", F.lit("")))
    if "risk_embedding" not in rows.columns:
        rows = cut_lineage(rows.withColumn("supplied", F.lit(False)))
    else:
        rows = cut_lineage(rows)
        rows = rows.join(broadcast_if_small(vector_mode(rows)), "entity_id")
    summary = F.col("risk_summary") if "risk_summary" in rows.columns else F.lit("")
    supplied = rows.filter("supplied").withColumn("cluster_context", summary)
    parts = []
    if not supplied.isEmpty():
        parts.append(cluster_vectors(supplied, SUPPLIED_THRESHOLD, max_clusters, trials))
    plain = rows.filter("not supplied").drop("risk_embedding")
    if not plain.isEmpty():
        parts.append(_cluster_contexts(plain, max_clusters, trials))
    if not parts:
        return rows.drop("supplied").withColumns(
            {"cluster_context": F.lit(""), "narrative_id": F.lit(0).cast("bigint")}
        )
    labelled = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return global_ids(cut_lineage(labelled.drop("supplied")))


def _cluster_contexts(rows: DataFrame, max_clusters: int, trials: int) -> DataFrame:
    """Text mode: contexts around the mention become vectors of the default producer."""
    rows = cut_lineage(context_chars(rows))
    readable = rows.filter(~blank("cluster_context"))
    if readable.isEmpty():
        return rows.withColumn("local_id", F.lit(0))
    zero = F.array_repeat(F.lit(0.0), TEXT_FEATURES)
    vectors = dictionary_join(rows, text_vectors(readable, "cluster_context"), "cluster_context", "risk_embedding").withColumn(
        "risk_embedding", F.coalesce("risk_embedding", zero)
    )
    return cluster_vectors(cut_lineage(vectors), TEXT_THRESHOLD, max_clusters, trials).drop(
        "risk_embedding"
    )
