"""Whitening of vectors from a weighted covariance: each distinct vector counts once, with its multiplicity as weight.

Rows become integer vectors and equal ones are grouped. Exact weighted sums give the mean; the covariance is a weighted
product of the centred distinct vectors, added up from one small matrix per task. Its leading eigenvectors whiten each
distinct vector once, and the results are joined back to the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from riskloom.llm.common import pin
from riskloom.llm.vectors import finite, lengths, lists, matrix

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8


def integer_rows(df: DataFrame) -> DataFrame:
    """(vec_id, x): the vectors that take part, as long integers."""
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("bigint") + SHIFT)
    return df.filter(finite("embedding") & (F.size("embedding") > 0)).select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x"))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(x, weight), pinned: distinct vectors and the number of rows that hold them, counted before they are exchanged."""
    return pin(rows.groupBy("x").agg(F.count(F.lit(1)).alias("weight")), "distinct")


def exact_sums(points: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of rows and the sum of each dimension."""
    def add(batches):
        total, n = [0] * size, 0
        for batch in batches:
            x, w = matrix(batch["x"]), batch["weight"].to_numpy()
            # halves of the integers, so that no product of a batch overflows
            high, low = w @ (x >> 20), w @ (x & 0xFFFFF)
            total = [t + (int(h) << 20) + int(l) for t, h, l in zip(total, high, low)]
            n += int(w.sum())
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(size)], pa.int32()), pa.array([n, *total], pa.int64())], ["axis", "total"])

    sums = points.mapInArrow(add, "axis int, total bigint").groupBy("axis").agg(F.sum("total").alias("total"))
    found = dict(sums.collect())
    return found[-1], [found[i] for i in range(size)]


def weighted_covariance(points: DataFrame, column: str, mean: np.ndarray, n: int) -> np.ndarray:
    """Covariance of ``column`` over all rows, divisor ``n``; vectors are centred before they are multiplied.

    A task adds up one matrix; its rows are added to those of other tasks in Spark.
    """
    sent = points.sparkSession.sparkContext.broadcast(mean)

    def multiply(batches):
        mean = sent.value
        total = np.zeros((len(mean), len(mean)))
        for batch in batches:
            if batch.num_rows:
                away = matrix(batch[column]).astype(np.float64) - mean
                total += (away * batch["weight"].to_numpy()[:, None]).T @ away
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(mean)), pa.int32()), lists(total, pa.float64())], ["axis", "products"])

    parts = points.mapInArrow(multiply, "axis int, products array<double>")
    added = parts.groupBy("axis").agg(vector_to_array(Summarizer.sum(array_to_vector("products"))).alias("products"))
    rows = dict(added.collect())
    return np.array([rows[i] for i in range(len(mean))]) / n


def principal(covariance: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues, falling, and their unit eigenvectors as columns; the largest entry of each is positive."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * signs


def exact_deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S) squared, in integers; None where it does not fit 64 bits."""
    centre = np.array([s // n for s in sums], np.int64)
    rest = np.array([s - n * (s // n) for s in sums], np.int64)  # n * x - S = n * (x - centre) - rest
    away = x - centre
    if (int(np.abs(away).max(initial=0)) + 1) ** 2 * n**2 * x.shape[1] < 1 << 63:
        return ((n * away - rest) ** 2).sum(axis=1).tolist()
    exact = [sum((n * a - r) ** 2 for a, r in zip(row, rest.tolist())) for row in away.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def _whitened(points: DataFrame, n: int, sums: list[int], mean: np.ndarray, scaled: np.ndarray) -> DataFrame:
    """(x, weight, deviation, whitened), pinned: each distinct vector once."""
    sent = points.sparkSession.sparkContext.broadcast((mean, scaled))

    def project(batches):
        mean, scaled = sent.value
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch["x"])
                yield pa.RecordBatch.from_arrays(
                    [batch["x"], batch["weight"], pa.array(exact_deviation(x, n, sums), pa.int64()),
                     lists((x.astype(np.float64) - mean) @ scaled, pa.float64())],
                    ["x", "weight", "deviation", "whitened"],
                )

    return pin(points.mapInArrow(project, "x array<bigint>, weight bigint, deviation bigint, whitened array<double>"), "whitened")


def whiten(rows: DataFrame, size: int, components: int = COMPONENTS) -> DataFrame:
    """The result rows of pinned ``rows`` (vec_id, x) whose vectors have length ``size``."""
    points = distinct_vectors(rows)
    n, sums = exact_sums(points, size)
    mean = np.array([s / n for s in sums])
    covariance = weighted_covariance(points, "x", mean, n)
    values, vectors = principal(covariance, components)
    trace = float(np.trace(covariance))
    flat = values <= trace * size * np.finfo(float).eps  # no variance beyond rounding: nothing to scale
    scaled = vectors / np.sqrt(np.where(flat, 1.0, values))
    done = _whitened(points, n, sums, mean, scaled)
    steep = np.flatnonzero(~flat)
    error = None
    if len(steep):
        middle = done.select("weight", F.inline(F.arrays_zip(F.sequence(F.lit(0), F.lit(len(values) - 1)).alias("axis"), F.col("whitened").alias("v"))))
        means = dict(middle.groupBy("axis").agg(F.sum(F.col("v") * F.col("weight")) / n).collect())
        spread = weighted_covariance(done, "whitened", np.array([means[i] for i in range(len(values))]), n)
        error = float(np.abs(spread[np.ix_(steep, steep)] - np.eye(len(steep))).max())
    facts = F.array(*[
        F.struct(
            F.lit(i + 1).alias("component"), (F.lit(None).cast("double") if flat[i] else F.get("whitened", F.lit(i))).alias("whitened"),
            F.lit(0.0 if flat[i] else float(values[i] / trace)).alias("explained"),
        )
        for i in range(len(values))
    ])
    joined = rows.join(done.select("x", "deviation", "whitened"), "x")
    return joined.select("vec_id", F.lit(n).cast("bigint").alias("n"), "deviation", F.inline(facts)).withColumn(
        "identity_error", F.lit(error).cast("double")
    )


def whitening(df: DataFrame) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per remaining vector and component.

    Rows whose vector is null, empty or holds null or non-finite entries are dropped; a table without others gives no rows.
    Null ids are kept and repeated rows are rows of their own. Vectors of different lengths are fitted apart. A component
    without variance beyond rounding has a null ``whitened`` and explains 0; the identity error is that of the other
    components, null if there are none. A deviation beyond 64 bits is null; an entry whose integer is beyond them raises an
    error.
    """
    rows = pin(integer_rows(df), "integers")
    out = None
    for size in lengths(rows, F.size("x")):
        part = whiten(rows.filter(F.size("x") == size), size)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return df.sparkSession.createDataFrame(
            [], "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
        )
    return out.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
