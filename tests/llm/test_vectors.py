"""Vector operators against brute force, on awkward and on empty tables."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import graph_search, vector_codes, whitening

SCHEMA = (
    "vec_id long, embedding array<float>, label int, row long, chunk long, size int, shard long, x long, weight long, n long, "
    "node int, links int, part int, code string, error long, score double, rank int, component int, whitened double"
)
CLASH = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, "c", 11, 0.5, 12, 13, 0.25)


def vectors(rows: int, size: int, seed: int = 3) -> list[tuple]:
    """Clustered vectors with copies, among them one that a third of the rows hold."""
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(5, size))
    x = (middles[rng.integers(5, size=rows)] + rng.normal(size=(rows, size)) * 0.3).astype(np.float32)
    x[rng.random(rows) < 0.33] = x[0]
    return [(i, x[i].tolist(), int(i % 4) if i % 5 else None) for i in range(rows)]


def table(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA)


def awkward() -> list[tuple]:
    rows = vectors(120, 6)
    rows += [rows[3], rows[50], (50, [0.5] * 6, 1), (None, [0.25] * 6, None), (None, None, 2), (200, None, 1), (250, [], 1)]
    rows += [(300, [float("nan")] * 6, 1), (350, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (400, [math.inf] + [0.0] * 5, 1)]
    rows += [(450, [0.0] * 6, 1), (500, [1.0, 2.0], 3), (550, [2.0, 4.0], 3), (600, [-1.0, 0.5], None)]
    return rows


def finite(rows):
    return [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]


def by_length(rows):
    out = {}
    for r in rows:
        out.setdefault(len(r[1]), []).append(r)
    return out


def want_neighbours(rows, every, k):
    found = []
    for own in by_length([r for r in finite(rows) if any(r[1])]).values():
        x = np.array([r[1] for r in own], np.float32).astype(float)
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        for i, r in enumerate(own):
            if r[0] is not None and r[0] % every == 0:
                others = [(-round(float(u[i] @ u[j]), 9), math.inf if own[j][0] is None else own[j][0]) for j in range(len(own)) if j != i]
                found += [(r[0], n + 1, None if o[1] == math.inf else o[1], -o[0]) for n, o in enumerate(sorted(others)[:k])]
    return sorted(found, key=repr)


def test_neighbours_of_awkward_rows(spark):
    got = graph_search.neighbours(table(spark, awkward()))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    rows = sorted(((r.query_id, r.rank, r.vec_id, round(r.score, 9) + 0.0) for r in got.collect()), key=repr)
    want = want_neighbours(awkward(), 50, 5)
    assert [r[:3] for r in rows] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in rows], [r[3] for r in want], atol=2e-9)
    assert graph_search.neighbours(table(spark, [])).count() == 0


def test_graph_recall_over_shards_and_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[1000:2000] = x[1000] + rng.normal(size=(1000, 24)) * 0.01  # a large group of near copies
    x[2000:2400] = x[2000]  # and one of copies
    found = graph_search.usable(table(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]))
    index = graph_search.build_index(found, shard_rows=1000)
    assert index.select("size", "shard").distinct().count() == 3
    assert index.select("row").distinct().count() == 3000  # every row is indexed
    queries = found.filter("vec_id % 20 = 0")
    got = graph_search.search(index, queries, k=5, width=96, block_bytes=24 * 8 * 60)
    near = {}
    for r in got.collect():
        near.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for i in range(0, 3000, 20):
        s = u @ u[i]
        s[i] = -2
        least = np.sort(s)[-5]
        own = sorted(near[i])
        assert [r[0] for r in own] == [1, 2, 3, 4, 5] and i not in [r[1] for r in own]
        assert np.allclose([r[2] for r in own], s[[r[1] for r in own]], atol=1e-12)
        hits += sum(r[2] >= least - 1e-12 for r in own)
    assert hits / (5 * 150) >= 0.95


def test_graph_reaches_every_node():
    rng = np.random.default_rng(2)
    unit = graph_search.units(np.repeat(rng.normal(size=(6, 8)), 100, axis=0) + rng.normal(size=(600, 8)) * 1e-3).astype(np.float32)
    layers = graph_search.build_graph(unit, graph_search.levels_of(np.arange(600)))
    levels = graph_search.levels_of(np.arange(600))
    front, reached = {int(np.argsort(-levels, kind="stable")[0])}, set()
    while front:
        reached |= front
        front = {int(v) for n in front for v in layers[0][n] if v >= 0} - reached
    assert len(reached) == 600


@pytest.mark.parametrize("dims,side", [(2, 8), (3, 4), (4, 4)])
def test_hilbert_neighbours_touch(dims, side):
    grid = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    order = vector_codes.hilbert_order(np.random.default_rng(0).permutation(grid))
    points = np.random.default_rng(0).permutation(grid)[order]
    assert (np.abs(np.diff(points, axis=0)).sum(axis=1) == 1).all()


def want_codes(rows):
    out, total = [], {}
    for own in by_length(finite(rows)).values():
        size = max(1, -(-len(own[0][1]) // 16)) * 16
        x = np.zeros((len(own), size), int)
        for i, r in enumerate(own):
            x[i, : len(r[1])] = [math.floor(256 * v) for v in r[1]]
        first = sorted(range(len(own)), key=lambda i: (own[i][0] is None, own[i][0] or 0, x[i].tolist()))[:64]
        parts = x.reshape(len(own), 16, -1)
        books = parts[first].transpose(1, 0, 2).copy()
        for turn in range(3):
            gap = ((parts[:, :, None, :] - books[None]) ** 2).sum(axis=3)
            code = gap.argmin(axis=2)
            if turn < 2:
                for p in range(16):
                    for e in np.unique(code[:, p]):
                        books[p, e] = np.floor_divide(parts[code[:, p] == e, p].sum(axis=0), (code[:, p] == e).sum())
        h = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
        error = gap.min(axis=2).sum(axis=1)
        out += [(r[0], bytes(c.astype(np.uint8)).hex(), int(e), r[2], h) for r, c, e in zip(own, code, error)]
    for r in out:
        total[r[3]] = total.get(r[3], 0) + r[2]
    return sorted(((r[0], r[1], r[2], total[r[3]], r[4]) for r in out), key=repr)


@pytest.mark.parametrize("rows", [awkward(), vectors(700, 32), vectors(9, 16), [(1, [], None)]])
def test_codes_equal_full_comparison(spark, rows):
    got = vector_codes.vector_codes(table(spark, rows))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == want_codes(rows)


def test_codes_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "PAIRS", 40)
    monkeypatch.setattr(vector_codes, "BLOCK_POINTS", 7)
    rows = vectors(500, 32, 5)
    got = vector_codes.vector_codes(table(spark, rows).repartition(7))
    assert sorted(map(tuple, got.collect()), key=repr) == want_codes(rows)


def test_codes_of_an_empty_table_and_of_large_components(spark):
    assert vector_codes.vector_codes(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        vector_codes.vector_codes(table(spark, [(1, [1e9] * 16, 1)]))


@pytest.mark.parametrize("rows", [awkward(), vectors(300, 20)])
def test_whitening_equals_numpy(spark, rows):
    got = whitening.whitening(table(spark, rows))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found = {}
    for r in got.collect():
        found.setdefault((r.n, r.component), []).append(r)
    groups = {size: own for size, own in by_length(finite(rows)).items() if size}
    assert len(found) == sum(min(8, size) for size in groups)
    for size, own in groups.items():
        x = np.array([[math.floor(1024 * v) + 100_000 for v in r[1]] for r in own])
        n, total = len(x), x.sum(axis=0)
        deviation = ((n * x - total) ** 2).sum(axis=1)
        away = x - total / n
        values, axes = np.linalg.eigh(away.T @ away / n)
        for c in range(min(8, size)):
            value, axis = values[-1 - c], axes[:, -1 - c]
            key = lambda r: (repr(r[0]), r[1])
            mine = sorted([(r.vec_id, r.deviation) for r in found[n, c + 1]], key=key)
            assert mine == sorted([(r[0], int(d)) for r, d in zip(own, deviation)], key=key)
            rows_found = found[n, c + 1]
            assert abs(rows_found[0].explained - max(value, 0) / values.sum()) < 1e-12
            if value > 1e-6 * values.sum():
                want = np.sort(away @ axis / math.sqrt(value))
                mine = np.sort([r.whitened for r in rows_found])
                assert min(np.abs(mine - want).max(), np.abs(-mine[::-1] - want).max()) < 1e-9
                assert rows_found[0].identity_error < 1e-9


def test_whitening_without_variance_and_without_rows(spark):
    rows = whitening.whitening(table(spark, [(1, [0.5, 0.25], 1), (2, [0.5, 0.25], 1)])).collect()
    assert {(r.deviation, r.whitened, r.explained, r.identity_error) for r in rows} == {(0, None, 0.0, None)} and len(rows) == 4
    assert whitening.whitening(table(spark, [(1, None, 1)])).count() == 0


def test_deviation_beyond_64_bits():
    x = np.array([[100_000, 100_000], [100_000 + 2**21, 100_000]])
    n = 1 << 12
    sums = [100_000 * n, 100_000 * n]
    assert whitening.exact_deviation(x, n, sums) == [0, None]
    assert whitening.exact_deviation(x, 1 << 9, [100_000 << 9] * 2) == [0, 1 << 60]


def test_multiplicities_are_counted_once(spark):
    df = table(spark, vectors(300, 20))
    points = whitening.distinct_vectors(whitening.integer_rows(df))
    assert points.count() < 260 and points.agg(F.sum("weight")).first()[0] == 300
