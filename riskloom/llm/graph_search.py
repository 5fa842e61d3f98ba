"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, shard results merged.

Vectors are dealt to shards of bounded size by a hash of their row. Each shard becomes a graph of its own: every node
gets a level drawn from a hash, each level links its nodes to near and mutually distant ones, and the level above tells
where to enter. Levels are built from the top; points join a level in batches that walk it together, so the walk is a few
array operations for hundreds of points. The index is a plain table: one row per vector with its links as one flat array.
A search walks every shard with a bounded block of queries, rescores what it met in double precision and keeps the best
of all shards.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from riskloom.llm.common import mix, pin
from riskloom.llm.vectors import finite, matrix

#: Vectors of a shard on average; with their graph they fit a task many times over.
SHARD_ROWS = 4096
#: Links of a node on upper levels; the lowest level has twice as many.
LINKS = 16
#: Width of the beam while building and while searching.
BUILD_WIDTH, SEARCH_WIDTH = 96, 192
#: Width of the beam on the levels above, and points that walk together.
ENTRY_WIDTH, TOGETHER = 8, 256
#: Candidates among which links are chosen, and beam members whose links are followed in one step.
CANDIDATES, STRIDE = 64, 4
#: Bytes of query vectors sent to the tasks at once.
BLOCK_BYTES = 32 << 20

FOUND = pa.schema([(c, pa.int64()) for c in ("query_row", "query_id", "row", "vec_id")] + [("score", pa.float64())])


def walk(unit: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first walks of all queries in step: (ids, similarities), best first, absent ones -1 and -inf."""
    seen = np.zeros((len(q), len(unit)), np.int32)
    ids = np.full((len(q), width), -1, np.int32)
    near = np.full((len(q), width), -np.inf, np.float32)
    done = np.ones((len(q), width), bool)

    def offer(rows: np.ndarray, found: np.ndarray) -> None:
        at = np.where(found >= 0, found, 0)
        i, j = np.nonzero((found >= 0) & (seen[rows[:, None], at] == 0))
        r, node = rows[i], found[i, j]
        seen[r, node] = j + 1  # of repeats in a row the last one stands
        once = seen[r, node] == j + 1
        i, j, r, node = i[once], j[once], r[once], node[once]
        fresh = np.full(found.shape, -np.inf, np.float32)
        fresh[i, j] = np.einsum("ij,ij->i", unit[node], q[r])
        all_near = np.concatenate([near[rows], fresh], axis=1)
        best = np.argsort(-all_near, axis=1, kind="stable")[:, :width]
        ids[rows] = np.take_along_axis(np.concatenate([ids[rows], found], axis=1), best, 1)
        near[rows] = np.take_along_axis(all_near, best, 1)
        closed = np.concatenate([done[rows], np.isneginf(fresh)], axis=1)
        done[rows] = np.take_along_axis(closed, best, 1)

    offer(np.arange(len(q)), entry)
    while len(rows := np.flatnonzero(~done.all(axis=1))):
        waiting = ~done[rows]
        picked = waiting & (np.cumsum(waiting, axis=1) <= STRIDE)
        done[rows] |= picked
        first = np.argsort(~picked, axis=1, kind="stable")[:, :STRIDE]
        valid = np.take_along_axis(picked, first, 1)
        nodes = np.take_along_axis(ids[rows], first, 1)
        offer(rows, np.where(valid[:, :, None], links[nodes], -1).reshape(len(rows), -1))
    ids[np.isneginf(near)] = -1
    return ids, near


def choose(unit: np.ndarray, ids: np.ndarray, near: np.ndarray, count: int) -> np.ndarray:
    """``count`` links out of candidates in falling similarity: first those nearer to the point than to any link chosen
    before, then the nearest of the others."""
    present = ids >= 0
    v = unit[ids]
    hidden_by = np.matmul(v, v.transpose(0, 2, 1)) > near[:, None, :]
    keep = np.zeros(ids.shape, bool)
    blocked, taken = ~present, np.zeros(len(ids), np.int64)
    for i in range(ids.shape[1]):
        keep[:, i] = ~blocked[:, i] & (taken < count)
        taken += keep[:, i]
        blocked = blocked | (keep[:, i, None] & hidden_by[:, i])
    order = np.argsort(np.where(keep, 0, np.where(present, 1, 2)), axis=1, kind="stable")[:, :count]
    return np.take_along_axis(np.where(present, ids, -1), order, 1)


def _ranked(unit: np.ndarray, of: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates of the points ``of`` in falling similarity."""
    near = np.einsum("ikj,ij->ik", unit[ids], unit[of])
    near[ids < 0] = -np.inf
    order = np.argsort(-near, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)


def _link_back(unit: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Adds the new points to the links of those they chose; full lists are chosen anew."""
    width = links.shape[1]
    source, target = np.repeat(new, chosen.shape[1]), chosen.reshape(-1)
    source, target = source[target >= 0], target[target >= 0]
    order = np.lexsort((-np.einsum("ij,ij->i", unit[source], unit[target]), target))
    source, target = source[order], target[order]
    starts = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(target) else np.zeros(0, int)
    place = np.arange(len(target)) - np.repeat(starts, np.diff(np.r_[starts, len(target)]))
    for turn in range(int(place.max(initial=-1)) // width + 1):  # a popular point gets its callers in turns
        now = place // width == turn
        nodes, row = np.unique(target[now], return_inverse=True)
        for a in range(0, len(nodes), 1024):
            own = (row >= a) & (row < a + 1024)
            called = np.full((min(1024, len(nodes) - a), width), -1, np.int32)
            called[row[own] - a, place[now][own] % width] = source[now][own]
            some = nodes[a : a + 1024]
            both = np.concatenate([links[some], called], axis=1)
            crowded = (both >= 0).sum(axis=1) > width
            roomy = both[~crowded]
            links[some[~crowded]] = np.take_along_axis(roomy, np.argsort(roomy < 0, axis=1, kind="stable"), 1)[:, :width]
            if crowded.any():
                links[some[crowded]] = choose(unit, *_ranked(unit, some[crowded], both[crowded]), width)


def _grow(unit: np.ndarray, members: np.ndarray, enter, width: int, links_of_new: int) -> np.ndarray:
    """Links of one level, a row per node (-1: none). ``enter`` gives the entry points of nodes."""
    links = np.full((len(unit), width), -1, np.int32)
    placed = np.zeros(len(unit), bool)
    at = 0
    while at < len(members):
        new = members[at : at + min(TOGETHER, max(at, 32))]
        inner = unit[new] @ unit[new].T
        np.fill_diagonal(inner, -np.inf)
        order = np.argsort(-inner, axis=1, kind="stable")[:, : min(CANDIDATES, len(new) - 1)]
        ids, near = new[order].astype(np.int32), np.take_along_axis(inner, order, 1)
        if at:
            entry = enter(new)
            entry = np.where((entry >= 0) & placed[entry], entry, members[0]).astype(np.int32)
            met, met_near = walk(unit, links, unit[new], entry, BUILD_WIDTH)
            ids, near = np.concatenate([ids, met], axis=1), np.concatenate([near, met_near], axis=1)
        order = np.argsort(-near, axis=1, kind="stable")[:, :CANDIDATES]
        ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
        chosen = choose(unit, ids, near, links_of_new)
        links[new, : chosen.shape[1]] = chosen
        placed[new] = True
        _link_back(unit, links, new, chosen)
        at += len(new)
    return links


def _reconnect(unit: np.ndarray, links: np.ndarray, start: int) -> np.ndarray:
    """Adds a column of links so that every node is reached from ``start``: crowded lists may have dropped some."""
    extra = np.full(len(links), -1, np.int32)
    reached, front = np.zeros(len(links), bool), np.array([start])
    while True:
        while len(front):
            reached[front] = True
            after = np.concatenate([links[front].reshape(-1), extra[front]])
            front = np.unique(after[after >= 0])
            front = front[~reached[front]]
        lost = np.flatnonzero(~reached)
        if not len(lost):
            return np.concatenate([links, extra[:, None]], axis=1)
        node = lost[0]
        free = np.flatnonzero(reached & (extra < 0))
        extra[free[np.argmax(unit[free] @ unit[node])]] = node
        front = lost[:1]


def levels_of(keys: np.ndarray) -> np.ndarray:
    """A level per node, drawn from a hash of its row: each level has a ``LINKS``-th of the nodes of the one below."""
    draw = (mix(keys.astype(np.uint64) + np.uint64(1)).astype(np.float64) + 1) / 2.0**64
    return np.floor(-np.log(np.minimum(draw, 1.0)) / math.log(LINKS)).astype(np.int64)


def build_graph(unit: np.ndarray, levels: np.ndarray) -> list[np.ndarray]:
    """Links of each level from the lowest up; the lowest has one more column, by which every node can be reached."""
    layers: list[np.ndarray] = []
    order = np.argsort(-levels, kind="stable")
    for level in range(int(levels.max(initial=0)), -1, -1):
        above = list(layers)
        members = order[: np.count_nonzero(levels >= level)]

        def enter(nodes, above=above):
            return descend(unit, above, unit[nodes], int(order[0]))

        layers.append(_grow(unit, members, enter, LINKS if level else 2 * LINKS, LINKS))
    layers[-1] = _reconnect(unit, layers[-1], int(order[0]))
    return layers[::-1]


def descend(unit: np.ndarray, from_top: list[np.ndarray], q: np.ndarray, start: int) -> np.ndarray:
    """Entry points below the given levels."""
    entry = np.full((len(q), ENTRY_WIDTH), -1, np.int32)
    entry[:, 0] = start
    for links in from_top:
        entry, _ = walk(unit, links, q, entry, ENTRY_WIDTH)
    return entry


def units(x: np.ndarray) -> np.ndarray:
    """Rows at length one, in double precision; scaled first so that no square overflows or vanishes."""
    x = x.astype(np.float64) / np.abs(x).max(axis=1, keepdims=True, initial=0)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _build_shard(part: pa.Table) -> pa.Table:
    part = part.sort_by("row")
    distinct, first, node = np.unique(matrix(part["vector"]), axis=0, return_index=True, return_inverse=True)
    keys = part["row"].to_numpy()
    levels = levels_of(keys[first])
    layers = build_graph(units(distinct).astype(np.float32), levels)
    flat = [np.concatenate([layers[l][i] for l in range(levels[i] + 1)]) for i in range(len(distinct))]
    node = node.reshape(-1).astype(np.int32)
    links: list = [None] * len(part)
    for i, row in enumerate(first):
        links[row] = flat[i]
    return part.append_column("node", pa.array(node)).append_column("links", pa.array(links, pa.list_(pa.int32())))


class Shard:
    """A shard of the index as flat arrays."""

    def __init__(self, part: pa.Table):
        node = part["node"].to_numpy()
        ids = part["vec_id"].to_numpy(zero_copy_only=False)
        missing = np.asarray(part["vec_id"].is_null())
        self.missing, self.ids = missing, np.where(missing, 0, ids).astype(np.int64)
        self.rows = part["row"].to_numpy()
        # rows of a node stand together, smallest ids first
        self.order = np.lexsort((self.rows, self.ids, missing, node))
        self.starts = np.searchsorted(node[self.order], np.arange(int(node.max()) + 2))
        self.unit = units(matrix(part["vector"]))[self.order[self.starts[:-1]]]
        self.small = self.unit.astype(np.float32)
        owners = part.filter(part["links"].is_valid())
        widths = np.asarray(pc.list_value_length(owners["links"].combine_chunks()))
        values = owners["links"].combine_chunks().flatten().to_numpy()
        owner, begins = owners["node"].to_numpy(), np.cumsum(widths) - widths
        levels = (widths - 2 * LINKS - 1) // LINKS
        self.layers = []
        for level in range(int(levels.max()) + 1):
            width = LINKS if level else 2 * LINKS + 1
            skip = 2 * LINKS + 1 + (level - 1) * LINKS if level else 0
            here = levels >= level
            links = np.full((len(self.unit), width), -1, np.int32)
            links[owner[here]] = values[(begins[here] + skip)[:, None] + np.arange(width)]
            self.layers.append(links)
        top = owner[levels == levels.max()]
        keys = self.rows[self.order[self.starts[:-1]]]
        self.start = int(top[np.argmin(keys[top])])

    def nearest(self, q: np.ndarray, own: np.ndarray, k: int, width: int):
        """(query number, position of the row, score) of the ``k`` best rows met for each unit query, its own left out."""
        if len(self.unit) <= width:  # the beam holds the whole shard
            nodes = np.broadcast_to(np.arange(len(self.unit), dtype=np.int32), (len(q), len(self.unit)))
        else:
            small = q.astype(np.float32)
            entry = descend(self.small, self.layers[:0:-1], small, self.start)
            nodes, _ = walk(self.small, self.layers[0], small, entry, width)
        score = np.where(nodes >= 0, np.einsum("ikj,ij->ik", self.unit[nodes], q), -np.inf)
        least = self.order[self.starts[nodes]]
        order = np.lexsort((self.ids[least], self.missing[least], -score), axis=1)[:, : k + 1]
        nodes, score = np.take_along_axis(nodes, order, 1), np.take_along_axis(score, order, 1)
        i, j = np.nonzero(np.isfinite(score))
        # of a node with many rows the k + 1 smallest ids can be needed
        held = np.minimum(self.starts[nodes[i, j] + 1] - self.starts[nodes[i, j]], k + 1)
        within = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
        row = self.order[np.repeat(self.starts[nodes[i, j]], held) + within]
        query, value = np.repeat(i, held), np.repeat(score[i, j], held)
        other = self.rows[row] != own[query]
        query, row, value = query[other], row[other], value[other]
        order = np.lexsort((self.rows[row], self.ids[row], self.missing[row], -value, query))
        query, row, value = query[order], row[order], value[order]
        begins = np.searchsorted(query, np.arange(len(q)))
        best = np.arange(len(query)) - begins[query] < k
        return query[best], row[best], value[best]


def usable(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(row, size, vec_id, vector), pinned: the rows whose vector can be compared, under a number of their own."""
    nonzero = F.exists(vector_column, lambda c: c != 0)
    rows = df.filter(finite(vector_column) & nonzero).select(
        F.monotonically_increasing_id().alias("row"), F.size(vector_column).alias("size"),
        F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector_column).alias("vector"),
    )
    return pin(rows, "vectors")


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index of ``usable`` rows, pinned: their columns with shard, node and flat links. Every row is in it; equal
    vectors of a shard are one node, whose links stand on its first row."""
    shards = vectors.groupBy("size").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("_shards"))
    dealt = vectors.join(F.broadcast(shards), "size").select(
        "size", F.pmod(F.xxhash64("row"), F.col("_shards")).alias("shard"), "row", "vec_id", "vector"
    )
    kind = dealt.schema["vector"].dataType.simpleString()
    schema = f"size int, shard bigint, row bigint, vec_id bigint, vector {kind}, node int, links array<int>"
    return pin(dealt.groupBy("size", "shard").applyInArrow(_build_shard, schema), "graph")


def _looker(sent, k: int, width: int):
    """The search of one shard with a block of queries that was sent to the tasks."""
    def look(part: pa.Table) -> pa.Table:
        if (size := part["size"][0].as_py()) not in sent.value:
            return FOUND.empty_table()
        rows, ids, vectors = sent.value[size]
        shard, out = Shard(part), []
        for a in range(0, len(rows), TOGETHER):
            query, row, score = shard.nearest(vectors[a : a + TOGETHER], rows[a : a + TOGETHER], k, width)
            out.append((query + a, row, score))
        query, row, score = (np.concatenate(c) for c in zip(*out))
        return pa.table([
            pa.array(rows[query]), ids.take(pa.array(query)), pa.array(shard.rows[row]), part["vec_id"].take(pa.array(row)),
            pa.array(score),
        ], FOUND)

    return look


def search(index: DataFrame, queries: DataFrame, k: int, width: int = SEARCH_WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_row, query_id, rank, row, vec_id, score) of the ``k`` nearest rows found for each of ``queries``, which are
    ``usable`` rows of the indexed table. Queries travel to the shards in blocks of about ``block_bytes``."""
    spark = index.sparkSession
    held = queries.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()[0] * 8
    blocks = max(1, -(-held // block_bytes))
    schema = "query_row bigint, query_id bigint, row bigint, vec_id bigint, score double"
    found = []
    for b in range(blocks):
        block = queries.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("row", "size", "vec_id", "vector").toArrow()
        by_size = {}
        for size in set(block["size"].to_pylist()):
            own = block.filter(pc.equal(block["size"], size))
            by_size[size] = own["row"].to_numpy(), own["vec_id"], units(matrix(own["vector"]))
        sent = spark.sparkContext.broadcast(by_size)
        # written before the next block is fetched, so that the driver holds one block only
        found.append(pin(index.groupBy("size", "shard").applyInArrow(_looker(sent, k, width), schema), "found"))
        sent.destroy()
    merged = found[0]
    for more in found[1:]:
        merged = merged.unionByName(more)
    best = W.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return merged.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_row", "query_id", "rank", "row", "vec_id", "score"
    )


def neighbours(df: DataFrame, every: int = 50, k: int = 5, width: int = SEARCH_WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found by cosine for each row whose id ``every`` divides.

    Vectors that are null, zero, or hold null or non-finite components take no part; a table without others gives no rows.
    A row never finds itself, but finds other rows with its id or vector. A null id is no query and, as a neighbour, ranks
    behind equal scores. Vectors are compared with those of their length only. Repeated query ids are queries each.
    """
    vectors = usable(df)
    index = build_index(vectors, shard_rows)
    return search(index, vectors.filter(F.col("vec_id") % every == 0), k, width).select("query_id", "rank", "vec_id", "score")
