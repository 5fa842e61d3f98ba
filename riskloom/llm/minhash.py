"""Near-duplicate groups: SetSketch registers, bands, likelihood estimate, exact check, components.

A document is the set of its k-word shingles (64-bit hashes). Equal sets collapse to one node first. Nodes that share
a band of register values meet in a bucket; a bucket proposes (smallest node, other node), never all pairs. Proposals
whose Jaccard estimate is clearly too low go, the rest are checked on full sets. In buckets that still hold several
components, items that few open nodes have bound the similarity from above: members that the bound excludes are closed,
the others are checked against members of the bucket's main component, and last the pairs that cross components and
either pass the bound or share a rare item. So no link of a bucket is lost and no clique is expanded.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from riskloom.llm.common import mix, pin, shingle_set, slices, text_bytes

#: Registers of a sketch, and rows of a band: at similarity 0.8 all 51 bands miss with probability 2e-9.
REGISTERS, ROWS = 256, 5
BANDS = REGISTERS // ROWS
#: Base, rate and number of register values (two bytes).
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 1
#: Standard deviations of the estimate below the threshold at which a proposal is dropped unchecked.
SLACK = 6.0
#: Open nodes that a rare item has at most.
FEW = 256
#: Times that the members outside the main component of a bucket are checked against another member of it.
TURNS = 2


def set_sketch(items: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """SetSketch of a set of 64-bit hashes.

    Each item is a Poisson process whose points fall on random registers; a register keeps its earliest point. Points
    later than the latest register cannot matter, so generation is truncated there. Sketches merge by maximum.
    """
    first = np.full(registers, np.inf)
    active, at, done = items, np.zeros(len(items)), 0
    block = math.ceil(registers * (math.log(registers) + 2) / max(1, len(items))) + 1
    while len(active):
        steps = np.arange(done + 1, done + block + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = mix(active[:, None] + steps[None, :])
        gap = -np.log(((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / registers
        gap[:, 0] += at
        points = np.cumsum(gap, axis=1)
        np.minimum.at(first, (z & np.uint64(registers - 1)).astype(np.int64).ravel(), points.ravel())
        at = points[:, -1]
        keep = at < first.max()
        active, at, done = active[keep], at[keep], done + block
        block = 64
    value = np.floor(1 - np.log(first / RATE) / math.log(BASE))
    return np.clip(value, 0, TOP).astype("<u2")


def jaccard_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of sketch rows, given the set sizes."""
    higher, lower = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - higher - lower
    u = n_a / (n_a + n_b)
    v = 1 - u

    def p(x):
        return -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)

    def likelihood(j):
        more, less = p(np.maximum(u - v * j, 0)), p(np.maximum(v - u * j, 0))
        tiny = 1e-12
        return (
            higher * np.log(np.maximum(more, tiny)) + lower * np.log(np.maximum(less, tiny))
            + same * np.log(np.maximum(1 - more - less, tiny))
        )

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood is concave in j
        x, y = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        up = likelihood(x) < likelihood(y)
        lo, hi = np.where(up, x, lo), np.where(up, hi, y)
    return (lo + hi) / 2


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, 1):
                sizes, digests, registers = [], [], []
                for text in batch.column(1).to_pylist():
                    items = shingle_set(text, k)
                    sizes.append(len(items))
                    digests.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None)
                    registers.append(set_sketch(items).tobytes() if len(items) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                     pa.array(registers, pa.binary()), batch.column(2)], ["doc_id", "n_shingles", "digest", "registers", "hash"],
                )
    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, REGISTERS)
        bands = rows[:, : BANDS * ROWS].reshape(len(rows), BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), bands.shape[:2]).copy()
        for j in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, j])
        node = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(node)], ["bucket", "node"])


def _likely(lowest: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("ra", "rb"))
            n_a, n_b = (batch.column(c).to_numpy().astype(float) for c in ("na", "nb"))
            keep = pa.array(jaccard_estimate(a, b, n_a, n_b) >= lowest)
            yield batch.select(["a", "b"]).filter(keep)
    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, 2):
                nodes, sets = [], []
                for node, digest, text in zip(*(c.to_pylist() for c in batch.columns)):
                    data = shingle_set(text, k).tobytes()
                    if hashlib.blake2b(data, digest_size=16).digest() == digest:
                        nodes.append(node)
                        sets.append(data)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "items"])
    return run


def _exact(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, 2):
                keep = []
                for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    both = np.sort(np.concatenate([np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)]))
                    shared = int((both[1:] == both[:-1]).sum())
                    keep.append(100 * shared >= percent * (len(both) - shared))
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    return run


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star: (node, component = smallest node).

    ``edges`` has columns a and b. A node's neighbours are only ever reduced to a minimum, never collected.
    """
    def smallest(sym: DataFrame) -> DataFrame:
        low = sym.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        return sym.join(low, "u")

    now = pin(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    state = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = smallest(both).filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        kept = smallest(large.filter("u > v"))
        small = kept.select(F.col("v").alias("u"), F.col("low").alias("v")).union(kept.select("u", F.col("low").alias("v")))
        now = pin(small.filter("u != v").distinct(), "edges")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()


#: Number of a row among the pinned documents.
ROW = "_near_row"


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents linked by 100 * |A and B| >= percent * |A or B| on sets of ``k``-word shingles.

    Returns per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id is that
    one). Null, empty and blank texts have no shingle and are linked with nothing. Texts of fewer than ``k`` words
    are one shingle. Equal sets are always linked. Rows that share a doc_id each get their own row; a null doc_id
    never stands for a group unless the whole group has none. Columns other than doc_id and text are ignored.
    """
    source = docs.select("doc_id", text_bytes().alias("text")).withColumn("hash", F.xxhash64("text"))
    sketched = pin(
        source.mapInArrow(_sketches(k), "doc_id long, n_shingles long, digest binary, registers binary, hash long")
        .withColumn("uid", F.monotonically_increasing_id()), "sketches",
    )
    some = sketched.filter("digest is not null")
    classes = pin(some.groupBy("digest").agg(F.min("uid").alias("node"), F.min("doc_id").alias("first_doc")), "classes")
    heads = pin(
        some.join(classes.select(F.col("node").alias("uid")), "uid")
        .select(F.col("uid").alias("node"), "doc_id", "digest", "n_shingles", "registers", "hash"), "heads",
    )
    bands = heads.select("node", "registers").mapInArrow(_bands, "bucket long, node long")
    buckets = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("pivot")).filter("size > 1")
    members = pin(bands.join(buckets, "bucket"), "members")
    wanted = heads.join(members.select("node").distinct(), "node").select(
        "node", "digest", F.col("doc_id").alias("_id"), F.col("hash").alias("_hash")
    )
    sets = pin(
        _own_texts(source, wanted).mapInArrow(_sets(k), "node long, items binary").dropDuplicates(["node"]), "sets",
    )
    least = percent / 100 - SLACK * math.sqrt(percent / 100 * (1 - percent / 100) / REGISTERS)

    def verified(pairs: DataFrame) -> DataFrame:
        sketch = heads.select("node", "registers", "n_shingles")
        a = sketch.toDF("a", "ra", "na")
        b = sketch.toDF("b", "rb", "nb")
        likely = pairs.join(a, "a").join(b, "b").select("a", "b", "ra", "rb", "na", "nb").mapInArrow(_likely(least), "a long, b long")
        return (
            likely.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b").select("a", "b", "xa", "xb")
            .mapInArrow(_exact(percent), "a long, b long")
        )

    tested = pin(members.filter("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "proposed")
    links = pin(verified(tested), "links")
    found = pin(components(links), "components")
    rest = _open_members(members.filter("size > 2").select("bucket", "node"), found)
    if rest is not None:
        items = sets.join(rest.select("node").distinct(), "node").select("node", "items").mapInArrow(_items, "item long, node long")
        counts = items.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
        held = items.join(counts, "item")
        rest = pin(rest.join(_item_facts(held), "node"), "open")  # three reads of a turn, one join
    for turn in range(TURNS):
        if rest is None:
            break
        # pairs (x, y) have at most least(s) common items and at least own(x) + own(y) + greatest(s) together
        placed = rest.join(_mains(rest), "bucket")
        partner = F.when(F.col("component") == F.col("main"), F.struct(F.floor(F.col("rare") / 4), F.xxhash64("node", "bucket", F.lit(turn)), "node"))
        chosen = placed.groupBy("bucket").agg(F.min("own").alias("fewest"), F.min(partner)["node"].alias("partner"))
        alive = pin(placed.join(chosen, "bucket").filter(f"100 * s >= {percent} * (s + own + fewest)"), "alive")
        near = alive.filter("component != main").select(F.least("node", "partner").alias("a"), F.greatest("node", "partner").alias("b"))
        near = pin(near.distinct().join(tested, ["a", "b"], "left_anti"), "proposed")
        tested = tested.union(near)
        links = links.union(pin(verified(near), "links"))
        found = pin(components(links), "components")
        rest = _open_members(alive.select("bucket", "node", "s", "own", "common", "rare", "widest"), found)
    if rest is not None:
        links = links.union(pin(verified(pin(_crossing(rest, held, tested, percent), "proposed")), "links"))
        found = pin(components(links), "components")

    of_class = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = of_class.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    named = of_class.join(smallest, "component").select("digest", "component_id")
    return (
        sketched.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
        .select(
            "doc_id", "n_shingles",
            F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def _own_texts(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, digest, text) of the rows that nodes were made from: shared and null ids meet only with their own text."""
    same = source["doc_id"].eqNullSafe(wanted["_id"]) & (source["hash"] == wanted["_hash"])
    return source.join(wanted, same).select("node", "digest", "text")


def _open_members(rows: DataFrame, found: DataFrame) -> DataFrame | None:
    """Members of buckets that hold several components, with the component; None if there are none.

    Buckets of the same members count once.
    """
    placed = rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    facts = placed.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"),
        F.min("component").alias("lo"), F.max("component").alias("hi"),
    )
    chosen = facts.filter("lo != hi").groupBy("n", "sum").agg(F.min("bucket").alias("bucket")).select("bucket")
    rest = pin(placed.join(chosen, "bucket"), "open")
    return None if rest.isEmpty() else rest


def _mains(rest: DataFrame) -> DataFrame:
    """(bucket, main): the component that most members of a bucket are in."""
    sizes = rest.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("bucket").agg(F.max(F.struct("size", "component"))["component"].alias("main"))


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for batch in slices(big, 1):
            items = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            node = np.repeat(batch.column(0).to_numpy(), [len(x) for x in items])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(items)), pa.array(node)], ["item", "node"])


def _item_facts(held: DataFrame) -> DataFrame:
    """Per node of (item, node, n): own items (n = 1) and s others, rare items (n <= FEW) and common others, largest n."""
    own, rare = F.count_if(F.col("n") == 1), F.count_if(F.col("n") <= FEW)
    facts = held.groupBy("node").agg(
        own.alias("own"), (F.count(F.lit(1)) - own).alias("s"), rare.alias("rare"), (F.count(F.lit(1)) - rare).alias("common"),
        F.max("n").alias("widest"),
    )
    return pin(facts, "items")


def _named(df: DataFrame, to: str, *more) -> DataFrame:
    facts = {"node": to, "s": "s", "own": "o", "common": "c", "rare": "r", "widest": "w", "component": "g"}
    return df.select(*more, *(F.col(k).alias(v if k == "node" else v + to) for k, v in facts.items()))


def _within(n: str, a: str, percent: int) -> str:
    return f"100 * least({n}x, {n}y) >= {percent} * ({a}x + {a}y + greatest({n}x, {n}y))"


def _bucket_pairs(rest: DataFrame, percent: int) -> DataFrame:
    """(x, y): pairs of open buckets that cross components and pass the bounds, each once however many buckets they share.

    A pair is made in the least of its common buckets; a node is in one bucket of a band at most, so its list is short.
    """
    listed = rest.withColumn("mine", F.collect_list("bucket").over(W.partitionBy("node")))
    small = _named(listed.join(_mains(rest), "bucket").filter("component != main"), "x", "bucket", "main", F.col("mine").alias("bx"))
    return small.join(_named(listed, "y", "bucket", F.col("mine").alias("by")), "bucket").filter(
        f"gx != gy and (gy = main or x < y) and {_within('s', 'o', percent)} and ({_within('c', 'r', percent)} or least(wx, wy) <= {FEW}) "
        "and bucket = array_min(array_intersect(bx, by))"
    ).select("x", "y")


def _crossing(rest: DataFrame, held: DataFrame, tested: DataFrame, percent: int) -> DataFrame:
    """Untested pairs of different components that may be similar enough.

    Pairs that share no rare item have at most least(common) common items and rare(x) + rare(y) + greatest(common)
    together; the buckets give those that pass. In wide groups, pairs that share a rare item come from its few holders;
    elsewhere every pair of a bucket is few enough. The largest component of a bucket is only paired with the others.
    """
    wide = rest.filter(F.col("widest") > FEW).select("node", "s", "own", "common", "rare", "widest", "component").distinct()
    holders = pin(held.filter(f"n > 1 and n <= {FEW}").select("item", "node").join(wide, "node"), "holders")
    sharing = _named(holders, "x", "item").join(_named(holders, "y", "item"), "item").filter(f"x < y and gx != gy and {_within('s', 'o', percent)}")
    both = _bucket_pairs(rest, percent).union(sharing.select("x", "y"))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` per group of linked texts, that with the smallest doc_id; all columns stay.

    Rows are told apart by a number of their own: shared ids lose no other text, copies with null or equal ids leave one
    row. Texts without a word are linked with nothing and all stay. An empty table gives an empty table.
    """
    keyed = pin(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    groups = near_duplicates(keyed.select(F.col(ROW).alias("doc_id"), "text"), k, percent)
    members = groups.select(F.col("doc_id").alias(ROW), "component_id").join(keyed.select(ROW, "doc_id"), ROW)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", ROW))
    stays = members.groupBy("component_id").agg(first.alias("_first")).select(F.col(f"_first.{ROW}").alias(ROW))
    return keyed.join(stays, ROW, "left_semi").drop(ROW)
