"""Shards by a hierarchical weighted hash tree: region, then rack, then shard.

At each level every child draws ln(u) / weight with u hashed from (doc_id, child); the largest draw wins, so a child
is chosen in proportion to its weight and a changed weight moves rows only into or out of that subtree. A leaf added as
a region of its own therefore takes rows only into itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.llm.common import local_offsets, pin, shuffle_partitions


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def even_tree(shards: int, racks: int = 2, per_rack: int = 2) -> list[Leaf]:
    """Shards in equal regions of ``racks`` x ``per_rack``; the last region may be smaller."""
    per_region = racks * per_rack
    return [Leaf(f"g{i // per_region}", f"g{i // per_region}/k{i % per_region // per_rack}", i) for i in range(shards)]


def grown(tree: Sequence[Leaf], shard: int, weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, as a region of its own."""
    return [*tree, Leaf(f"new{shard}", f"new{shard}/k0", shard, weight)]


def _winner(key: Column, weights: dict[str, float]) -> Column:
    """Name of the child with the largest draw; equal draws go to the smaller name."""
    draws = []
    for name, weight in sorted(weights.items(), reverse=True):
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double") + 0.5) / F.lit(float(2**53))
        draws.append(F.struct((F.log(u) / F.lit(weight)).alias("draw"), F.lit(name).alias("name")))
    return F.greatest(*draws)["name"] if len(draws) > 1 else draws[0]["name"]


def _sums(leaves: Sequence[Leaf], name) -> dict[str, float]:
    out: dict[str, float] = {}
    for leaf in leaves:
        out[name(leaf)] = out.get(name(leaf), 0.0) + leaf.weight
    return out


def _below(chosen: Column, groups: dict[str, Column]) -> Column:
    out = F.lit(None)
    for name, column in groups.items():
        out = F.when(chosen == name, column).otherwise(out)
    return out


def place(docs: DataFrame, tree: Sequence[Leaf], name: str = "shard") -> DataFrame:
    """``docs`` with the shard of each row, decided by doc_id and the tree alone (a null id counts as empty text)."""
    leaves = [x for x in tree if x.weight > 0]
    if len({x.shard for x in leaves}) != len(leaves) or not leaves:
        raise ValueError("a tree needs leaves, each with a shard of its own")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    regions = sorted({x.region for x in leaves})
    racks = sorted({(x.region, x.rack) for x in leaves})
    rack_of = {r: _winner(key, _sums([x for x in leaves if x.region == r], lambda x: x.rack)) for r in regions}
    shard_of = {k: _winner(key, _sums([x for x in leaves if x.rack == k], lambda x: f"{x.rack}/{x.shard}")) for _, k in racks}
    out = docs.withColumn("_region", _winner(key, _sums(leaves, lambda x: x.region)))
    out = out.withColumn("_rack", _below(F.col("_region"), rack_of)).withColumn("_leaf", _below(F.col("_rack"), shard_of))
    return out.withColumn(name, F.substring_index("_leaf", "/", -1).cast("int")).drop("_region", "_rack", "_leaf")


def sharded(docs: DataFrame, tree: Sequence[Leaf], more: Sequence[Leaf] | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes plus one; a null text counts as empty. slot numbers the rows of a shard from 0 by doc_id (nulls
    first), then checksum and size; equal rows are interchangeable. ``more`` is the tree of grown_shard, null without.
    Rows that share a doc_id share a shard. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = place(rows, tree)
    rows = place(rows, more, "grown_shard") if more else rows.withColumn("grown_shard", F.lit(None).cast("int"))
    order = ["shard", "doc_id", "text_crc32", "size"]
    dealt = (
        rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    )
    # the sorted order of a partition gives its local numbers, which partial counts turn into global ones
    numbered = pin(dealt, "sharded")
    first = numbered.groupBy("shard", "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    offsets = local_offsets(first, ["shard"], "_part", F.sum("_n")).join(first.drop("_n"), ["shard", "_part"])
    return numbered.join(offsets, ["shard", "_part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("_before") + F.col("_row") - F.col("_first")).alias("slot"), "grown_shard",
    )
