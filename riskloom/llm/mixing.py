"""Mixes sources to target weights, in DataFrame operations only.

Hash-random keys order each source; range partitions, their sums and a local running sum give every document its
place in the source; the budget cuts there. Budgets above the source's size repeat it by epochs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskloom.llm.common import WORD, local_offsets, pin, shuffle_partitions

#: Weights of the sources in code-point order, repeating; share of all sizes; most epochs of a source.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target): one row per source, null last.

    Targets are weight * level, at most ``most`` times the size; the excess of the full ones is reshared by weight
    until none is above. With sources ordered by size / weight the full ones come first, so the level follows from
    prefix sums. Sources without words get 0. Only rows per source are seen here.
    """
    code_point = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("_rank", F.row_number().over(code_point) - 1).withColumn("_w", weight)
    by_ratio = W.orderBy(F.col("source_size") / F.col("_w"), "_rank")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(0))
    # _level: what a unit of weight gets if the sources before this one are full and no other is
    level = (
        F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most
    ) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    full = F.col("_level") * F.col("_w") >= F.col("source_size") * most
    levelled = ranked.withColumn("_level", level).withColumn("_full", full)
    at = F.min(F.when(~F.col("_full"), F.struct(F.col("source_size") / F.col("_w"), F.col("_rank"), F.col("_level")))).over(every)
    share_of = F.when(F.col("_full"), F.col("source_size") * F.lit(float(most))).otherwise(F.col("_w") * at["_level"])
    return levelled.withColumn("target", share_of).select("source", "source_size", "target")


def _key() -> Column:
    return F.substring(F.md5(F.concat(F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 16)


def _placed(docs: DataFrame, ties: list[str], weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``docs`` (doc_id, source, size and any others) with _key, _source_size, _target, _epochs and _some.

    Every row gets _epochs times its size, and _some words of the last epoch: those of the source's order (_key, then
    ``ties``) that lie before the budget.
    """
    dealt = pin(
        docs.withColumn("_key", _key()).repartitionByRange(shuffle_partitions(docs.sparkSession), "source", "_key", *ties)
        .withColumn("_part", F.spark_partition_id()), "mixed"
    )
    sums = dealt.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sums, weights, share, most)
    offsets = local_offsets(dealt, ["source"], "_part", F.sum("size"))
    lookup = offsets.join(targets, offsets["source"].eqNullSafe(targets["source"])).select(
        offsets["source"].alias("_source"), F.col("_part").alias("_at"), "_before",
        F.col("source_size").alias("_source_size"), F.col("target").alias("_target"),
    )
    running = W.partitionBy("_part", "source").orderBy("_key", *ties).rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.withColumn("_local", F.coalesce(F.sum("size").over(running), F.lit(0)))
    joined = placed.join(lookup, (placed["_part"] == lookup["_at"]) & placed["source"].eqNullSafe(lookup["_source"]))
    budget = F.floor(F.col("_target"))
    epochs = F.when(F.col("_source_size") > 0, F.floor(budget / F.col("_source_size"))).otherwise(F.lit(0))
    left = budget - epochs * F.col("_source_size") - F.col("_before") - F.col("_local")
    some = F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long")
    return joined.withColumns({"_epochs": epochs.cast("long"), "_some": some}).drop("_part", "_local", "_before", "_at", "_source")


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """``docs`` (doc_id, source, size and any others) with _source_size, _target and _taken.

    Ties of the key (equal ids) are ordered by id and size; equal rows are interchangeable.
    """
    placed = _placed(docs, ["doc_id", "size"], **options)
    return placed.withColumn("_taken", F.col("_epochs") * F.col("size") + F.col("_some")).drop("_key", "_epochs", "_some")


def mix_digest(docs: DataFrame, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken. Null texts have size 0 and take nothing."""
    sized = docs.select("doc_id", "source", words().alias("size"))
    return taken_words(sized, **options).select(
        "doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken")
    )


def _source_cuts(sizes: DataFrame, **options) -> DataFrame:
    """Per source of ``sizes`` (doc_id, source, size, _tie): _source, _epochs, and as _cut the last place in the source's
    order that the budget reaches, the rows at that place and the words taken from them together (null: none)."""
    place = ["_key", "doc_id", "size", "_tie"]
    places = _placed(sizes, place[1:], **options).groupBy("source", *place).agg(
        F.max("_epochs").alias("_epochs"), F.count(F.lit(1)).alias("_rows"), F.sum("_some").alias("_some")
    )
    cut = F.max(F.when(F.col("_some") > 0, F.struct(*place, "_rows", "_some")))
    return places.groupBy(F.col("source").alias("_source")).agg(F.max("_epochs").alias("_epochs"), cut.alias("_cut"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each epoch that takes words from a document.

    The one document per source that the budget cuts is shortened to its first words, joined by single spaces. Only ids,
    sizes and text hashes are ordered; the texts stay where they are and are compared with the place of the cut. Ties
    (rows of equal id, size and text hash) are dealt out by numbers when the cut falls among them.
    """
    names, place = docs.columns, ["_key", "doc_id", "size", "_tie"]
    sized = docs.select("doc_id", "source", words().alias("size"), F.xxhash64("text").alias("_tie"), F.struct(*names).alias("_row"))
    cuts = pin(_source_cuts(pin(sized.drop("_row"), "sizes"), **options), "cuts")
    rows = sized.withColumn("_key", _key()).join(cuts, F.col("source").eqNullSafe(F.col("_source")))
    here, cut = F.struct(*place), F.struct(*(F.col("_cut")[c].alias(c) for c in place))
    reached = F.when(F.col("_cut").isNull() | (here > cut), F.lit(0)).when(here < cut, F.col("size")).otherwise(F.col("_cut._some"))
    split = F.col("_cut").isNotNull() & (here == cut) & (F.col("_cut._rows") > 1)
    columns = ("_row", "size", "_epochs")
    mixed = rows.select(*columns, reached.alias("_some"), F.coalesce(split, F.lit(False)).alias("_split"), "_source", "_cut")
    if not cuts.filter("_cut._rows > 1").isEmpty():
        tied = pin(mixed.filter("_split").withColumn("_part", F.spark_partition_id()), "ties")
        before = local_offsets(tied, ["_source"], "_part", F.count(F.lit(1))).select(F.col("_source").alias("_s"), F.col("_part").alias("_at"), "_before")
        number = F.row_number().over(W.partitionBy("_part", "_source").orderBy("size")) - 1
        numbered = tied.withColumn("_number", number).join(before, (F.col("_part") == F.col("_at")) & F.col("_source").eqNullSafe(F.col("_s")))
        left = F.col("_cut._some") - (F.col("_before") + F.col("_number")) * F.col("size")
        own = F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long")
        mixed = mixed.filter("not _split").select(*columns, "_some").union(numbered.select(*columns, own.alias("_some")))
    mixed = mixed.withColumn("_taken", F.col("_epochs") * F.col("size") + F.col("_some")).filter("_taken > 0")
    epoch = F.explode(F.sequence(F.lit(1), F.ceil(F.col("_taken") / F.col("size")).cast("int")))
    rows = mixed.select("_row", "size", "_taken", epoch.alias("_epoch"))
    here = F.least(F.col("size"), F.col("_taken") - (F.col("_epoch") - 1) * F.col("size"))
    first = F.array_join(F.slice(F.regexp_extract_all(F.col("_row.text"), F.lit(WORD), F.lit(0)), F.lit(1), here.cast("int")), " ")
    text = F.when(here == F.col("size"), F.col("_row.text")).otherwise(first)
    return rows.select(*(text.alias("text") if n == "text" else F.col("_row")[n].alias(n) for n in names))
