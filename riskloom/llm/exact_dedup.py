"""Exact duplicates by content sort, in DataFrame operations only.

Texts are range-partitioned on bounded keys of their normalised content (sampled splitters), sorted externally so that
equal texts are neighbours, and compared in full. A group of copies is spread over salts, so that it may span
partitions; its runs are then joined through one small row per run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskloom.llm.common import GAP, pin, shuffle_partitions

#: Characters of the content that the splitters see, and runs that a group of copies may be cut into.
HEAD, SALTS = 24, 64
#: Column that carries whole rows through the sort.
CARRIED = ("_document",)


def exact_groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space became one space; null counts as empty. The
    smallest doc_id of a group stays; rows that repeat it are all kept (they are the same document) and all counted.
    A null doc_id sorts last and stays only in a group without ids. Other columns are ignored.
    """
    rows = _runs(docs, F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(salts)).cast("int"))
    runs = rows.filter("rank = 1").select("text_sha256", "salt", "run_first", "run_size")
    group = W.partitionBy("text_sha256")
    merged = runs.select(
        "text_sha256", "salt", F.min("run_first").over(group).alias("keep_id"), F.sum("run_size").over(group).alias("group_size")
    )
    return rows.select("doc_id", "salt", "text_sha256").join(merged, ["text_sha256", "salt"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def _runs(docs: DataFrame, salt: Column, *carried: Column) -> DataFrame:
    """Sorted rows, pinned: doc_id, salt, text_sha256, the row's rank in its run of equal texts, the run's least id and size."""
    norm = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), GAP, " ")
    keyed = docs.select("doc_id", norm.alias("norm"), salt.alias("salt"), *carried).select(
        F.substring("norm", 1, HEAD).alias("head"), F.xxhash64("norm").alias("h"), "salt", "norm", "doc_id", *CARRIED[: len(carried)],
    )
    dealt = keyed.repartitionByRange(shuffle_partitions(docs.sparkSession), "head", "h", "salt")
    # The window's keys contain the range keys, so the sorted partitions are used as they are.
    run = W.partitionBy("head", "h", "salt", "norm").orderBy(F.col("doc_id").asc_nulls_last())
    whole = run.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return pin(
        dealt.select(
            "doc_id", "salt", F.row_number().over(run).alias("rank"), F.first("doc_id").over(whole).alias("run_first"),
            F.count(F.lit(1)).over(whole).alias("run_size"), F.sha2("norm", 256).alias("text_sha256"), *CARRIED[: len(carried)],
        ), "runs",
    )


def drop_exact_duplicates(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row of ``docs`` per text, that with the smallest doc_id; all columns stay.

    Rows are told apart by themselves, not by their id: shared ids lose no other text, and of copies with a null or the
    same id one row stays. A null doc_id stays only where no copy has an id. An empty table gives an empty table.
    """
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int")
    rows = _runs(docs, salt, F.struct(*docs.columns).alias(CARRIED[0]))
    heads = rows.filter("rank = 1")
    # a text has at most one run per salt
    least = heads.groupBy("text_sha256").agg(F.min(F.struct(F.col("run_first").isNull(), "run_first", "salt")).alias("_least"))
    stays = heads.join(least, (heads["text_sha256"] == least["text_sha256"]) & (heads["salt"] == F.col("_least.salt")))
    return stays.select(F.inline(F.array(CARRIED[0])))
