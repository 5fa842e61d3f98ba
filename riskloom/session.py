"""Session helpers: shared folder, lineage cuts, lookup tables and distributed numbering."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window as W, functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own; on a cluster the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/riskloom/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so a lost executor does not lose the result."""
    context = df.sparkSession.sparkContext
    folder = shared_dir(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def lookup(spark: SparkSession, columns: Sequence[str], rows: Sequence[tuple]) -> DataFrame:
    """A small constant table. Built through Arrow so that Catalyst knows its size."""
    values = list(zip(*rows)) if rows else [[] for _ in columns]
    return spark.createDataFrame(pa.table({c: list(v) for c, v in zip(columns, values)}))


#: Inputs of at least so many splits are never redistributed.
FEW_SPLITS = 8


def spread(df: DataFrame) -> DataFrame:
    """Gives every core a share of a small input that was read in a handful of splits.

    Only inputs of fewer than ``FEW_SPLITS`` splits, at most a gigabyte or so by default, are dealt out; larger ones
    are left as they were read, whatever the number of cores. The filter is always true; it keeps other filters above
    the exchange, which below it would run on the few splits.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= min(cores, FEW_SPLITS):
        return df
    return df.repartition(cores).filter(F.monotonically_increasing_id() >= 0)


def row_keyed(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a unique ``_row``, written to the shared folder so that the numbers never change.

    Lets derived values find the way back to their row where ids may repeat or be null.
    """
    path = scratch_path(df.sparkSession, name)
    keyed = df.withColumn("_row", F.monotonically_increasing_id())
    keyed.write.parquet(path)
    return df.sparkSession.read.schema(keyed.schema).parquet(path)


def pinned(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back; later readers prune columns and rows."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict]:
    """``pinned`` rows and the values of ``counts``, aggregates that the write itself works out."""
    report = Observation()
    rows = pinned(df.observe(report, *[value.alias(key) for key, value in counts.items()]), name)
    return rows, report.get


def bounded_rows(df: DataFrame, limit: int):
    """The rows of ``df`` if there are at most ``limit`` of them, else ``None``."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def broadcast_if_small(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """A broadcast hint for a table that is counted and found small; larger ones are left alone."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


#: Bytes of a table sent to every task at once.
BROADCAST_BYTES = 64 << 20


def broadcast_blocks(df: DataFrame, limit: int = BROADCAST_BYTES) -> list[DataFrame]:
    """``df`` in broadcast parts of about ``limit`` bytes, dealt by a hash of the whole row; one part if it is small.

    A table that is joined by parts needs no exchange of the other side, so no key of it can become hot. Bytes are
    counted: strings at their length, arrays as text, and a constant for each row and value.
    """
    value = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in df.columns), F.lit(32))
    held = df.agg(F.coalesce(F.sum(value), F.lit(0))).first()[0]
    blocks = max(1, -(-held // limit))
    if blocks == 1:
        return [F.broadcast(df)]
    part = F.pmod(F.xxhash64(*df.columns), F.lit(blocks))
    return [F.broadcast(df.filter(part == b)) for b in range(blocks)]


def pinned_union(parts: list[DataFrame], name: str) -> DataFrame:
    """All rows of ``parts``; several parts are written one after the other, so that one is worked on at a time."""
    if len(parts) == 1:
        return parts[0]
    path = scratch_path(parts[0].sparkSession, name)
    for part in parts:
        part.write.mode("append").parquet(path)
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(path)


def numbered_locally(df: DataFrame, name: str, number: str = "position") -> DataFrame:
    """Gapless numbers from 0 in no particular order, for rows as they lie: nothing is sorted or exchanged.

    Rows are pinned with their partition and their place in it; the only rows that are gathered are the sizes of the
    partitions.
    """
    path = scratch_path(df.sparkSession, name)
    keyed = df.withColumn("_at", F.monotonically_increasing_id())
    keyed.write.parquet(path)
    rows = df.sparkSession.read.schema(keyed.schema).parquet(path)
    part = F.shiftright("_at", 33)  # the upper bits hold the partition, the lower ones the place
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")
    )
    placed = rows.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return placed.withColumn(number, F.col("_offset") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_offset")


#: Values that a join key of an absent id is spread over.
SPREAD = 4096


def join_by_id(rows: DataFrame, table: DataFrame, id_: Column, key: str, value: str, heavy: bool = True) -> DataFrame:
    """``rows`` with ``value`` of the row of ``table`` whose ``key`` is ``id_``, null where there is none.

    ``id_`` and ``key`` are trimmed strings, ``key`` is unique. Null ids never travel under one key. With ``heavy``, ids
    that hold more than a quarter of a partition's share of the rows are found by a count; there are at most four times
    as many of them as partitions, so their values are broadcast and their rows need no common key either.
    """
    known = table.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    keyed = rows.withColumn("_id", id_)
    found, alone = F.col("_value"), F.col("_id").isNull()
    if heavy:
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        counts = keyed.groupBy("_id").agg(F.count(F.lit(1)).alias("_n"))
        share = counts.agg(F.sum("_n") / (4 * parts)).scalar()
        often = counts.filter(F.col("_id").isNotNull() & (F.col("_n") > share)).select(F.col("_id").alias("_often"))
        often = often.join(known, F.col("_often") == F.col("_key"), "left").select("_often", F.col("_value").alias("_often_value"))
        keyed = keyed.join(F.broadcast(often), F.col("_id") == F.col("_often"), "left")
        found = F.when(F.col("_often").isNotNull(), F.col("_often_value")).otherwise(found)
        alone = alone | F.col("_often").isNotNull()
    # a trimmed key never starts with a space, so these keys find nothing
    nowhere = F.concat(F.lit(" "), F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("string"))
    joined = keyed.withColumn("_id", F.when(alone, nowhere).otherwise(F.col("_id"))).join(known, F.col("_id") == F.col("_key"), "left")
    return joined.withColumn(value, found).drop("_id", "_key", "_value", "_often", "_often_value")


def digest_columns(column: str, name: str) -> dict[str, Column]:
    """Two columns that stand for a value in joins: 128 hash bits, null and dealt at random for a null value."""
    absent = F.col(column).isNull()
    return {
        f"{name}_1": F.when(~absent, F.xxhash64(column)),
        f"{name}_2": F.when(absent, F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))).otherwise(F.xxhash64(F.lit(name), column)),
    }


def dictionary_join(rows: DataFrame, table: DataFrame, column: str, value: str) -> DataFrame:
    """``rows`` left-joined to ``value`` of ``table`` (column, value) on equal ``column``, a text or an array.

    Rows are dealt, sorted and matched by 128 hash bits instead of the value; a match is then compared in full, and the
    job fails if two values ever share a digest.
    """
    left = rows.withColumns(digest_columns(column, "_d"))
    right = table.select(F.col(column).alias("_full"), F.col(value).alias("_value")).withColumns(digest_columns("_full", "_d"))
    joined = left.join(right, ["_d_1", "_d_2"], "left")
    clash = F.col("_full").isNotNull() & (F.col("_full") != F.col(column))
    checked = F.when(clash, F.raise_error(F.lit("two values share a digest"))).otherwise(F.col("_value"))
    return joined.withColumn(value, checked).drop("_d_1", "_d_2", "_full", "_value")


def first_existing(df: DataFrame, names: Sequence[str]) -> str | None:
    """First of ``names`` that ``df`` has; resolved once, when the plan is built."""
    return next((n for n in names if n in df.columns), None)


def numbered(df: DataFrame, order: Sequence, name: str = "position") -> DataFrame:
    """Number rows from 1 in the given total order without moving them through one task.

    Rows are range-partitioned and pinned; each partition is numbered on its own and shifted by
    the size of the partitions before it. Only one row per partition is ever gathered.
    """
    pinned = cut_lineage(
        df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    )
    offsets = (
        pinned.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_offset",
            F.coalesce(
                F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .drop("_n")
    )
    in_part = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return (
        pinned.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + in_part)
        .drop("_part", "_offset")
    )
