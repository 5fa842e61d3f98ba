"""Helpers of the training-data operators: pinned tables, word hashing, bounded batches, numbering."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from riskloom.session import scratch_path

#: ASCII white space; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Words a worker remembers; later ones are hashed anew each time.
MEMO_WORDS = 500_000
#: Bytes of text that a Python task looks at together.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pin(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: lineage ends, columns stay prunable."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pin_dealt(df: DataFrame, name: str, column: str) -> DataFrame:
    """Like ``pin``, as a table in buckets of ``column``: joins and groups on it alone do not move the rows again."""
    spark = df.sparkSession
    path, n = scratch_path(spark, name), shuffle_partitions(spark)
    named = path.rpartition("/")[2].replace("-", "_")
    dealt = df.repartition(n, column).write.format("parquet").bucketBy(n, column)
    dealt.option("path", path).option("compression", "zstd").saveAsTable(named)
    return spark.table(named)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(name: str = "text") -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def slices(batch: pa.RecordBatch, column: int, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about ``limit`` bytes in ``column``; no row is left out."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    run = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word (bytes) to 64-bit hash, remembered for the frequent ones."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO_WORDS and len(word) <= 64:
            self[word] = value
        return value


_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]):
    """What this worker process remembers under ``name``. What other operators left behind is forgotten first: workers
    outlive stages, and their memories would add up."""
    if name not in _kept:
        forget()
        _kept[name] = make()
    return _kept[name]


def forget() -> None:
    """Drops what this worker process remembers and gives its memory back."""
    if _kept:
        _kept.clear()
        pa.default_memory_pool().release_unused()


def _word_memory() -> WordHashes:
    return kept("words", WordHashes)


def word_hashes(text: bytes) -> np.ndarray:
    """Hash of each word, A-Z lower-cased; ``bytes.split`` cuts at exactly the white space of ``GAP``."""
    words = text.lower().split()
    return np.fromiter(map(_word_memory().__getitem__, words), np.uint64, len(words))


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles; a shorter text is one shingle, no word gives none."""
    h = word_hashes(text)
    if not len(h):
        return h
    k = min(k, len(h))
    acc = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j])
    return np.unique(acc)


def lowest_hashes(rows: DataFrame, column: str, limit: int, group: str | None = None) -> DataFrame:
    """Rows that hold the ``limit`` lowest values of a 64-bit hash column (of each group), and a few times as many more.

    The number of distinct hashes is estimated first and gives a bound on the hash, so a later top-k gets about
    4 * limit values however many splits the rows come from. Groups are the classes of a model: one small row each.
    """
    share = (4.0 * limit + 100) / F.greatest(F.approx_count_distinct(column, 0.02), F.lit(1))
    bound = (F.least(share, F.lit(1.0)) * 2.0**64 - 2.0**63).alias("_bound")
    if group is None:
        return rows.filter(F.col(column) <= rows.agg(bound).first()["_bound"])
    bounds = F.broadcast(rows.groupBy(group).agg(bound))
    return rows.join(bounds, group).filter(F.col(column) <= F.col("_bound")).drop("_bound")


def local_offsets(rows: DataFrame, keys: list[str], part: str, amount: Column) -> DataFrame:
    """Sum of ``amount`` per (keys, partition) with the sum over earlier partitions as ``_before``.

    One row per key and partition: the only rows that a window sees are partial sums.
    """
    sums = rows.groupBy(*keys, part).agg(amount.alias("_sum"))
    w = W.partitionBy(*keys).orderBy(part) if keys else W.orderBy(part)
    return sums.withColumn(
        "_before", F.coalesce(F.sum("_sum").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).drop("_sum")


def has_letter(text: str) -> bool:
    """Whether any character is a letter; digits of any script, fractions and marks are none."""
    return any(map(str.isalpha, text))
