"""Ranks and bins of large columns: values are counted once, then narrowed down by histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.session import observed

#: Bins of one refinement; a task that merges histograms holds at most this many rows per bracket.
BINS = 1024


def value_counts(rows: DataFrame, value: Column) -> tuple[DataFrame, dict]:
    """Pinned (value, n), and ``low``, ``high`` and ``total`` from the same pass. Null and NaN are left out."""
    value = value.cast("double")
    counts = (
        rows.select(value.alias("value")).filter(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    )
    return observed(counts, "values", low=F.min("value"), high=F.max("value"), total=F.coalesce(F.sum("n"), F.lit(0)))


def place(value: Column, low: float, high: float, bins: int) -> Column:
    """Number of the equal-width bin between two different bounds; the last bin is closed.

    The ends of the range land in different bins whatever the rounding, so a refinement always gets on.
    """
    scale = 1.0 if high - low != float("inf") else 0.5  # the widest ranges overflow
    share = (value * scale - low * scale) / (high * scale - low * scale)
    return F.least(F.lit(bins - 1), F.floor(share * bins)).cast("int")


def ranked_values(counts: DataFrame, bounds: dict, ranks: Sequence[int]) -> list[float]:
    """The values at ``ranks`` (from 0) of finite counted values, in as many passes as the narrowest bracket needs.

    Every pass splits the bracket of a rank into ``BINS`` bins between its smallest and largest value and keeps the bin
    that holds the rank. A bin reports the least and the greatest value in it, so equal values end the search.
    """
    found = []
    for rank in ranks:
        low, high, before = bounds["low"], bounds["high"], 0
        while low != high:
            inside = counts.filter(F.col("value").between(low, high))
            bins = inside.groupBy(place(F.col("value"), low, high, BINS).alias("bin")).agg(
                F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
            )
            for row in sorted(bins.collect()):  # BINS rows at most
                if before + row["n"] > rank:
                    low, high = row["low"], row["high"]
                    break
                before += row["n"]
        found.append(low)
    return found


def median(rows: DataFrame, value: Column) -> float | None:
    """Exact median, the mean of the two middle values of an even count; ``None`` without values.

    The input is read once. No task sees more than its share of the distinct values.
    """
    counts, bounds = value_counts(rows, value)
    total = bounds["total"]
    if not total:
        return None
    middle = sorted({(total - 1) // 2, total // 2})
    at = ranked_values(counts, bounds, middle)
    return at[0] if len(at) == 1 else at[0] / 2 + at[1] / 2
