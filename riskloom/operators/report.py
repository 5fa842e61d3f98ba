"""Report queries: distributions over stage tables and narratives."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskloom.operators.scoring import stage_counts
from riskloom.operators.selection import value_counts

# Bins of the report's histograms.
CONFIDENCE_BINS, SCORE_BINS = 25, 20


def funnel(tables: dict[str, DataFrame], known: DataFrame | None = None) -> DataFrame:
    return stage_counts(tables, known)


def method_mix(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy(F.coalesce("resolution_method", F.lit("unknown")).alias("method")).agg(
        F.count(F.lit(1)).alias("count")
    )


def confidence_bins(resolved: DataFrame, n: int = CONFIDENCE_BINS) -> DataFrame:
    """(bin, count): equal-width bins between the smallest and the largest confidence.

    Values are counted once; bounds come from that pass and bins from the counts.
    """
    values, bounds = value_counts(resolved, F.col("resolution_confidence").try_cast("double"))
    low, high = bounds["low"], bounds["high"]
    number = F.lit(0)
    if bounds["total"] and high > low:
        width = (high - low) / n
        number = F.least(F.lit(n - 1), F.floor(F.round((F.col("value") - low) / width, 9)))
    return values.groupBy(number.cast("int").alias("bin")).agg(F.sum("n").alias("count"))


def size_distribution(rows: DataFrame) -> DataFrame:
    """(rows, narratives): how many narratives have how many rows."""
    sizes = rows.groupBy("narrative_id").agg(F.count(F.lit(1)).alias("rows"))
    return sizes.groupBy("rows").agg(F.count(F.lit(1)).alias("narratives"))


def score_distribution(narratives: DataFrame, n: int = SCORE_BINS) -> DataFrame:
    """(bin, count): equal-width bins over 0 to 100, the last one closed."""
    number = F.least(F.lit(n - 1), F.floor(F.col("score") * n / 100.0)).cast("int")
    return narratives.filter("score is not null").groupBy(number.alias("bin")).agg(
        F.count(F.lit(1)).alias("count")
    )


def confidence_counts(narratives: DataFrame) -> DataFrame:
    return narratives.groupBy(
        F.coalesce("risk_score_confidence", F.lit("unknown")).alias("confidence")
    ).agg(F.count(F.lit(1)).alias("count"))


def label_counts(narratives: DataFrame, column: str = "taxonomy_labels") -> DataFrame:
    """Narratives per label, from an array or from its string form; other text is one label."""
    if dict(narratives.dtypes)[column].startswith("array"):
        labels = F.col(column)
    else:
        raw = F.trim(column)
        parsed = F.from_json(raw, "array<string>", {"allowSingleQuotes": "true"})
        listed = F.when(raw.startswith("["), parsed)
        labels = F.when(raw != "", F.coalesce(listed, F.array(raw)))
    return (
        narratives.select(F.explode(labels).alias("label"))
        .groupBy("label").agg(F.count(F.lit(1)).alias("count"))
    )
