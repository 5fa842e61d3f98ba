"""Overview queries: series, histograms, drivers, the narrative table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions.numeric import day, display_label, effective_confidence, num
from riskloom.functions.text import blank, strip
from riskloom.operators import selection
from riskloom.operators.detail import risk_series
from riskloom.operators.scoring import (
    DEFAULT_LABEL, KEY, author_followers, ranked, same_narrative, time_column,
)
from riskloom.session import join_by_id

# Histogram bins and driver threshold.
CONFIDENCE_BINS = 20
DRIVER_THRESHOLD = 15.0


def filter_entity(rows: DataFrame, name: str) -> DataFrame:
    return rows if name == "All" else rows.filter(F.col("entity") == name)


def entity_options(entities: DataFrame) -> DataFrame:
    names = entities.filter(F.col("canonical_name").isNotNull()).select(F.col("canonical_name").alias("option"))
    every = entities.sparkSession.range(1).select(F.lit("All").alias("option"))
    return every.unionByName(names)


def narrative_by_id(narratives: DataFrame, narrative_id: int) -> DataFrame:
    return narratives.filter(F.col("narrative_id") == narrative_id)


def existing_ids(narratives: DataFrame, ids: DataFrame) -> DataFrame:
    """Those of ``ids`` that are scored narratives."""
    return ids.join(narratives.select("narrative_id"), "narrative_id", "left_semi")


def with_acronym(df: DataFrame, acronyms: dict[str, str], label: str = "type") -> DataFrame:
    shown = F.lit("Other")
    for name, acronym in acronyms.items():
        shown = F.when(F.col(label) == name, F.lit(acronym)).otherwise(shown)
    return df.withColumn("acronym", shown)


def followers_enriched(rows: DataFrame, authors: DataFrame) -> DataFrame:
    """Adds or fills ``followers``: own value, else the author's (last duplicate), else 0."""
    table = author_followers(authors, keep="last").withColumnRenamed("followers", "_looked_up")
    own = F.col("followers").try_cast("double") if "followers" in rows.columns else F.lit(None).cast("double")
    joined = join_by_id(rows, table, strip("author_id"), "author_id", "_looked_up")
    return joined.withColumn("followers", F.coalesce(own, "_looked_up", F.lit(0.0))).drop("_looked_up")


def total_posts(narratives: DataFrame) -> DataFrame:
    return narratives.agg(F.coalesce(F.sum("volume"), F.lit(0)).alias("total_posts"))


def posts_by_day(rows: DataFrame) -> DataFrame:
    date = day(rows, time_column(rows))
    return rows.groupBy(date.alias("date")).agg(F.count(F.lit(1)).alias("posts")).filter("date is not null")


def trend_line(series: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Least-squares slope and intercept of ``y`` on days since 1970-01-01."""
    days = F.unix_date(F.col(x)).cast("double")
    value = F.col(y).cast("double")
    return series.groupBy(*(by or [])).agg(
        F.regr_slope(value, days).alias("slope"), F.regr_intercept(value, days).alias("intercept"),
    )


def _labels_or_default(labels) -> Column:
    cleaned = F.filter(F.transform(labels, strip), lambda l: l != "")
    return F.when(F.size(cleaned) > 0, cleaned).otherwise(F.array(F.lit(DEFAULT_LABEL)))


def narratives_by_type(narratives: DataFrame) -> DataFrame:
    """Distinct narratives per label; a narrative without labels counts under the default."""
    return (
        narratives.select(
            "narrative_id", F.explode(F.array_distinct(_labels_or_default("taxonomy_labels"))).alias("type")
        )
        .groupBy("type").agg(F.countDistinct("narrative_id").alias("count"))
    )


def confidence_histogram(rows: DataFrame, bins: int = CONFIDENCE_BINS) -> DataFrame:
    """Right-closed bins over [0, 1]; empty ones are kept."""
    clipped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), num("resolution_confidence")))
    # the bin edges are decimals, so 0.15 must not slip over one through binary rounding
    number = F.greatest(F.lit(1), F.ceil(F.round(clipped * bins, 9))).cast("int")
    counts = rows.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("frequency"))
    every = rows.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select(
        "bin", ((F.col("bin") - 1) / bins).alias("low"), (F.col("bin") / bins).alias("high"),
        F.coalesce("frequency", F.lit(0)).alias("frequency"),
    )


def median_confidence(rows: DataFrame) -> DataFrame:
    """Exact median, one row; null without rows."""
    middle = selection.median(rows, num("resolution_confidence"))
    return rows.sparkSession.range(1).select(F.lit(middle).cast("double").alias("median_confidence"))


def daily_total_risk(rows: DataFrame, narratives: DataFrame) -> DataFrame:
    """Per day the score of each narrative times its posts of that day."""
    date = day(rows, time_column(rows))
    counts = rows.groupBy(*KEY, date.alias("date")).agg(F.count(F.lit(1)).alias("_n")).filter(
        "date is not null"
    )
    return (
        same_narrative(counts, narratives.select(*KEY, "score"), "inner")
        .groupBy("date").agg(F.sum(F.col("score") * F.col("_n")).alias("total_risk"))
    )


def majority_entity(rows: DataFrame) -> DataFrame:
    """Most frequent entity name per narrative, ties to the smallest name."""
    counts = rows.filter(~blank("entity")).groupBy(*KEY, strip("entity").alias("_name")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    return counts.groupBy(*KEY).agg(
        F.min(F.struct((-F.col("_n")).alias("neg"), F.col("_name").alias("name"))).getField("name")
        .alias("majority_entity")
    )


def _by_size(components, threshold: float | None = None) -> Column:
    """Display names of the components, largest absolute value first, ties in map order."""
    entries = F.transform(
        F.map_entries(components),
        lambda e, i: F.struct(
            (-F.abs(e.getField("value"))).alias("neg"), i.alias("pos"), e.getField("key").alias("key")
        ),
    )
    if threshold is not None:
        entries = F.filter(entries, lambda e: -e.getField("neg") >= threshold)
    return F.transform(F.array_sort(entries), lambda e: display_label(e.getField("key")))


def risk_drivers(components="score_components", threshold: float = DRIVER_THRESHOLD) -> Column:
    return _by_size(components, threshold)


def type_and_drivers(narratives: DataFrame, k: int = 3) -> DataFrame:
    return narratives.select(
        "narrative_id", _labels_or_default("taxonomy_labels").alias("risk_types"),
        F.slice(_by_size("score_components"), 1, k).alias("drivers"),
    )


def risk_delta(rows: DataFrame, narratives: DataFrame) -> DataFrame:
    """(entity_id, narrative_id, risk_delta): last day minus the day before in the 7-day series."""
    series = risk_series(rows, narratives)
    last = F.max("date").alias("_last")
    ends = series.groupBy(*KEY).agg(last, F.map_from_entries(F.collect_list(F.struct("date", "risk"))).alias("_by"))
    change = F.element_at("_by", F.col("_last")) - F.element_at("_by", F.date_sub("_last", 1))
    return ends.select(*KEY, F.round(change, 1).alias("risk_delta"))


def narrative_table(narratives: DataFrame, rows: DataFrame, include_entity: bool = False) -> DataFrame:
    """The ranked table of the overview page."""
    title = F.coalesce(
        F.nullif(F.trim("title"), F.lit("")), F.concat(F.lit("Narrative "), F.col("narrative_id"))
    )
    df = same_narrative(ranked(narratives), risk_delta(rows, narratives))
    columns = [
        F.col("rank"), F.col("narrative_id"), title.alias("description"), F.col("volume"), F.col("trend"),
        risk_drivers().alias("drivers"),
        effective_confidence("risk_score_confidence", "score").alias("confidence"),
        F.coalesce("risk_delta", F.lit(0.0)).alias("risk_delta"), F.round("score", 1).alias("score"),
    ]
    if include_entity:
        df = same_narrative(df, majority_entity(rows))
        columns.insert(3, F.coalesce("majority_entity", F.lit("-")).alias("entity"))
    return df.select(*columns)


def entity_overview(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("matched_posts"),
        F.round(F.coalesce(F.avg("resolution_confidence"), F.lit(0.0)), 2).alias("avg_confidence"),
    )
