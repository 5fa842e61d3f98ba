"""Numeric, label and band expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions.text import let

ENGAGEMENT_COLUMNS = ["likes", "shares", "comments", "views"]

# Display names of score components, and the prefix of the per-label ones.
DISPLAY_NAMES = {
    "Volume pressure": "High Volume",
    "Engagement pressure": "High Engagement",
    "Author influence pressure": "Influential Authors",
}
LABEL_COMPONENT_PREFIX = "Language signal: "


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(c, default: float = 0.0) -> Column:
    """Number, or ``default`` for nulls, NaN and text that is not a number."""
    value = _col(c).try_cast("double")
    return F.coalesce(F.when(~F.isnan(value), value), F.lit(default))


def engagement(df: DataFrame) -> Column:
    """Sum of the engagement columns that ``df`` has; absent columns count 0."""
    total = F.lit(0.0)
    for name in ENGAGEMENT_COLUMNS:
        if name in df.columns:
            total = total + num(name)
    return total


def day(df: DataFrame, column: str) -> Column:
    """Calendar day; text that is not a timestamp gives null."""
    kind = dict(df.dtypes)[column]
    parsed = F.try_to_timestamp(F.col(column)) if kind == "string" else F.col(column)
    return F.to_date(parsed)


def display_label(c) -> Column:
    label = F.trim(_col(c))
    shown = F.when(
        label.startswith("Language signal:"),
        F.concat(F.lit("Language Risk: "), F.trim(F.regexp_replace(label, "^Language signal:", ""))),
    ).otherwise(label)
    for raw, name in DISPLAY_NAMES.items():
        shown = F.when(label == raw, F.lit(name)).otherwise(shown)
    return shown


def score_band(c) -> Column:
    c = _col(c)
    return F.when(c >= 70, "High").when(c >= 40, "Medium").otherwise("Low")


def severity_band(c) -> Column:
    c = _col(c)
    return (
        F.when(c >= 80, "high").when(c >= 60, "elevated").when(c >= 40, "moderate")
        .otherwise("emerging")
    )


def match_band(c) -> Column:
    c = _col(c)
    return F.when(c >= 0.7, "High").when(c >= 0.4, "Medium").otherwise("Low")


def effective_confidence(label, score) -> Column:
    """The stored label when there is one, else the band of the score."""
    stored = F.trim(_col(label))
    return F.coalesce(F.nullif(stored, F.lit("")), score_band(F.round(_col(score), 1)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def unit(c) -> Column:
    """Vector scaled to length 1; a zero vector stays as it is."""
    v = _col(c).cast("array<double>")
    norm = F.sqrt(dot(v, v))
    safe = F.when(norm == 0, F.lit(1.0)).otherwise(norm)
    return let(safe, lambda n: F.transform(v, lambda x: x / n))
