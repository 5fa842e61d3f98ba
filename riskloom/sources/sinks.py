"""Sinks. Each one is an action that writes what its argument holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SUMMARY_FIELDS = [
    "narrative_id", "title", "summary", "score", "risk_score_confidence", "volume",
    "engagement", "taxonomy_labels", "entity_id", "entity", "trend", "score_components",
]


def matches_as_json(df: DataFrame) -> DataFrame:
    """The match array as one JSON string."""
    if "resolved_entities" not in df.columns:
        return df
    return df.withColumn("resolved_entities", F.to_json("resolved_entities"))


def _write_json(df: DataFrame, path: str, *partitions: str) -> None:
    writer = df.write.mode("overwrite").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.json(path)


def write_resolved(df: DataFrame, path: str) -> None:
    _write_json(matches_as_json(df), path)


def stored_posts(df: DataFrame) -> DataFrame:
    """Clustered posts as they are stored: embeddings are only needed while clustering and are left out."""
    return matches_as_json(df.drop("risk_embedding"))


def write_clustered(df: DataFrame, path: str) -> None:
    _write_json(stored_posts(df), path)


def write_rejects(df: DataFrame, path: str) -> None:
    _write_json(df, path, "_drop_reason")


def write_narratives(df: DataFrame, path: str) -> None:
    """The summary fields. Post ids go to a table of their own (``write_narrative_posts``)."""
    _write_json(df.select(*[c for c in SUMMARY_FIELDS if c in df.columns]), path)


def write_narrative_posts(df: DataFrame, path: str) -> None:
    """(narrative_id, post_id) rows: a narrative's id list has no size bound, so it stays long."""
    _write_json(df.select("narrative_id", "post_id"), path)


def append_feedback(df: DataFrame, path: str) -> None:
    df.select("narrative_id", "rating").write.mode("append").json(path)


def append_overrides(df: DataFrame, path: str) -> None:
    """Analyst scores; the latest ``at`` of a narrative counts when they are laid over."""
    df.select("narrative_id", "score", "confidence", "reasoning", "at").write.mode("append").parquet(path)


def append_marks(df: DataFrame, path: str) -> None:
    """False-positive marks; the latest ``at`` of a post counts."""
    df.select("post_id", "narrative_id", "entity", "at").write.mode("append").parquet(path)
