"""What a user's request runs: stored posts, entity filter, followers, scores from stored texts, dashboard tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from riskloom.operators import dashboard, scoring
from riskloom.session import pinned
from riskloom.sources import store
from riskloom.sources.readers import with_labels


@dataclass(frozen=True)
class Overview:
    """Tables of the overview page."""

    posts: DataFrame
    narratives: DataFrame
    table: DataFrame
    total_posts: DataFrame
    posts_by_day: DataFrame
    narratives_by_type: DataFrame
    confidence_histogram: DataFrame
    median_confidence: DataFrame
    daily_total_risk: DataFrame


def served_posts(spark: SparkSession, directory: str, authors: DataFrame, entity_id: str | None = None) -> DataFrame:
    """Stored posts of one entity or all, with the stored labels of their narrative and last-wins followers."""
    posts = store.read_by_entity(spark, f"{directory}/posts", entity_id=entity_id)
    narratives = store.read_by_entity(spark, f"{directory}/narratives", entity_id=entity_id)
    return dashboard.followers_enriched(with_labels(posts, narratives), authors)


def overview(
    spark: SparkSession, directory: str, authors: DataFrame, taxonomy: dict[str, list[str]], weights: dict[str, float],
    entity_id: str | None = None,
) -> Overview:
    """The overview page of one entity, or of all.

    Titles, summaries and labels are the stored ones; scores are computed again, so that new followers count.
    """
    posts = pinned(served_posts(spark, directory, authors, entity_id), "served")
    narratives = pinned(scoring.score(posts, None, taxonomy, weights), "scored")
    return Overview(
        posts=posts, narratives=narratives,
        table=dashboard.narrative_table(narratives, posts, include_entity=True),
        total_posts=dashboard.total_posts(narratives),
        posts_by_day=dashboard.posts_by_day(posts),
        narratives_by_type=dashboard.narratives_by_type(narratives),
        confidence_histogram=dashboard.confidence_histogram(posts),
        median_confidence=dashboard.median_confidence(posts),
        daily_total_risk=dashboard.daily_total_risk(posts, narratives),
    )
