"""The whole build: posts to ranked narratives, with stored artifacts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from riskloom.operators import clustering, entities as resolution, prefilter, risk, scoring
from riskloom.session import lookup, observed, pinned
from riskloom.sources import sinks


@dataclass(frozen=True)
class Artifacts:
    """Stage tables of one build, and the row counts that their writes reported."""

    posts: DataFrame
    kept: DataFrame
    dropped: DataFrame
    resolved: DataFrame
    expanded: DataFrame
    accepted: DataFrame
    rejected: DataFrame
    clustered: DataFrame
    narratives: DataFrame
    rows: dict[str, int]

    def counts(self) -> DataFrame:
        """(stage, rows) as the writes of the build reported them; nothing is computed again."""
        return lookup(self.posts.sparkSession, ["stage", "rows"], list(self.rows.items()))


def build(
    posts: DataFrame,
    authors: DataFrame,
    entities: DataFrame,
    extra: DataFrame,
    lexicon: DataFrame,
    taxonomy: dict[str, list[str]],
    weights: dict[str, float],
    decisions: DataFrame | None = None,
    vectors: DataFrame | None = None,
    trials: int = clustering.TRIALS,
) -> Artifacts:
    """Cheap filters first, then resolution, the risk gate, clustering and scoring.

    Tables that later stages read more than once are pinned in the shared folder. ``decisions``
    defaults to the keyword producer and ``vectors`` to hashed text vectors.
    """
    every = F.count(F.lit(1))
    passed = F.count_if(F.col("_drop_reason").isNull())
    evaluated, seen = observed(prefilter.prefilter(posts, lexicon), "evaluated", rows=every, kept=passed)
    kept = prefilter.kept(evaluated)
    resolved = pinned(resolution.resolve(kept, entities, extra), "resolved")
    expanded, found = observed(risk.contexts(resolution.expand(resolved, entities)), "expanded", rows=every)
    items = risk.work_items(expanded)
    chosen = risk.keyword_decisions(items, taxonomy) if decisions is None else decisions
    problems = risk.validate_decisions(items, chosen)
    if not problems.isEmpty():
        raise ValueError(f"decision table is not valid: {problems.first().asDict()}")
    routed, gated = observed(risk.apply_decisions(expanded, chosen), "routed", rows=every, kept=passed)
    accepted = pinned(risk.embed(risk.accepted_rows(routed), vectors), "accepted")
    if not risk.missing_embeddings(accepted).isEmpty():
        raise ValueError("an accepted summary has no embedding")
    clustered = pinned(clustering.cluster(accepted, trials=trials), "clustered")
    narratives, scored = observed(scoring.score(clustered, authors, taxonomy, weights), "narratives", rows=every)
    rows = {
        "input_posts": seen["rows"], "kept_posts": seen["kept"], "dropped_posts": seen["rows"] - seen["kept"],
        "entity_rows_after_resolution": found["rows"], "entity_rows_risk_relevant": gated["kept"],
        "entity_rows_dropped_no_risk": gated["rows"] - gated["kept"], "narratives": scored["rows"],
    }
    return Artifacts(
        posts=posts, kept=kept, dropped=prefilter.dropped(evaluated), resolved=resolved,
        expanded=expanded, accepted=accepted, rejected=risk.rejected_rows(routed),
        clustered=scoring.attach_metadata(clustered, narratives), narratives=narratives, rows=rows,
    )


def save(artifacts: Artifacts, directory: str) -> None:
    sinks.write_resolved(artifacts.resolved, f"{directory}/resolved_posts")
    sinks.write_clustered(artifacts.clustered, f"{directory}/clustered_posts")
    sinks.write_rejects(artifacts.dropped, f"{directory}/filtered_out_posts")
    sinks.write_rejects(artifacts.rejected, f"{directory}/filtered_out_entity_rows")
    sinks.write_narratives(artifacts.narratives, f"{directory}/narratives")
    sinks.write_narrative_posts(artifacts.clustered, f"{directory}/narrative_posts")
