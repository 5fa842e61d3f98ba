"""Narrative scoring: base components, taxonomy, confidence, trend, titles, labels, rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskloom.functions.numeric import LABEL_COMPONENT_PREFIX, day, engagement, num
from riskloom.functions.text import (
    blank, bounded_summary, compact, has_quotes, is_generic_title, occurrences, strip, strip_quotes,
)
from riskloom.operators.prefilter import signal_text
from riskloom.session import broadcast_if_small, first_existing, join_by_id, numbered, pinned

# Weights of the score, confidence limits, trend length, defaults.
VOLUME_WEIGHT = 5.0
ENGAGEMENT_WEIGHT = 0.015
INFLUENCE_WEIGHT, INFLUENCE_CAP = 2.5, 20.0
RANK_MULTIPLIERS = [1.0, 0.75, 0.5]
CONFIDENCE_HIGH, CONFIDENCE_MEDIUM, CONFIDENCE_VOLUME = 0.75, 0.5, 12
TREND_POINTS = 12
SNIPPET_CHARS = 260
DEFAULT_LABEL = "Operational Resilience"
DEFAULT_SUMMARY = "No narrative summary available."
TIME_COLUMNS = ["created_at", "timestamp", "datetime", "date", "published_at", "posted_at", "time"]
AUTHOR_COLUMNS = ["author_id", "author", "username", "user_id"]

KEY = ["entity_id", "narrative_id"]
BASE_COMPONENTS = {
    "Volume pressure": "volume_pressure",
    "Engagement pressure": "engagement_pressure",
    "Author influence pressure": "influence_pressure",
}


def time_column(df: DataFrame) -> str | None:
    return first_existing(df, TIME_COLUMNS)


def author_column(df: DataFrame) -> str | None:
    return first_existing(df, AUTHOR_COLUMNS)


def _base_sums(rows: DataFrame) -> list[Column]:
    confidence = num("resolution_confidence") if "resolution_confidence" in rows.columns else F.lit(None)
    name = F.col("entity") if "entity" in rows.columns else F.lit("")
    return [
        F.count(F.lit(1)).alias("volume"),
        F.sum(engagement(rows)).alias("engagement"),
        strip(F.min_by(name, F.col("post_id"))).alias("entity"),
        F.avg(confidence.cast("double")).alias("mean_confidence"),
    ]


def narrative_base(rows: DataFrame) -> DataFrame:
    """(entity_id, narrative_id): volume, engagement, entity name, mean match confidence."""
    return rows.groupBy(*KEY).agg(*_base_sums(rows))


def author_followers(authors: DataFrame, keep: str = "first") -> DataFrame:
    """(author_id, followers) with one row per trimmed id; ``keep`` picks the duplicate."""
    order = F.col("load_order") if "load_order" in authors.columns else F.lit(0)
    pick = F.min_by if keep == "first" else F.max_by
    return authors.filter(F.col("author_id").isNotNull()).groupBy(
        strip("author_id").alias("author_id")
    ).agg(pick(num("followers"), order).alias("followers"))


def with_followers(rows: DataFrame, authors: DataFrame | None, heavy: bool = True) -> DataFrame:
    """Adds ``_followers``: own column, else influence column, else the author's, else 0.

    ``heavy=False`` spares the count of authors where one has few rows at most.
    """
    own = first_existing(rows, ["followers", "author_influence"])
    if own:
        return rows.withColumn("_followers", num(own))
    if authors is None or "author_id" not in rows.columns:
        return rows.withColumn("_followers", F.lit(0.0))
    table = author_followers(authors).withColumnRenamed("followers", "_followers")
    joined = join_by_id(rows, table, strip("author_id"), "author_id", "_followers", heavy)
    return joined.withColumn("_followers", F.coalesce("_followers", F.lit(0.0)))


def author_influence(rows: DataFrame, authors: DataFrame | None) -> DataFrame:
    """(entity_id, narrative_id, influence): ln(1 + followers summed per row).

    Followers are looked up once per (narrative, author) and weighted by the author's rows, so an
    author with a large share of the posts is one row in the join.
    """
    own = first_existing(rows, ["followers", "author_influence"])
    if own or authors is None or "author_id" not in rows.columns:
        sums = with_followers(rows, authors).groupBy(*KEY).agg(F.sum("_followers").alias("_f"))
    else:
        per_author = rows.groupBy(*KEY, strip("author_id").alias("author_id")).agg(
            F.count(F.lit(1)).alias("_rows")
        )
        sums = with_followers(per_author, authors, heavy=False).groupBy(*KEY).agg(
            F.sum(F.col("_followers") * F.col("_rows")).alias("_f")
        )
    return sums.select(*KEY, F.log1p(F.greatest(F.lit(0.0), "_f")).alias("influence"))


def same_narrative(df: DataFrame, other: DataFrame, how: str = "left") -> DataFrame:
    """Join on the narrative key; a null entity is a group like any other."""
    renamed = other.withColumnsRenamed({k: f"_k_{k}" for k in KEY})
    match = F.col(KEY[0]).eqNullSafe(F.col(f"_k_{KEY[0]}")) & F.col(KEY[1]).eqNullSafe(
        F.col(f"_k_{KEY[1]}")
    )
    return df.join(renamed, match, how).drop(*[f"_k_{k}" for k in KEY])


def base_components(df: DataFrame) -> DataFrame:
    """Adds the three base components; only the total is clamped, not the first two."""
    return df.withColumns(
        {
            "volume_pressure": F.round(F.col("volume") * VOLUME_WEIGHT, 2),
            "engagement_pressure": F.round(F.col("engagement") * ENGAGEMENT_WEIGHT, 2),
            "influence_pressure": F.round(
                F.least(F.lit(INFLUENCE_CAP), F.col("influence") * INFLUENCE_WEIGHT), 2
            ),
        }
    )


def confidence_label(mean_confidence: Column, volume: Column) -> Column:
    size = F.least(F.lit(1.0), F.log1p(volume) / F.log1p(F.lit(CONFIDENCE_VOLUME)))
    combined = 0.5 * mean_confidence + 0.5 * size
    return (
        F.when(combined >= CONFIDENCE_HIGH, "High").when(combined >= CONFIDENCE_MEDIUM, "Medium")
        .otherwise("Low")
    )


def _hit_sums(column: str, taxonomy: dict[str, list[str]]) -> list[Column]:
    """Keyword occurrences per label, one sum each, in taxonomy order."""
    return [
        F.sum(occurrences(column, words)).alias(f"_hits_{i}")
        for i, words in enumerate(taxonomy.values())
    ]


def _lowered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_lower", F.lower(F.coalesce("text", F.lit(""))))


def _keyword_labels(labels: list[str]) -> Column:
    """The three labels with the most hits, ties in taxonomy order."""
    ranked = F.array_sort(
        F.filter(
            F.array(
                *[
                    F.struct(
                        (-F.col(f"_hits_{i}")).alias("neg"), F.lit(i).alias("pos"),
                        F.lit(label).alias("label"),
                    )
                    for i, label in enumerate(labels)
                ]
            ),
            lambda s: s.getField("neg") < 0,
        )
    )
    return F.transform(F.slice(ranked, 1, 3), lambda s: s.getField("label"))


def taxonomy_hits(
    rows: DataFrame, taxonomy: dict[str, list[str]], weights: dict[str, float]
) -> DataFrame:
    """(entity_id, narrative_id, hits, contributions, keyword_labels).

    Keywords are constants of the plan: rows are counted where they are and only sums move.
    """
    labels = list(taxonomy)
    sums = _lowered(rows).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("_n"), *_hit_sums("_lower", taxonomy)
    )
    scale = F.log1p(F.greatest(F.lit(3), F.col("_n") * 2))
    names = F.array(*[F.lit(label) for label in labels])
    hits = [F.col(f"_hits_{i}") for i in range(len(labels))]
    contributions = [
        F.round(F.lit(weights[label]) * F.least(F.lit(1.0), F.log1p(h) / scale), 2)
        for label, h in zip(labels, hits)
    ]
    return sums.select(
        *KEY,
        F.map_from_arrays(names, F.array(*hits)).alias("hits"),
        F.map_from_arrays(names, F.array(*contributions)).alias("contributions"),
        _keyword_labels(labels).alias("keyword_labels"),
    )


def valid_labels(raw: Column, allowed: list[str]) -> Column:
    """Allowed labels in order, without repeats, at most three; empty means reject."""
    names = F.array(*[F.lit(l) for l in allowed])
    trimmed = F.transform(raw, strip)
    return F.slice(F.array_distinct(F.filter(trimmed, lambda l: F.array_contains(names, l))), 1, 3)


def label_points(labels: Column, weights: dict[str, float]) -> list[Column]:
    """Points of every label, in taxonomy order; the rank of a label in the list discounts it."""
    first_three = F.transform(F.slice(labels, 1, 3), strip)
    points = []
    for label, weight in weights.items():
        rank = F.array_position(first_three, F.lit(label))
        value = F.lit(0.0)
        for i, multiplier in enumerate(RANK_MULTIPLIERS, start=1):
            value = F.when(rank == i, F.round(F.lit(weight * multiplier), 2)).otherwise(value)
        points.append(value)
    return points


def chosen_labels(supplied: Column, produced: Column) -> Column:
    """Supplied labels (trimmed, non-blank, first three), else produced ones, else the default."""
    cleaned = F.slice(F.filter(F.transform(supplied, strip), lambda l: l != ""), 1, 3)
    return (
        F.when(F.size(cleaned) > 0, cleaned).when(F.size(produced) > 0, produced)
        .otherwise(F.array(F.lit(DEFAULT_LABEL)))
    )


def score_total(components: list[Column]) -> Column:
    total = components[0]
    for c in components[1:]:
        total = total + c
    return F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), total)), 1)


def component_map(label_values: list[Column], labels: list[str]) -> Column:
    names = [F.lit(n) for n in BASE_COMPONENTS] + [F.lit(LABEL_COMPONENT_PREFIX + l) for l in labels]
    values = [F.col(c) for c in BASE_COMPONENTS.values()] + label_values
    return F.map_from_arrays(F.array(*names), F.array(*values))


def _interpolated(daily: Column, points: int) -> Column:
    """The sorted daily counts read at ``points`` evenly spaced positions."""
    last = F.size(daily) - 1

    def at(i):
        position = i * last / F.lit(points - 1)
        low = F.floor(position).cast("int")
        a = F.get(daily, low)
        b = F.get(daily, F.least(low + 1, last))
        return F.round(a + (position - low) * (b - a), 2)

    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)


def trend(rows: DataFrame, points: int = TREND_POINTS) -> DataFrame:
    """(entity_id, narrative_id, trend): posts per present day, re-sampled; a ramp without dates.

    Days are counted before anything is collected; an array holds one number per calendar day.
    """
    column = time_column(rows)
    dated = day(rows, column) if column else F.lit(None).cast("date")
    daily = rows.groupBy(*KEY, dated.alias("_day")).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    collected = daily.groupBy(*KEY).agg(
        F.sum("_n").alias("_total"),
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("_day").isNotNull(), F.struct("_day", "_n")))),
            lambda s: s.getField("_n"),
        ).alias("_daily"),
    )
    ramp = F.transform(
        F.sequence(F.lit(0), F.lit(points - 1)),
        lambda i: i * F.greatest(F.lit(1.0), F.col("_total")) / F.lit(points - 1),
    )
    series = (
        F.when(F.size("_daily") == 0, ramp)
        .when(F.size("_daily") == 1, F.array_repeat(F.get("_daily", F.lit(0)), points))
        .otherwise(_interpolated(F.col("_daily"), points))
    )
    return collected.select(*KEY, series.alias("trend"))


def snippets(rows: DataFrame, max_len: int = SNIPPET_CHARS) -> DataFrame:
    """(entity_id, narrative_id, snippet, first_post): distinct compact snippets of a narrative.

    Long form, ordered by ``first_post``; a narrative's snippets have no size bound.
    """
    source = first_existing(rows, ["risk_summary", "cluster_context"])
    raw = F.col(source) if source else signal_text(rows)
    return (
        rows.withColumn("snippet", strip(compact(F.coalesce(raw, F.lit("")), max_len)))
        .filter("snippet != ''")
        .groupBy(*KEY, "snippet").agg(F.min("post_id").alias("first_post"))
    )


def entity_names(rows: DataFrame) -> DataFrame:
    """(entity_id, narrative_id, entity_names): sorted distinct names, joined."""
    names = rows.filter(~blank("entity")).select(*KEY, strip("entity").alias("_name")).distinct()
    return names.groupBy(*KEY).agg(
        F.array_join(F.array_sort(F.collect_set("_name")), ", ").alias("entity_names")
    )


def narrative_posts(rows: DataFrame) -> DataFrame:
    """(entity_id, narrative_id, post_id), long: the id list of a narrative has no size bound."""
    return rows.select(*KEY, F.col("post_id").cast("string").alias("post_id")).filter("post_id is not null")


def usable_title(title: Column) -> Column:
    """Seeded titles are used unless blank or an old truncated one."""
    t = strip(F.coalesce(title, F.lit("")))
    return (t != "") & ~(t.endswith("...") & (F.length(t) <= 90))


def _seed_values(rows: DataFrame) -> Column:
    """Stored title, summary and labels of a narrative's first row."""
    absent = F.lit(None).cast("string")
    title = F.col("narrative_title") if "narrative_title" in rows.columns else absent
    summary = F.col("narrative_summary") if "narrative_summary" in rows.columns else absent
    labels = (
        F.col("narrative_taxonomy_labels")
        if "narrative_taxonomy_labels" in rows.columns
        else F.lit(None).cast("array<string>")
    )
    seed = F.struct(
        title.alias("seeded_title"), summary.alias("seeded_summary"), labels.alias("seeded_labels")
    )
    return F.min_by(seed, F.col("post_id")).alias("_seed")


def seeded(rows: DataFrame) -> DataFrame:
    """(entity_id, narrative_id, seeded_title, seeded_summary, seeded_labels)."""
    return rows.groupBy(*KEY).agg(_seed_values(rows)).select(*KEY, "_seed.*")


def valid_metadata(title: Column, summary: Column) -> Column:
    """Quality gate of produced titles and summaries."""
    t, s = strip_quotes(title), bounded_summary(summary)
    return (t != "") & (s != "") & ~is_generic_title(t) & ~has_quotes(F.concat(t, s))


def titles(df: DataFrame) -> tuple[Column, Column]:
    """Title and summary columns: seeded ones, else ``entity: top label``."""
    usable = usable_title(F.col("seeded_title"))
    summary = bounded_summary(F.coalesce("seeded_summary", F.lit("")))
    label = F.get("taxonomy_labels", F.lit(0))
    name = F.coalesce(F.nullif(F.trim("entity"), F.lit("")), F.col("entity_id"), F.lit("Entity"))
    produced = F.concat_ws(": ", name, label)
    return (
        F.when(usable, strip_quotes("seeded_title")).otherwise(strip_quotes(produced)),
        F.when(usable & (summary != ""), summary).otherwise(DEFAULT_SUMMARY),
    )


def _order_number(df: DataFrame, name: str) -> Column:
    """A decimal in the order of ``name``: its number, or the first 14 bytes of a string.

    Decimals are updated in place by a hash aggregate, strings would need a sort. Longer strings with one beginning
    share a number; who needs the least of them compares the few that do.
    """
    if dict(df.dtypes)[name] != "string":
        return F.col(name).cast("decimal(38,0)")
    raw = F.col(name).cast("binary")

    def seven_bytes(start):
        return F.conv(F.rpad(F.hex(F.substring(raw, start, 7)), 14, "0"), 16, 10).cast("decimal(17,0)")

    return (seven_bytes(1) * F.lit(1 << 56).cast("decimal(17,0)") + seven_bytes(8)).cast("decimal(38,0)")


SEEDED = {
    "narrative_title": ("seeded_title", "string"), "narrative_summary": ("seeded_summary", "string"),
    "narrative_taxonomy_labels": ("seeded_labels", "array<string>"),
}


def narrow_rows(rows: DataFrame, taxonomy: dict[str, list[str]]) -> DataFrame:
    """What scoring adds up, one row per post row and no text: keyword hits are counted where the text is read."""
    confidence = num("resolution_confidence") if "resolution_confidence" in rows.columns else F.lit(None)
    kept = [c for c in (time_column(rows), author_column(rows), "author_id", "followers", "author_influence") if c in rows.columns]
    kept += [c for c in ("entity", *SEEDED) if c in rows.columns]
    return _lowered(rows).select(
        *KEY, "post_id", _order_number(rows, "post_id").alias("_order"), engagement(rows).alias("_engagement"),
        confidence.cast("double").alias("_confidence"),
        *[occurrences("_lower", words).alias(f"_in_{i}") for i, words in enumerate(taxonomy.values())],
        *dict.fromkeys(kept),
    )


def _first_rows(narrow: DataFrame, sums: DataFrame) -> DataFrame:
    """(entity_id, narrative_id, entity, seeded_*): strings of each narrative's first row."""
    name = F.col("entity") if "entity" in narrow.columns else F.lit("")
    seeds = [
        (F.col(c) if c in narrow.columns else F.lit(None).cast(kind)).alias(to) for c, (to, kind) in SEEDED.items()
    ]
    least = same_narrative(narrow, sums.select(*KEY, "_least"), "inner").filter("_order = _least")
    first = W.partitionBy(*KEY).orderBy("post_id")
    return least.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select(
        *KEY, strip(name).alias("entity"), *seeds
    )


def score(
    rows: DataFrame,
    authors: DataFrame | None,
    taxonomy: dict[str, list[str]],
    weights: dict[str, float],
    supplied: DataFrame | None = None,
) -> DataFrame:
    """One row per narrative with its components, score, labels, confidence, trend and title.

    ``supplied`` is an optional label table (entity_id, narrative_id, supplied_labels); stored
    labels on the rows are used otherwise, and keyword hits where neither gives any. The rows are
    read once; every later step reads a narrow table without texts.
    """
    narrow = pinned(narrow_rows(rows, taxonomy), "scoring")
    sums = narrow.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("volume"), F.sum("_engagement").alias("engagement"),
        F.avg("_confidence").alias("mean_confidence"), F.min("_order").alias("_least"),
        *[F.sum(f"_in_{i}").alias(f"_hits_{i}") for i in range(len(taxonomy))],
    )
    df = same_narrative(sums, _first_rows(narrow, sums))
    df = same_narrative(df, author_influence(narrow, authors))
    df = base_components(df.withColumn("influence", F.coalesce("influence", F.lit(0.0))))
    df = same_narrative(df, trend(narrow))
    if supplied is not None:
        df = same_narrative(df, supplied)
    else:
        df = df.withColumn("supplied_labels", F.col("seeded_labels"))
    df = df.withColumn(
        "taxonomy_labels", chosen_labels(F.col("supplied_labels"), _keyword_labels(list(taxonomy)))
    )
    labels = list(weights)
    points = label_points(F.col("taxonomy_labels"), weights)
    title, summary = titles(df)
    scored = df.withColumns(
        {
            "score_components": component_map(points, labels),
            "score": score_total([F.col(c) for c in BASE_COMPONENTS.values()] + points),
            "risk_score_confidence": F.when(
                F.col("mean_confidence").isNull(), "Low"
            ).otherwise(confidence_label(F.col("mean_confidence"), F.col("volume"))),
            "title": title,
            "summary": summary,
        }
    )
    return scored.select(
        "narrative_id", "entity_id", "entity", "title", "summary", "score", "risk_score_confidence",
        "volume", F.round("engagement").cast("bigint").alias("engagement"), "trend",
        "taxonomy_labels", "score_components",
    )


def ranked(narratives: DataFrame) -> DataFrame:
    """Adds ``rank``: score descending, ties by entity and narrative id."""
    order = [F.col("score").desc(), F.col("entity_id").asc(), F.col("narrative_id").asc()]
    return numbered(narratives, order, "rank")


def attach_metadata(rows: DataFrame, narratives: DataFrame) -> DataFrame:
    """Adds ``narrative_title`` and ``narrative_summary`` to post rows; a miss gives ''.

    ``narratives`` are read twice, so they should be pinned.
    """
    meta = narratives.select(
        F.col("narrative_id"), F.col("title").alias("narrative_title"),
        F.col("summary").alias("narrative_summary"),
    )
    kept = rows.drop("narrative_title", "narrative_summary")
    return kept.join(broadcast_if_small(meta), "narrative_id", "left").withColumns(
        {c: F.coalesce(c, F.lit("")) for c in ["narrative_title", "narrative_summary"]}
    )


def stage_counts(tables: dict[str, DataFrame], known: DataFrame | None = None) -> DataFrame:
    """(stage, rows): one count per stage table, and those that are ``known`` already."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("stage"), "rows")
        for name, df in tables.items()
    ]
    out = parts[0] if known is None else known
    for p in parts[1:] if known is None else parts:
        out = out.unionByName(p)
    return out
