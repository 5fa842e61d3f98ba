"""Drill-down queries: header facts, 7-day series, quotes, descriptions, overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from riskloom.functions.numeric import day, display_label, engagement, num, severity_band
from riskloom.functions.text import NULL_WORDS, blank, compact, sql_string, squash, strip, without_quotes
from riskloom.operators.scoring import (
    DEFAULT_LABEL, KEY, author_column, same_narrative, time_column,
)
from riskloom.session import first_existing

# Series length, quote sizes, keyword head, default impact.
SERIES_DAYS = 7
QUOTE_CHARS_MAX, QUOTE_CHUNK_WORDS, QUOTE_LIMIT = 120, 18, 3
HEAD_POSTS = 20
DEFAULT_IMPACT = "reputational and operational pressure."
NO_TEXT = "No narrative text available to estimate sentiment."
AUTHOR_NAME_COLUMNS = ["author_name", "author", "username", "author_id", "user_id"]


def header_facts(rows: DataFrame) -> DataFrame:
    """First seen, posts, engagement, distinct authors and platforms per narrative."""
    time, author = time_column(rows), author_column(rows)
    seen = F.col(time) if time else F.lit(None).cast("timestamp")
    if time and dict(rows.dtypes)[time] == "string":
        seen = F.try_to_timestamp(seen)
    aggregates = [
        F.coalesce(F.date_format(F.min(seen), "yyyy-MM-dd HH:mm"), F.lit("-")).alias("first_seen"),
        F.count(F.lit(1)).alias("posts"),
        F.sum(engagement(rows)).alias("engagement"),
        (F.countDistinct(author) if author else F.count(F.lit(1))).alias("authors"),
    ]
    platform = F.when(~blank("platform"), strip("platform")) if "platform" in rows.columns else F.lit(None)
    aggregates.append(F.array_sort(F.collect_set(platform.cast("string"))).alias("platforms"))
    return rows.groupBy(*KEY).agg(*aggregates)


def _calendar(daily: DataFrame, days: int) -> DataFrame:
    """The last ``days`` calendar days up to each narrative's last dated day."""
    ends = daily.groupBy(*KEY).agg(F.max("date").alias("_last"))
    return ends.select(
        *KEY, F.explode(F.sequence(F.date_sub("_last", days - 1), F.col("_last"))).alias("date")
    )


def _on_calendar(daily: DataFrame, days: int) -> DataFrame:
    values = daily.withColumnsRenamed({k: f"_k_{k}" for k in KEY}).withColumnRenamed("date", "_date")
    match = F.col("date") == F.col("_date")
    for k in KEY:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return _calendar(daily, days).join(values, match, "left").drop("_date", *[f"_k_{k}" for k in KEY])


def risk_series(rows: DataFrame, narratives: DataFrame, days: int = SERIES_DAYS) -> DataFrame:
    """(entity_id, narrative_id, date, risk): mean of score times match confidence, gaps 0."""
    confidence = (
        num("resolution_confidence", 0.5) if "resolution_confidence" in rows.columns else F.lit(1.0)
    )
    daily = (
        rows.groupBy(*KEY, day(rows, time_column(rows)).alias("date"))
        .agg(F.avg(confidence).alias("_c")).filter("date is not null")
    )
    series = same_narrative(_on_calendar(daily, days), narratives.select(*KEY, "score"), "inner")
    return series.select(
        *KEY, "date", F.coalesce(F.col("score") * F.col("_c"), F.lit(0.0)).alias("risk")
    )


def activity_series(rows: DataFrame, days: int = SERIES_DAYS) -> DataFrame:
    """(entity_id, narrative_id, date, posts, authors, engagement) for the last days, gaps 0."""
    author = author_column(rows)
    daily = (
        rows.groupBy(*KEY, day(rows, time_column(rows)).alias("date"))
        .agg(
            F.count(F.lit(1)).alias("posts"),
            (F.countDistinct(author) if author else F.count(F.lit(1))).alias("authors"),
            F.sum(engagement(rows)).alias("engagement"),
        )
        .filter("date is not null")
    )
    filled = {"posts": F.lit(0), "authors": F.lit(0), "engagement": F.lit(0.0)}
    return _on_calendar(daily, days).withColumns({c: F.coalesce(c, z) for c, z in filled.items()})


def component_ranking(narratives: DataFrame) -> DataFrame:
    """Components per narrative with absolute value and share of the largest one (at least 1)."""
    largest = F.aggregate(
        F.map_values("score_components"), F.lit(1.0), lambda m, v: F.greatest(m, F.abs(v))
    )
    return narratives.select(
        "narrative_id", largest.alias("_largest"), F.explode("score_components").alias("component", "contribution")
    ).select(
        "narrative_id", display_label("component").alias("feature"), "contribution",
        F.abs("contribution").alias("abs_contribution"),
        (F.abs("contribution") / F.col("_largest")).alias("strength"),
    )


def matched_posts(rows: DataFrame) -> DataFrame:
    """Formatted post rows of the detail table; an unparsable time keeps its raw text."""
    time = time_column(rows)
    if time is None:
        created = F.lit("-")
    else:
        raw = F.col(time)
        parsed = F.try_to_timestamp(raw) if dict(rows.dtypes)[time] == "string" else raw
        created = F.coalesce(F.date_format(parsed, "yyyy-MM-dd HH:mm"), raw.cast("string"))
    own = first_existing(rows, ["followers", "author_influence"])
    text = F.col("text") if "text" in rows.columns else F.lit("-")
    platform = F.col("platform") if "platform" in rows.columns else F.lit("-")
    match = num("resolution_confidence") if "resolution_confidence" in rows.columns else F.lit(0.0)
    return rows.select(
        "narrative_id", "post_id", created.alias("created"), platform.alias("platform"), text.alias("text"),
        (num(own) if own else F.lit(0.0)).alias("followers"), engagement(rows).alias("engagement"),
        match.alias("match_confidence"),
    )


def post_details(rows: DataFrame) -> DataFrame:
    """Author name, url and raw text of posts, for inspection."""
    names = [F.col(c).cast("string") for c in AUTHOR_NAME_COLUMNS if c in rows.columns]
    url = F.col("url") if "url" in rows.columns else F.lit(None).cast("string")
    return rows.select(
        "post_id", F.coalesce(*names, F.lit("-")).alias("author"),
        F.coalesce(url, F.lit("-")).alias("url"), "text",
    )


def quotes(rows: DataFrame, limit: int = QUOTE_LIMIT) -> DataFrame:
    """(entity_id, narrative_id, position, quote): distinct shortened contexts in post order, then
    18-word chunks of them where a narrative has fewer than ``limit``.

    Copies are folded before anything is ranked, and ranks are limited before rows are exchanged.
    """
    source = "risk_context" if "risk_context" in rows.columns else "text"

    def usable(c):
        s = squash(F.coalesce(c, F.lit("")))
        return F.when((s != "") & ~F.lower(s).isin(NULL_WORDS), s)

    flagged = rows.select(*KEY, "post_id", usable(F.col(source)).alias("_s"), usable(F.col("text")).alias("_t"))
    if source != "text":
        # narratives without one usable context fall back to the text of their posts
        none = flagged.groupBy(*KEY).agg(F.count("_s").alias("_usable")).filter("_usable = 0").drop("_usable")
        fallback = same_narrative(flagged, none.withColumn("_fall", F.lit(True))).filter("_fall")
        flagged = flagged.filter("_s is not null").select(*KEY, "post_id", "_s").unionByName(
            fallback.filter("_t is not null").select(*KEY, "post_id", F.col("_t").alias("_s"))
        )
    texts = flagged.filter("_s is not null").groupBy(*KEY, "_s").agg(F.min("post_id").alias("_post"))

    def first_distinct(candidates: DataFrame) -> DataFrame:
        order = F.struct("_stage", "_post", "_chunk")
        folded = candidates.groupBy(*KEY, F.lower("_q").alias("_lower")).agg(
            F.min(F.struct(order.alias("o"), F.col("_q").alias("q"))).alias("m")
        )
        rank = F.row_number().over(W.partitionBy(*KEY).orderBy("m.o", "_lower"))
        return folded.withColumn("position", rank).filter(F.col("position") <= limit).select(
            *KEY, "position", F.col("m.q").alias("quote")
        )

    def candidate(stage, chunk, quote):
        return [F.lit(stage).alias("_stage"), "_post", chunk.alias("_chunk"), quote.alias("_q")]

    whole = texts.select(*KEY, *candidate(0, F.lit(0), compact("_s", QUOTE_CHARS_MAX)))
    top = first_distinct(whole)
    short = top.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_have")).filter(F.col("_have") < limit)
    words = F.split("_s", " ")
    starts = F.sequence(F.lit(1), F.size(words), F.lit(QUOTE_CHUNK_WORDS))
    chunks = F.transform(starts, lambda i: F.array_join(F.slice(words, i, QUOTE_CHUNK_WORDS), " "))
    wanting = same_narrative(texts, short, "inner")
    chunked = wanting.select(*KEY, "_post", F.posexplode(chunks).alias("_i", "_c")).select(
        *KEY, *candidate(1, F.col("_i"), compact("_c", QUOTE_CHARS_MAX))
    )
    whole_short = wanting.select(*KEY, *candidate(0, F.lit(0), compact("_s", QUOTE_CHARS_MAX)))
    filled = first_distinct(whole_short.unionByName(chunked))
    complete = same_narrative(top, short.withColumn("_short", F.lit(True))).filter("_short is null")
    return complete.select(*KEY, "position", "quote").unionByName(filled)


def descriptions(narratives: DataFrame, impact: dict[str, str]) -> DataFrame:
    """Stored summary without quotes, else a sentence from counts, severity, labels and impact."""
    stored = without_quotes(squash(F.coalesce("summary", F.lit(""))))
    labels = F.filter(F.transform("taxonomy_labels", strip), lambda l: l != "")
    primary = F.coalesce(F.get(labels, F.lit(0)), F.lit(DEFAULT_LABEL))
    second = F.get(labels, F.lit(1))
    theme = F.when(second.isNull(), primary).otherwise(
        F.concat(primary, F.lit(" with overlap into "), second)
    )
    effect = F.lit(DEFAULT_IMPACT)
    for label, text in impact.items():
        effect = F.when(primary == label, F.lit(text)).otherwise(effect)
    name = F.coalesce(F.nullif(F.trim("entity"), F.lit("")), F.lit("this entity"))
    built = F.concat(
        F.lit("Across "), F.col("volume").cast("string"), F.lit(" matched posts, this "), name,
        F.lit("-linked narrative shows "), severity_band("score"), F.lit(" risk centered on "), theme,
        F.lit(". The common pattern suggests "), effect,
    )
    made = F.when(F.col("volume") > 0, without_quotes(squash(built))).otherwise(NO_TEXT)
    return narratives.select("narrative_id", F.coalesce(F.nullif(stored, F.lit("")), made).alias("description"))


def classify_by_keywords(
    rows: DataFrame, keywords: dict[str, list[str]], max_posts: int | None = None
) -> DataFrame:
    """(entity_id, narrative_id, type): the label with the most distinct keywords present.

    Presence is or-ed over the posts; a keyword that would only arise across two joined posts does
    not count.
    """
    if max_posts is not None:
        order = W.partitionBy(*KEY).orderBy("post_id")
        rows = rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= max_posts)
    lowered = rows.withColumn("_lower", F.lower(F.coalesce("text", F.lit(""))))
    flags = [
        F.expr(f"max(int(contains(_lower, {sql_string(w)})))").alias(f"_k{i}_{j}")
        for i, words in enumerate(keywords.values())
        for j, w in enumerate(words)
    ]
    present = lowered.groupBy(*KEY).agg(*flags)
    scored = []
    for i, (label, words) in enumerate(keywords.items()):
        total = F.expr(" + ".join(f"_k{i}_{j}" for j in range(len(words))) or "0")
        scored.append(F.struct((-total).alias("neg"), F.lit(i).alias("pos"), F.lit(label).alias("label")))
    best = F.array_min(F.array(*scored))
    return present.select(
        *KEY,
        F.when(best.getField("neg") < 0, best.getField("label")).otherwise(DEFAULT_LABEL).alias("type"),
    )


def with_overrides(narratives: DataFrame, overrides: DataFrame) -> DataFrame:
    """Latest analyst (score, confidence, reasoning) per narrative laid over the computed values."""
    latest = overrides.groupBy("narrative_id").agg(
        F.max(F.struct("at", "score", "confidence", "reasoning")).alias("_o")
    )
    return narratives.join(latest, "narrative_id", "left").withColumns(
        {
            "score": F.coalesce("_o.score", "score"),
            "risk_score_confidence": F.coalesce("_o.confidence", "risk_score_confidence"),
            "reasoning": F.coalesce("_o.reasoning", F.lit("")),
        }
    ).drop("_o")


def without_false_positives(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows whose post was not marked; a mark that names another entity moves the row there.

    ``marks`` holds (post_id, entity): entity null or 'None' removes the post.
    """
    latest = marks.groupBy("post_id").agg(F.max_by(F.struct("entity"), F.col("at")).alias("_m"))
    joined = rows.join(latest, "post_id", "left")
    moved = F.col("_m.entity")
    stays = F.col("_m").isNull() | (~blank(moved) & (moved != "None"))
    return joined.filter(stays).withColumn("entity", F.coalesce(moved, "entity")).drop("_m")


def unmarked_narratives(narratives: DataFrame, marks: DataFrame) -> DataFrame:
    """Narratives that no analyst marked as a whole."""
    return narratives.join(marks.select("narrative_id").distinct(), "narrative_id", "left_anti")


def feedback_summary(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("narrative_id").agg(
        F.count(F.lit(1)).alias("ratings"), F.avg("rating").alias("mean_rating")
    )
