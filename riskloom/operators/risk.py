"""Risk gate: contexts, distinct work items, decisions, validation, routing, embeddings."""

from __future__ import annotations

from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from riskloom.functions.numeric import unit
from riskloom.functions.text import (
    blank, is_generic_summary, mention_index, normalize, sentences, sentences_around, squash,
    without_quotes, words_present,
)
from riskloom.operators.prefilter import signal_text
from riskloom.session import dictionary_join, numbered

# Window sizes, batch sizes and reject reason.
RISK_WINDOW, RISK_WORDS = 2, 100
CLUSTER_WINDOW, CLUSTER_CHARS, CLUSTER_FALLBACK = 1, 1200, 3
DECISION_BATCH, EMBEDDING_BATCH = 2, 64
NOT_RISK = "llm_marked_not_risk"
DECISIONS = "results array<struct<id:string,is_risk:boolean,summary:string>>"

TEXT_FEATURES = 256


def _around(df: DataFrame, window: int, fallback: int) -> DataFrame:
    mention = F.col("mention_text") if "mention_text" in df.columns else F.lit("")
    return (
        df.withColumn("_sents", sentences(signal_text(df)))
        .withColumn("_hit", mention_index(F.col("_sents"), F.coalesce(mention, F.lit(""))))
        .withColumn("_ctx", sentences_around(F.col("_sents"), F.col("_hit"), window, fallback))
        .drop("_sents", "_hit")
    )


def context_words(
    df: DataFrame, window: int = RISK_WINDOW, max_words: int = RISK_WORDS, name: str = "risk_context"
) -> DataFrame:
    """Sentences around the first mention, cut to ``max_words`` words."""
    near = _around(df, window, 2 * window + 1)
    cut = F.array_join(F.slice(F.split("_ctx", " "), 1, max_words), " ")
    return near.withColumn(name, cut).drop("_ctx")


def context_chars(
    df: DataFrame, window: int = CLUSTER_WINDOW, max_chars: int = CLUSTER_CHARS,
    name: str = "cluster_context",
) -> DataFrame:
    """Sentences around the first mention, cut to ``max_chars`` characters."""
    near = _around(df, window, CLUSTER_FALLBACK)
    short = F.concat(F.rtrim(F.substring("_ctx", 1, max_chars - 3)), F.lit("..."))
    return near.withColumn(
        name, F.when(F.length("_ctx") > max_chars, short).otherwise(F.col("_ctx"))
    ).drop("_ctx")


def contexts(expanded: DataFrame) -> DataFrame:
    """Adds ``risk_context``, the label it is judged for, and the id of its work item."""
    label = F.coalesce(
        F.when(~blank("entity"), F.trim("entity")), F.when(~blank("entity_id"), F.trim("entity_id")),
        F.lit("Entity"),
    )
    return (
        context_words(expanded)
        .withColumn("entity_label", label)
        .withColumn("item_id", F.sha2(F.concat_ws("\u001f", "entity_label", "risk_context"), 256))
    )


def work_items(df: DataFrame) -> DataFrame:
    """Distinct (entity, context) pairs; copies are judged once."""
    return df.select(
        F.col("item_id").alias("id"), F.col("entity_label").alias("entity"),
        F.col("risk_context").alias("context"),
    ).distinct()


def batched(items: DataFrame, size: int, key: str = "id") -> DataFrame:
    """Adds ``batch``: runs of ``size`` items in key order, numbered from 0; only the last may be smaller."""
    placed = numbered(items, [key], "_place")
    return placed.withColumn("batch", F.floor((F.col("_place") - 1) / size)).drop("_place")


def keyword_decisions(items: DataFrame, taxonomy: dict[str, list[str]]) -> DataFrame:
    """Default producer: risk when the context holds a taxonomy keyword; summary = first sentence."""
    first = F.coalesce(F.get(sentences("context"), F.lit(0)), F.lit(""))
    summary = squash(without_quotes(first))
    words = sorted({w for listed in taxonomy.values() for w in listed})
    risk = words_present("_lower", words) & ~is_generic_summary(summary)
    return items.withColumn("_lower", F.lower("context")).select(
        "id", risk.alias("is_risk"), F.when(risk, summary).otherwise("").alias("summary")
    )


def parse_decisions(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Decision rows of raw payloads; ``reason`` is set on payloads that do not parse.

    A code fence around the object is allowed and taken off.
    """
    fenced = F.trim(F.col(payload)).startswith("```")
    body = F.regexp_replace(F.trim(F.regexp_replace(F.trim(payload), r"^`+|`+$", "")), r"(?i)^json\s*", "")
    text = F.when(fenced, F.trim(body)).otherwise(F.trim(payload))
    parsed = raw.withColumn("_results", F.from_json(text, DECISIONS).getField("results"))
    reason = F.when(blank(payload), "empty_payload").when(F.col("_results").isNull(), "invalid_schema")
    rows = parsed.withColumn("reason", reason).withColumn("_r", F.explode_outer("_results"))
    summary = squash(without_quotes(F.coalesce("_r.summary", F.lit(""))))
    return rows.select(
        *[c for c in raw.columns if c != payload],
        F.trim("_r.id").alias("id"), F.col("_r.is_risk").alias("is_risk"),
        F.when(F.col("_r.id").isNotNull(), F.when(F.col("_r.is_risk"), summary).otherwise(""))
        .alias("summary"),
        "reason",
    )


def validate_decisions(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """(id, reason) of everything wrong with a decision table; empty when it can be applied."""
    rows = decisions.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or(F.col("is_risk").isNull()).alias("no_flag"),
        F.bool_or(F.col("is_risk") & is_generic_summary("summary")).alias("generic"),
        F.bool_or(~F.col("is_risk") & (F.coalesce("summary", F.lit("")) != "")).alias("stray"),
    )
    both = items.select("id", F.lit(True).alias("known")).join(rows, "id", "full")
    reasons = F.filter(
        F.array(
            F.when(F.col("n").isNull(), "missing_id"),
            F.when(F.col("known").isNull(), "unexpected_id"),
            F.when(F.col("n") > 1, "duplicate_id"),
            F.when(F.col("no_flag"), "non_boolean_is_risk"),
            F.when(F.col("generic"), "generic_summary"),
            F.when(F.col("stray"), "summary_without_risk"),
        ),
        lambda r: r.isNotNull(),
    )
    return both.select("id", F.explode(reasons).alias("reason"))


def apply_decisions(df: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows with contexts, routed: ``_drop_reason`` is null on accepted rows."""
    chosen = decisions.select(
        F.col("id").alias("item_id"), "is_risk", F.col("summary").alias("risk_summary")
    )
    accepted = F.col("is_risk") & ~blank("risk_summary")
    return df.join(chosen, "item_id", "left").withColumn(
        "_drop_reason",
        F.when(F.coalesce(accepted, F.lit(False)), F.lit(None).cast("string"))
        .when(~F.col("is_risk"), NOT_RISK).otherwise("undecided"),
    )


def accepted_rows(routed: DataFrame) -> DataFrame:
    return routed.filter(F.col("_drop_reason").isNull()).drop("_drop_reason", "is_risk", "item_id")


def rejected_rows(routed: DataFrame) -> DataFrame:
    return routed.filter(F.col("_drop_reason").isNotNull()).drop("is_risk", "item_id", "risk_summary")


def text_vectors(texts: DataFrame, column: str, features: int = TEXT_FEATURES) -> DataFrame:
    """Default embedding producer: hashed, IDF-weighted unit vectors of distinct texts."""
    words = texts.select(column).distinct().withColumn(
        "_words", F.filter(F.split(normalize(column), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    )
    counts = HashingTF(numFeatures=features, inputCol="_words", outputCol="_tf").transform(words)
    model = IDF(inputCol="_tf", outputCol="_idf").fit(counts)
    return model.transform(counts).select(
        column, unit(vector_to_array("_idf")).alias("risk_embedding")
    )


def embed(df: DataFrame, vectors: DataFrame | None = None, column: str = "risk_summary") -> DataFrame:
    """One embedding per distinct accepted summary, joined back to the rows.

    ``vectors`` is a table (summary, risk_embedding); without it the default producer is used.
    """
    table = text_vectors(df, column) if vectors is None else vectors
    return dictionary_join(df, table, column, "risk_embedding")


def missing_embeddings(df: DataFrame) -> DataFrame:
    """Accepted summaries without a vector; must be empty before clustering."""
    return (
        df.filter(F.col("risk_embedding").isNull() | (F.size("risk_embedding") == 0))
        .select("risk_summary").distinct()
    )
