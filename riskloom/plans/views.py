"""The engine's input tables as views over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.plans import seeds
from riskloom.session import lookup, spread


#: The entity whose overview is served alone.
SERVED_ENTITY = "licensse"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _post_columns() -> list:
    return [
        F.col("doc_id").cast("string").alias("post_id"), "text", F.col("source").alias("platform"),
        (F.col("n_chars") % 50).cast("double").alias("shares"),
        (F.col("doc_id") % 7).cast("double").alias("comments"),
        F.col("n_chars").cast("double").alias("views"),
    ]


def post_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts without their event: enough for everything that only reads text."""
    return spread(table(spark, sf_dir, "documents")).select(*_post_columns())


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    events = table(spark, sf_dir, "events")
    joined = docs.join(events, F.col("event_id") == F.col("doc_id") * 10, "left")
    return joined.select(
        *_post_columns(), F.col("ts").alias("created_at"),
        F.col("user_id").cast("string").alias("author_id"), F.col("value").alias("likes"),
    )


def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("author_id"),
        F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("followers"),
        F.col("c_custkey").alias("load_order"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("post_id"), F.col("label").cast("string").alias("entity_id"),
        F.col("embedding").cast("array<double>").alias("risk_embedding"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        (F.col("doc_id") % 50).alias("narrative_id"), (1 + F.col("doc_id") % 5).cast("int").alias("rating")
    )


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyst scores: error events, latest per narrative wins."""
    return table(spark, sf_dir, "events").filter("event_type = 'error'").select(
        (F.col("user_id") % 50).alias("narrative_id"), F.least(F.lit(100.0), F.col("value")).alias("score"),
        F.lit("High").alias("confidence"), F.concat(F.lit("event "), F.col("event_id")).alias("reasoning"),
        F.struct("ts", "event_id").alias("at"),
    )


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False-positive marks: purchase events; some of them name another entity."""
    moved = F.when(F.col("user_id") % 4 == 0, "Tiontion").when(F.col("user_id") % 4 == 1, "None")
    return table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(
        F.col("event_id").cast("string").alias("post_id"), (F.col("user_id") % 50).alias("narrative_id"),
        moved.alias("entity"), F.col("ts").alias("at"),
    )


def named_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entity seed table of the size of ``customer``: names with pipe-separated aliases."""
    key = F.col("c_custkey").cast("string")
    aliases = F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" "), key, F.lit("||c"), key, F.lit("|C-"), key)
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), key).alias("entity_id"), F.col("c_name").alias("canonical_name"),
        aliases.alias("aliases"), F.col("c_custkey").alias("entity_pos"),
    )


def named_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), key).alias("entity_id"), F.concat(F.lit("$C"), key).alias("alias"),
        F.lit(0).alias("pos"),
    )


def entities(spark: SparkSession) -> DataFrame:
    rows = [(*row, i) for i, row in enumerate(seeds.DRIVER_ENTITIES)]
    return lookup(spark, ["entity_id", "canonical_name", "aliases", "entity_pos"], rows)


def extra_aliases(spark: SparkSession, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    source = seeds.DRIVER_EXTRA_ALIASES if aliases is None else aliases
    rows = [(e, a, i) for e, names in source.items() for i, a in enumerate(names)]
    return lookup(spark, ["entity_id", "alias", "pos"], rows)


def lexicon(spark: SparkSession) -> DataFrame:
    return lookup(spark, ["token", "valence"], seeds.DRIVER_LEXICON)
