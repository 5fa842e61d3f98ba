"""Readers: posts (JSON lines), authors and entity seeds (CSV), stored artifacts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

POSTS = T.StructType(
    [
        T.StructField("post_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("author_id", T.StringType()),
        T.StructField("likes", T.DoubleType()),
        T.StructField("shares", T.DoubleType()),
        T.StructField("comments", T.DoubleType()),
        T.StructField("views", T.DoubleType()),
    ]
)
OPTIONAL_POST_FIELDS = {
    "text_altered": T.StringType(),
    "url": T.StringType(),
    "author_name": T.StringType(),
    "followers": T.DoubleType(),
    "author_influence": T.DoubleType(),
}
AUTHORS = T.StructType(
    [T.StructField("author_id", T.StringType()), T.StructField("followers", T.DoubleType())]
)
ENTITIES = T.StructType(
    [
        T.StructField("entity_id", T.StringType()),
        T.StructField("canonical_name", T.StringType()),
        T.StructField("aliases", T.StringType()),
    ]
)
NARRATIVES = T.StructType(
    [
        T.StructField("narrative_id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("risk_score_confidence", T.StringType()),
        T.StructField("volume", T.LongType()),
        T.StructField("engagement", T.LongType()),
        T.StructField("taxonomy_labels", T.ArrayType(T.StringType())),
    ]
)
FEEDBACK = T.StructType(
    [T.StructField("narrative_id", T.LongType()), T.StructField("rating", T.IntegerType())]
)


def posts_schema(optional: list[str] | None = None) -> T.StructType:
    """The posts schema plus the optional fields that the files are known to hold."""
    extra = [T.StructField(n, OPTIONAL_POST_FIELDS[n]) for n in optional or []]
    return T.StructType(POSTS.fields + extra)


def read_posts(spark: SparkSession, path: str, optional: list[str] | None = None) -> DataFrame:
    return spark.read.schema(posts_schema(optional)).json(path)


def _with_load_order(df: DataFrame, name: str) -> DataFrame:
    # grows with the position in the file list, which is all that "first" and "last" need
    return df.withColumn(name, F.monotonically_increasing_id())


def read_authors(spark: SparkSession, path: str) -> DataFrame:
    """Authors with ``load_order``: duplicates are told apart by their place in the files."""
    return _with_load_order(spark.read.schema(AUTHORS).csv(path, header=True), "load_order")


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """Entity seeds with ``entity_pos``, their place in the file."""
    return _with_load_order(spark.read.schema(ENTITIES).csv(path, header=True), "entity_pos")


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines at ``path``; a missing path or zero-byte files give an empty table."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def with_labels(clustered: DataFrame, narratives: DataFrame) -> DataFrame:
    """Clustered posts plus the stored labels of their narrative; no labels give ``[]``."""
    def clean(labels) -> Column:
        return F.filter(F.transform(labels, F.trim), lambda v: v != "")

    stored = narratives.select(
        "narrative_id", clean(F.col("taxonomy_labels")).alias("narrative_taxonomy_labels")
    )
    return (
        clustered.drop("risk_embedding")
        .join(stored, "narrative_id", "left")
        .withColumn(
            "narrative_taxonomy_labels",
            F.coalesce("narrative_taxonomy_labels", F.array().cast("array<string>")),
        )
    )


def load_artifacts(spark: SparkSession, directory: str, schema: T.StructType | None = None) -> DataFrame | None:
    """Stored clustered posts with their labels, or ``None`` when there is nothing to serve.

    ``schema`` is that of the stored posts (``sinks.stored_posts``); without it a scan of the files has to infer it.
    """
    try:
        reader = spark.read if schema is None else spark.read.schema(schema)
        clustered = reader.json(f"{directory}/clustered_posts")
        narratives = spark.read.schema(NARRATIVES).json(f"{directory}/narratives")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise
    if "narrative_id" not in clustered.columns or narratives.isEmpty():
        return None
    return with_labels(clustered, narratives)


def artifact_manifest(spark: SparkSession, directory: str) -> DataFrame:
    """(path, length, modified) of every stored file; file contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
        .select("path", "length", F.col("modificationTime").alias("modified"))
    )


def artifact_signature(spark: SparkSession, directory: str) -> DataFrame:
    """One row that changes whenever a stored file does."""
    return artifact_manifest(spark, directory).agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
        F.max("modified").alias("newest"),
    )
