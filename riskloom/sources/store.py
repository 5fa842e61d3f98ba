"""Stage tables as Parquet folders per entity: an entity's rows are replaced and read without touching the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from riskloom.sources.sinks import stored_posts

PARTITION = "entity_key"


def entity_key(entity_id) -> Column:
    """Folder of an entity. The prefix keeps numeric ids strings, and null and blank ids apart."""
    column = F.col(entity_id) if isinstance(entity_id, str) else entity_id
    return F.coalesce(F.concat(F.lit("id:"), column), F.lit("none"))


def write_by_entity(df: DataFrame, path: str) -> None:
    """Replaces the folders of the entities that ``df`` holds; other entities stay as they are."""
    (
        df.withColumn(PARTITION, entity_key("entity_id"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PARTITION).parquet(path)
    )


def read_by_entity(spark: SparkSession, path: str, schema: T.StructType | None = None, entity_id: str | None = None) -> DataFrame:
    """The stored rows, of one entity if ``entity_id`` is given: only its folder is read."""
    reader = spark.read if schema is None else spark.read.schema(T.StructType([*schema.fields, T.StructField(PARTITION, T.StringType())]))
    rows = reader.parquet(path)
    if entity_id is not None:
        rows = rows.filter(F.col(PARTITION) == f"id:{entity_id}")
    return rows.drop(PARTITION)


def save(clustered: DataFrame, narratives: DataFrame, directory: str) -> None:
    """Clustered posts without embeddings, and narratives with all their columns."""
    write_by_entity(stored_posts(clustered), f"{directory}/posts")
    write_by_entity(narratives, f"{directory}/narratives")
