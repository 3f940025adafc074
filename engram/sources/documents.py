"""Memories from other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of memories before extraction: English texts in main, others in a database of their language."""
    lab = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = documents.join(lab, "doc_id", "left")
    importance = F.when(F.col("quality").isNull(), F.lit(0.5)).otherwise(F.lit(0.2) + F.lit(0.6) * F.col("quality") - F.lit(0.1) * F.col("toxic"))
    at = F.lit(1704067200000) + F.col("doc_id") * 60000
    return rows.select(
        F.when(F.col("lang") == "en", "main").otherwise(F.col("lang")).alias("db"),
        (F.col("doc_id") + 1).alias("id"),
        at.alias("created_at"),
        at.alias("updated_at"),
        importance.cast("float").alias("importance"),
        F.col("text").alias("content"),
        "source",
        F.array("lang", "source").alias("tags"),
    )


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
