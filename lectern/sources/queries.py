"""Annotated queries for evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """query_id, query, relevant from JSON lines with query and relevant_chunk_ids; blank lines and lines that start with # are skipped."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')")
    parsed = lines.select(F.from_json("value", "query string, relevant_chunk_ids array<string>").alias("q")).where("q.query is not null")
    rows = parsed.select("q.query", F.coalesce("q.relevant_chunk_ids", F.array().cast("array<string>")).alias("relevant"))
    return rows.withColumn("query_id", F.row_number().over(Window.orderBy("query")).cast("long")).select("query_id", "query", "relevant")  # a hand-made list
