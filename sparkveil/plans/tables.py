"""The tables that the registered queries read, as DataFrames and as views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, text: str) -> None:
    """Register the tables whose names occur in ``text``; a view costs nothing until it is read."""
    words = set(text.replace("(", " ").replace(")", " ").replace(",", " ").replace(".", " ").split())
    for name in TABLES:
        if name in words:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
