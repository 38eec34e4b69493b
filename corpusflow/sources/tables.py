"""Table scans (A11-A13): parquet reads with column pruning left to Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Read ``{base}/{name}.parquet``; ``base`` may be a local or cluster path."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def register_views(spark: SparkSession, base: str, names=TABLES) -> None:
    for n in names:
        read_table(spark, base, n).createOrReplaceTempView(n)
