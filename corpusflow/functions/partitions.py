"""Partition helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def parallelism(spark) -> int:
    """Cores available to the job (falls back to the shuffle width without a SparkContext)."""
    try:
        return int(spark.sparkContext.defaultParallelism)
    except Exception:  # noqa: BLE001 - Spark Connect
        return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spread(df: DataFrame, min_tasks: int | None = None) -> DataFrame:
    """Round-robin a DataFrame only when its scan gives fewer tasks than cores.

    CPU-heavy map stages (chunking, embedding, extraction) otherwise run in
    one task per unsplittable file. On a cluster the scan already yields
    thousands of splits and this is a no-op, so no text is shuffled there.
    """
    spark = df.sparkSession
    want = min_tasks or parallelism(spark)
    try:
        have = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD view (Spark Connect): leave as is
        return df
    return df.repartition(want) if have < want else df
