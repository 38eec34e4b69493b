"""Connected components of an edge table, by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import stored


def _print(edges: DataFrame) -> tuple:
    """Size and order-free checksum of an edge table."""
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(h)).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``a, b`` (integers) to ``id, component``: the smallest id reachable. Ids without an edge are absent.

    Every round is two aggregations and joins over the edges, which are written
    to the shared folder between rounds; the number of rounds grows with the
    logarithm of the longest path. Null ends are ignored. Hot vertices are
    pre-aggregated to their minimum before the shuffle, and the joins back may
    be split by Spark, being plain equi-joins.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stored(e, "edges")
    seen = _print(e)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        # large star: larger neighbours hang on the smallest
        large = both.join(low, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        # small star: smaller neighbours and the vertex itself hang on the smallest
        small = large.join(low, F.col("u") == F.col("w")).select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e = stored(small.where("u <> v").distinct(), "edges")
        now = _print(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    leaves = e.groupBy("u").agg(F.min("v").alias("v"))
    return leaves.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        leaves.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
