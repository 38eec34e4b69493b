"""Reserved id ranges and commits of several tables, one small file per batch.

``reserve`` gives a batch the ids after those of the batches before it, and the
same range again when the batch is replayed. ``write_batch`` writes the rows of a
batch to several tables and then its commit file; readers take only committed
batches, so a batch is seen in all its tables or in none, once.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from corpusflow.sources import storage


def _file(folder: str, batch: int) -> str:
    return f"{folder.rstrip('/')}/{batch:012d}.json"


def entries(spark: SparkSession, folder: str) -> list[int]:
    return [int(n[:-5]) for n in storage.names(spark, folder) if n.endswith(".json")]


def reserve(spark: SparkSession, folder: str, batch: int, n: int, start: int = 0) -> int:
    """The id before the first of ``batch``'s ``n`` ids; ids of batch 0 come after ``start``.

    Batches reserve in order (a stream's do). A replay with another number of rows is an error.
    """
    known = storage.read_text(spark, _file(folder, batch))
    if known is None:
        before = [b for b in entries(spark, folder) if b < batch]
        last = json.loads(storage.read_text(spark, _file(folder, max(before)))) if before else {"after": start, "n": 0}
        if storage.create_text(spark, _file(folder, batch), json.dumps({"after": last["after"] + last["n"], "n": n})):
            return last["after"] + last["n"]
        known = storage.read_text(spark, _file(folder, batch))  # another attempt of this batch was faster
    entry = json.loads(known)
    if entry["n"] != n:
        raise ValueError(f"batch {batch} had {entry['n']} rows when its ids were reserved, and has {n} now")
    return entry["after"]


def committed(spark: SparkSession, root: str) -> list[int]:
    return sorted(entries(spark, f"{root}/_commits"))


def write_batch(spark: SparkSession, root: str, batch: int, tables: dict[str, DataFrame]) -> bool:
    """Write every table's rows of ``batch``, then commit it; False (and nothing written) where it is committed."""
    if batch in committed(spark, root):
        return False
    for name, rows in tables.items():
        # what a failed attempt left is replaced
        rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")
    return storage.create_text(spark, _file(f"{root}/_commits", batch), json.dumps(sorted(tables)))


def read_table(spark: SparkSession, root: str, name: str, schema: str, before: int | None = None) -> DataFrame:
    """The committed rows of a table, or those of the batches before one."""
    batches = [b for b in committed(spark, root) if before is None or b < before]
    paths = [f"{root}/{name}/batch={b}" for b in batches if name in json.loads(storage.read_text(spark, _file(f"{root}/_commits", b)))]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
