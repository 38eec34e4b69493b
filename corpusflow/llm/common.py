"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    Only where it is unset, and only on a ``local[...]`` master (tests), a
    fresh temporary folder is set instead; on a cluster that is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        d = tempfile.mkdtemp(prefix="corpusflow-shared-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back.

    Cuts the lineage: later jobs, and tasks re-run after a lost executor, read
    the files and repeat nothing. What the write shuffled goes when it ends, not
    when the driver next collects garbage. The folder is the run's scratch space and
    whoever owns ``spark.checkpoint.dir`` empties it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # holds for the write's own plan, which nothing else runs
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def crc_part(doc_id, modulus: int):
    """crc32 of the id written as text, modulo ``modulus`` (null id: the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def by_frame(fn: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``mapInPandas`` body that applies ``fn`` to every non-empty batch."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                yield fn(pdf)

    return run
