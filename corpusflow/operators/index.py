"""E1-E5 index rows, B1-B3 collection writes, C5/C6/C15 checks.

The collection is a Parquet table ``(id, document, embedding, metadata,
ingested_at)`` with a one-row properties table beside it (``dimension``,
``model``). Writes are append-only and idempotent on ``id``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.config import DEFAULT, Settings

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


class CollectionDimensionError(ValueError):
    """Stored collection dimension differs from the embedder's and reset is not allowed."""


def chunk_id(source: Column, chunk_index: Column) -> Column:
    """``<filename>_<chunk_index>``."""
    return F.concat_ws("_", source, chunk_index.cast("string"))


def batch_of(chunk_index: Column, batch_size: int = 5000) -> Column:
    """Write batch number of a chunk, as a string."""
    return F.floor(chunk_index / F.lit(batch_size)).cast("long").cast("string")


def index_rows(chunks: DataFrame, source_col: str = "filename", file_type_col: str = "file_type",
               embedding_col: str = "embedding", settings: Settings = DEFAULT) -> DataFrame:
    """Collection rows from embedded chunks (``chunk``, ``chunk_index``, ``chunk_total``).

    The ingest time is one value per job (``current_timestamp`` is folded once
    per query), kept both as an ISO string in metadata and as a timestamp.
    """
    now = F.current_timestamp()
    return chunks.select(
        chunk_id(F.col(source_col), F.col("chunk_index")).alias("id"),
        F.col("chunk").alias("document"),
        F.col(embedding_col).alias("embedding"),
        F.struct(F.col(source_col).alias("source"), F.col(file_type_col).alias("file_type"),
                 F.col("chunk_index").cast("int").alias("chunk_index"),
                 F.col("chunk_total").cast("int").alias("chunk_total"),
                 batch_of(F.col("chunk_index"), settings.write_batch_size).alias("batch"),
                 F.date_format(now, ISO_FORMAT).alias("timestamp")).alias("metadata"),
        now.alias("ingested_at"))


def index_batches(rows: DataFrame) -> DataFrame:
    """Per source and batch the slice ``[start, end)`` and its size."""
    return (rows.groupBy(F.col("metadata.source").alias("source"), F.col("metadata.batch").alias("batch"))
            .agg(F.min("metadata.chunk_index").alias("start"),
                 (F.max("metadata.chunk_index") + 1).alias("end"),
                 F.count(F.lit(1)).alias("n_rows"),
                 F.first("metadata.chunk_total").alias("chunk_total")))


def reject_empty_embeddings(rows: DataFrame, embedding_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Rows with a null or empty vector go to rejects."""
    bad = F.col(embedding_col).isNull() | (F.size(embedding_col) <= 0)
    return rows.filter(~bad), rows.filter(bad).withColumn("reason", F.lit("empty_embedding"))


def count_match(chunks: DataFrame, key: str = "doc_id", embedding_col: str = "embedding") -> DataFrame:
    """Per document, chunks and embeddings must match in number."""
    return (chunks.groupBy(key)
            .agg(F.count(F.lit(1)).alias("n_chunks"),
                 F.count(F.when(F.size(embedding_col) > 0, F.lit(1))).alias("n_embeddings"))
            .withColumn("ok", F.col("n_chunks") == F.col("n_embeddings")))


def dimension_profile(collection: DataFrame, embedding_col: str = "embedding") -> DataFrame:
    """One row with the vector count and the min/max dimension present."""
    return collection.agg(F.count(F.lit(1)).alias("n_vectors"),
                          F.min(F.size(embedding_col)).alias("min_dim"),
                          F.max(F.size(embedding_col)).alias("max_dim"))


def insert_if_absent(new: DataFrame, existing: DataFrame, key: str = "id",
                     order_col: str | None = None) -> DataFrame:
    """B2/F8: rows of ``new`` whose key is not stored yet (first copy wins).

    Duplicates inside ``new`` collapse to the copy with the smallest
    ``order_col`` (else the smallest row) - a partial aggregate, so a hot key
    does not pile up in one task - then a left-anti join on the key drops ids
    already stored.
    """
    cols = new.columns
    others = [c for c in cols if c != key]
    if order_col is None:
        # the smallest row wins: deterministic, so a retried task keeps the same copy
        dedup = (new.groupBy(key).agg(F.min(F.struct(*others)).alias("r"))
                 .select(key, "r.*").select(*cols))
    else:
        dedup = (new.groupBy(key)
                 .agg(F.min_by(F.struct(*[c for c in cols if c != key]), F.col(order_col)).alias("r"))
                 .select(key, "r.*").select(*cols))
    return dedup.join(existing.select(key), key, "left_anti")


def write_collection(rows: DataFrame, path: str, settings: Settings = DEFAULT, mode: str = "append") -> int:
    """B1: append rows; return rows written. Files follow the partitions; the batch number (E1) stays a column."""
    from pyspark.sql import Observation

    obs = Observation("collection_write")
    rows.observe(obs, F.count(F.lit(1)).alias("n")).write.mode(mode).parquet(path)
    return int(obs.get.get("n", 0))


def read_if_there(spark, path: str) -> DataFrame | None:
    """The Parquet table at ``path``; None only where the path does not exist. Other errors are raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def add_to_collection(rows: DataFrame, path: str, settings: Settings = DEFAULT) -> int:
    """B2 + B1: idempotent append. Existing ids keep their stored row."""
    spark = rows.sparkSession
    existing = read_if_there(spark, path)
    if existing is None:  # first write creates the collection
        existing = spark.createDataFrame([], T.StructType([T.StructField("id", T.StringType())]))
    fresh = insert_if_absent(rows, existing, "id")
    return write_collection(fresh, path, settings, "append")


def ensure_dimension(spark, props_path: str, dimension: int, model: str, allow_reset: bool = False,
                     collection_path: str | None = None) -> str:
    """Create the properties row, or reset when the model dimension changed.

    Returns ``created``, ``ok`` or ``reset``. A mismatch without
    ``allow_reset`` raises instead of silently dropping the collection.
    """
    known = read_if_there(spark, props_path)
    stored = known.select("dimension").first() if known is not None else None
    props = spark.createDataFrame([(dimension, model)], "dimension int, model string")
    if stored is None:
        props.write.mode("overwrite").parquet(props_path)
        return "created"
    if int(stored.dimension) == dimension:
        return "ok"
    if not allow_reset:
        raise CollectionDimensionError(f"collection has dimension {stored.dimension}, embedder gives {dimension}")
    old = read_if_there(spark, collection_path) if collection_path else None
    if old is not None:
        # the empty collection keeps every column, so later appends read back whole
        spark.createDataFrame([], old.schema).write.mode("overwrite").parquet(collection_path)
    props.write.mode("overwrite").parquet(props_path)
    return "reset"
