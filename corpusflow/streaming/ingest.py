"""L1-L3: Structured Streaming forms of ingestion, the query log and search.

Every stream is stateless up to its sink; the sink is a ``foreachBatch``
that is idempotent per batch id, so a restarted query (checkpoint in the
shared ``spark.checkpoint.dir``) neither loses nor duplicates rows:

* L1 ingest appends index rows with insert-if-absent on ``id`` (B2).
* L2 the query log writes each batch under ``batch=<id>`` with overwrite, so
  a replayed batch rewrites the same folder.
* L3 search runs the batch k-NN against a static index inside
  ``foreachBatch`` (ranking windows are not allowed on streams).
"""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.config import DEFAULT, Settings
from corpusflow.functions.text import clamp, default
from corpusflow.operators import chunking, collection, embedding, history, index, search
from corpusflow.session import checkpoint_dir, materialize, ship_package
from corpusflow.streaming import ledger


def stream_root(spark: SparkSession, name: str) -> str:
    """A fresh folder for a stream's sink and checkpoint inside the shared checkpoint dir."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def ingest_batch(docs: DataFrame, text_col: str = "text", filename_col: str = "filename",
                 file_type_col: str = "file_type", embedder=None, settings: Settings = DEFAULT) -> DataFrame:
    """D1-D3, E1-E5 on a (micro-)batch of documents: the index rows to add."""
    ch = chunking.chunk_documents(docs, text_col, settings.chunk_width)
    ch = ch.withColumn("embedding", embedding.embed_column(F.col("chunk"), embedder))
    return index.index_rows(ch, filename_col, file_type_col, "embedding", settings)


def start_ingest(docs_stream: DataFrame, collection_path: str, checkpoint_location: str,
                 available_now: bool = True, settings: Settings = DEFAULT, **kw):
    """L1: stream documents into the collection (insert-if-absent per micro-batch)."""
    spark = docs_stream.sparkSession
    ship_package(spark)
    rows = ingest_batch(docs_stream, settings=settings, **kw)

    def sink(batch: DataFrame, batch_id: int) -> None:
        index.add_to_collection(batch, collection_path, settings)

    w = rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def start_collection_ingest(docs_stream: DataFrame, path: str, checkpoint_location: str, model: str = "hash",
                            available_now: bool = True, settings: Settings = DEFAULT, embedder=None, **kw):
    """L1 into a stored collection: every micro-batch is an append, and so a version.

    A batch reads the Bloom filters of its ids' buckets, not the stored ids, and
    its vectors go into the existing cells. A replayed batch finds its ids stored
    and makes no version.
    """
    spark = docs_stream.sparkSession
    ship_package(spark)
    collection.create(spark, path, (embedder or embedding.HashEmbedder(settings.embed_dim)).dimension, model)
    rows = ingest_batch(docs_stream, settings=settings, embedder=embedder, **kw)

    def sink(batch: DataFrame, batch_id: int) -> None:
        collection.append(batch.sparkSession, path, batch, settings)

    w = rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def start_query_log(requests_stream: DataFrame, log_path: str, checkpoint_location: str,
                    query_col: str = "query", requested_col: str = "n_results", available_now: bool = True):
    """L2: continuous log of requests as they arrive, before any search (``start_logged_search`` logs searches)."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(F.col(query_col).alias("query"), F.col(requested_col).cast("int").alias("num_results"),
                            F.current_timestamp().alias("timestamp"))
        rows = rows.withColumn("batch_id", F.lit(batch_id).cast("long"))
        rows.write.mode("overwrite").parquet(os.path.join(log_path, f"batch={batch_id}"))

    w = requests_stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def start_search(requests_stream: DataFrame, idx: search.IvfIndex, out_path: str, checkpoint_location: str,
                 k: int = 10, query_id: str = "query_id", text_col: str = "query", embedder=None,
                 available_now: bool = True):
    """L3: each micro-batch of text requests is embedded and searched against a static index."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        q = batch.select(F.col(query_id).alias("query_id"),
                         embedding.embed_column(F.col(text_col), embedder).alias("embedding"))
        hits = search.search(idx, q, k).withColumn("batch_id", F.lit(batch_id).cast("long"))
        hits.write.mode("overwrite").parquet(os.path.join(out_path, f"batch={batch_id}"))

    w = requests_stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


LOG = "id long, query string, num_results int, effective_k int, returned int, query_response_time double, timestamp timestamp"
HITS = "query_id long, rank long, id string, distance double"


def start_logged_search(requests_stream: DataFrame, idx: search.IvfIndex, root: str, checkpoint_location: str,
                        query_id: str = "query_id", text_col: str = "query", requested_col: str = "n_results", embedder=None,
                        available_now: bool = True, settings: Settings = DEFAULT):
    """L2 + L3: each micro-batch is searched (k = the request's limit, clamped) and logged, in one commit.

    Log rows have dense ids over the whole stream, in order of batch and request,
    the requested, effective and returned number of hits, and the seconds from the
    batch's start until its hits were there, shared by its requests. A replayed
    batch keeps its ids and writes nothing. Read with ``ledger.read_table`` (tables
    ``log`` and ``hits``). Requests have distinct, non-null ids.
    """
    ship_package(requests_stream.sparkSession)

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id in ledger.committed(spark, root):
            return
        started = time.monotonic()
        k = clamp(default(F.col(requested_col), settings.default_n_results), settings.k_min, settings.k_max)
        q = materialize(batch.select(F.col(query_id).alias("query_id"), F.col(text_col).alias("query"),
                                     default(F.col(requested_col), settings.default_n_results).cast("int").alias("requested"), k.cast("int").alias("k")))
        asked = q.select("query_id", embedding.embed_column(F.col("query"), embedder).alias("embedding"), "k")
        hits = materialize(search.search(idx, asked, F.col("k")))
        got = hits.groupBy("query_id").agg(F.count("*").alias("returned"))
        seconds = time.monotonic() - started
        after = ledger.reserve(spark, f"{root}/_log_ids", batch_id, q.count())
        rows = q.join(got, "query_id", "left").withColumns({"returned": F.coalesce("returned", F.lit(0)), "seconds": F.lit(seconds)})
        log = history.query_log_rows(rows, "query", "requested", "returned", "seconds", after, ["query_id"], settings)
        log = log.select(*(F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(LOG)))
        ledger.write_batch(spark, root, batch_id, {"log": log, "hits": hits})

    w = requests_stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def files_to_documents(files_df: DataFrame, extractors: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """A1-A4, A10, C1/C2 on a batch of ``binaryFile`` rows: (documents, rejects).

    documents: ``filename, file_type, text``; rejects: ``filename, file_type, reason``.
    """
    from corpusflow.sources import extract, files

    good, unsupported = files.route(files_df)
    ex = extract.extract(good.select("filename", "file_type", "extractor", "content"), extractors,
                         key_cols=["filename", "file_type", "extractor"])
    ok, failed = extract.split_extracted(ex)
    docs, blank = files.split_valid(ok, "text")
    rejects = (unsupported.select("filename", "file_type", "reason")
               .unionByName(failed.select("filename", "file_type", "reason"))
               .unionByName(blank.select("filename", "file_type", "reason")))
    return docs.select("filename", "file_type", "text"), rejects


def start_file_ingest(spark: SparkSession, folder: str, collection_path: str, rejects_path: str,
                      checkpoint_location: str, available_now: bool = True, extractors: dict | None = None,
                      settings: Settings = DEFAULT):
    """L1 over files: new files in ``folder`` are routed, extracted, validated, chunked,
    embedded and added (insert-if-absent); rejects are written per batch id."""
    ship_package(spark)
    schema = "path string, modificationTime timestamp, length long, content binary"  # the binaryFile schema
    stream = (spark.readStream.format("binaryFile").schema(schema)
              .option("recursiveFileLookup", "true").load(folder))
    stream = stream.withColumn("filename", F.regexp_extract("path", r"([^/\\]*)$", 1))

    def sink(batch: DataFrame, batch_id: int) -> None:
        docs, rejects = files_to_documents(batch, extractors)
        rejects.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(
            os.path.join(rejects_path, f"batch={batch_id}"))
        index.add_to_collection(ingest_batch(docs, settings=settings), collection_path, settings)

    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
