"""Registered streaming and extractor queries."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.config import DEFAULT
from corpusflow.functions.partitions import spread
from corpusflow.operators import collection
from corpusflow.plans import retrieval
from corpusflow.plans.retrieval import _prep
from corpusflow.sources import batches
from corpusflow.sources import paged as S_paged
from corpusflow.sources import extract as X
from corpusflow.sources import storage
from corpusflow.sources.tables import read_table
from corpusflow.streaming import ingest as L
from corpusflow.streaming import ledger


def _table_stream(spark, base, name):
    schema = read_table(spark, base, name).schema
    path = f"{base}/{name}.parquet"
    if storage.is_folder(spark, path):
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(base)


def stream_ingest(spark, base):
    """L1: documents streamed (availableNow) into a collection; a second run adds nothing."""
    _prep(spark)
    root = L.stream_root(spark, "ingest")
    docs = _table_stream(spark, base, "documents").select(
        "doc_id", "text", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        F.lit("txt").alias("file_type"))
    path = os.path.join(root, "collection")
    for run in range(2):  # the second stream has forgotten its progress: its rows are all stored already
        L.start_collection_ingest(docs, path, os.path.join(root, f"checkpoint-{run}")).awaitTermination()
    c = collection.read(spark, path)
    return c.select("id", F.col("metadata.source").alias("source"), F.col("metadata.chunk_index").alias("chunk_index"),
                    F.col("metadata.chunk_total").alias("chunk_total"), F.col("metadata.batch").alias("batch"),
                    F.length("document").alias("doc_len"))


def stream_search(spark, base):
    """L3: benchmark texts arrive as a stream and are searched against the static chunk index."""
    _prep(spark)
    root = L.stream_root(spark, "search")
    idx = retrieval._text_index(spark, base)
    req = _table_stream(spark, base, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    q = L.start_search(req, idx, os.path.join(root, "hits"), os.path.join(root, "checkpoint"),
                       k=max(min(DEFAULT.default_n_results, DEFAULT.k_max), DEFAULT.k_min))
    q.awaitTermination()
    h = spark.read.parquet(os.path.join(root, "hits"))
    return h.select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


def _docx_files(spark, base):
    d = read_table(spark, base, "documents").select("doc_id", "text")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("filename", T.StringType()),
                           T.StructField("content", T.BinaryType())])

    def build(it):
        for pdf in it:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "filename": [f"doc_{i}.docx" for i in pdf.doc_id],
                                "content": [X.make_docx(t.split("\n")) for t in pdf.text]})

    return d.mapInPandas(build, schema).withColumn("extractor", F.lit("docx"))


def docx_extract(spark, base):
    """Every document written as a Word file (bytes) and read back by the docx extractor."""
    _prep(spark)
    files = _docx_files(spark, base)
    out = X.extract(files, key_cols=["doc_id", "filename", "extractor"])
    src = read_table(spark, base, "documents").select("doc_id", F.col("text").alias("orig"))
    j = out.join(src, "doc_id")
    return j.select("doc_id", F.length("text").alias("n_chars"), (F.col("text") == F.col("orig")).alias("same"))


def csv_render(spark, base):
    """A5: each order as a small CSV file rendered to an aligned text table (rows-only check).

    The CSV bytes are built by JVM expressions; only the rendering (pandas
    parse + aligned print, the extractor's defined output) runs in Python.
    """
    _prep(spark)
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    o = spread(read_table(spark, base, "orders").select(*cols))
    body = F.concat(F.lit(",".join(cols) + "\n"), F.concat_ws(",", *[F.col(c).cast("string") for c in cols]),
                    F.lit("\n"))
    files = o.select("o_orderkey", F.encode(body, "UTF-8").alias("content"), F.lit("csv").alias("extractor"))
    out = X.extract(files, key_cols=["o_orderkey", "extractor"])
    return out.select("o_orderkey", F.size(F.split("text", "\n")).alias("n_lines"), "error")


def stream_query_log(spark, base):
    """L2: a stream of text searches, logged with ids, limits, hits and time; replayed once, which changes nothing."""
    _prep(spark)
    root = L.stream_root(spark, "log")
    idx = retrieval._text_index(spark, base)
    req = _table_stream(spark, base, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.lit(DEFAULT.default_n_results).alias("n_results"))
    for run in range(2):  # the second stream has forgotten its progress and repeats every batch
        L.start_logged_search(req, idx, os.path.join(root, "log"), os.path.join(root, f"checkpoint-{run}")).awaitTermination()
    log = ledger.read_table(spark, os.path.join(root, "log"), "log", L.LOG)
    return log.select("id", "query", "num_results", "effective_k", "returned", (F.col("query_response_time") >= 0).alias("timed"))


def turn_stream(spark, base):
    """B5 + B6 + H3 + I4: the user messages of ``conversations`` as a stream of turns, without retrieval; one replay."""
    from corpusflow.operators import prompt
    from corpusflow.streaming import turns

    _prep(spark)
    root = L.stream_root(spark, "turns")
    req = _table_stream(spark, base, "conversations").where("role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("conv_id").alias("conversation_id"), F.col("text").alias("query"))
    nothing = lambda q: q.select("query_id", F.lit(None).cast("string").alias("context"))
    for run in range(2):
        turns.start_turns(req, os.path.join(root, "turns"), os.path.join(root, f"checkpoint-{run}"), nothing, prompt.EchoGenerator()).awaitTermination()
    m = ledger.read_table(spark, os.path.join(root, "turns"), "messages", turns.MESSAGES)
    return m.select("id", "conversation_id", "role", "content", "prompt")


def batch_sink(spark, base):
    """B1: the collection's rows written in batches by the data source, and read back by its list."""
    _prep(spark)
    path = L.stream_root(spark, "batches")
    rows = retrieval.collection_rows(spark, base, batch_size=7).drop("embedding", "ingested_at")
    for _ in range(2):  # the same job again adds nothing
        batches.write_batches(rows, path, job="load")
    r = batches.read_batches(spark, path, rows.schema)
    return r.select("id", F.col("metadata.source").alias("source"), F.col("metadata.file_type").alias("file_type"),
                    F.col("metadata.chunk_index").alias("chunk_index"), F.col("metadata.chunk_total").alias("chunk_total"),
                    F.col("metadata.batch").alias("batch"), F.length("document").alias("doc_len"))


def paged_file_extract(spark, base):
    """A7 + K3: each conversation written as a paged file (turns = pages, form-feed separated),
    split back into pages by the UDTF extractor, then concatenated page by page."""
    from corpusflow.operators.prompt import ordered_join
    from corpusflow.sources import files as S

    _prep(spark)
    c = read_table(spark, base, "conversations")
    paged = c.groupBy("conv_id").agg(ordered_join(F.col("turn"), F.col("text"), "\f").alias("t"))
    files_df = paged.select("conv_id", F.encode("t", "UTF-8").alias("content"))
    pages = X.extract_pages(files_df, key="conv_id")
    return S.paged_text(pages, "conv_id", "page_no", "text")


def paged_source(spark, base):
    """A7 + K3: the same paged files, written to the shared folder and read page by page in byte ranges."""
    from corpusflow.operators.prompt import ordered_join
    from corpusflow.sources import files as S

    _prep(spark)
    root = L.stream_root(spark, "paged")
    c = read_table(spark, base, "conversations")
    paged = c.groupBy("conv_id").agg(ordered_join(F.col("turn"), F.col("text"), "\f").alias("t"))

    def write(it):
        where, folder = batches._open(root)
        where.create_dir(folder, recursive=True)
        for pdf in it:
            for i, t in zip(pdf["conv_id"], pdf["t"]):
                with where.open_output_stream(f"{folder}/{i}.txt") as out:
                    out.write(t.encode())
            yield pdf[["conv_id"]]

    paged.mapInPandas(write, "conv_id long").count()
    pages = S_paged.read_pages(spark, root, range_bytes=1000)
    pages = pages.withColumn("conv_id", F.regexp_extract("path", r"([0-9]+)\.txt$", 1).cast("long"))
    return S.paged_text(pages, "conv_id", "page_no", "text")
