"""Registered retrieval queries: chunk, embed, index rows, k-NN, text search.

Each function takes ``(spark, base)`` and returns a DataFrame over the whole
tables under ``base``. Column names match the SQL oracle in ``plans.oracle``.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.config import DEFAULT
from corpusflow.functions.partitions import spread
from corpusflow.functions.text import clamp, default
from corpusflow.operators import chunking, collection, embedding, index, quantised, search, vafile
from corpusflow.session import bound_batches, checkpoint_dir, ship_package
from corpusflow.sources import storage
from corpusflow.sources.tables import read_table

EMB = embedding.HashEmbedder(DEFAULT.embed_dim)


def _prep(spark: SparkSession) -> None:
    ship_package(spark)
    bound_batches(spark)
    checkpoint_dir(spark)


def doc_chunks(spark: SparkSession, base: str) -> DataFrame:
    """Chunks of every document, with the file name the index uses."""
    _prep(spark)
    docs = spread(read_table(spark, base, "documents").select("doc_id", "text"))
    ch = chunking.chunk_documents(docs, "text", DEFAULT.chunk_width)
    return ch.withColumn("filename", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))) \
             .withColumn("file_type", F.lit("txt"))


def chunk_documents(spark, base):
    return doc_chunks(spark, base).select("doc_id", "chunk_index", "chunk_total", "chunk")


def chunk_documents_native(spark, base):
    """D1 through the JVM-only greedy fold (no Python worker); same result as the exact path."""
    _prep(spark)
    docs = spread(read_table(spark, base, "documents").select("doc_id", "text"))
    ch = chunking.chunk_documents(docs, "text", DEFAULT.chunk_width, method="native")
    return ch.select("doc_id", "chunk_index", "chunk_total", "chunk")


def chunk_stats(spark, base):
    return chunking.chunk_stats(doc_chunks(spark, base), "doc_id")


def _long_form(df: DataFrame, key_cols: list[str], vec_col: str = "embedding") -> DataFrame:
    # outer form: no inferred size(vec) > 0 filter that would evaluate the embedder twice
    return (df.select(*key_cols, F.posexplode_outer(vec_col).alias("bucket", "weight"))
            .filter(F.col("weight").isNotNull() & (F.col("weight") != 0))
            .select(*key_cols, F.col("bucket").cast("int").alias("bucket"),
                    F.round("weight", 6).alias("weight")))


def hash_embed_buckets(spark, base):
    """D3 buckets: per whole document, word count per hash bucket."""
    _prep(spark)
    docs = spread(read_table(spark, base, "documents").select("doc_id", "text"))
    b = docs.select("doc_id", F.explode(EMB.buckets(F.col("text"))).alias("bucket"))
    return b.groupBy("doc_id", "bucket").agg(F.count(F.lit(1)).alias("n"))


def embedded_chunks(spark, base) -> DataFrame:
    return doc_chunks(spark, base).withColumn("embedding", embedding.embed_column(F.col("chunk"), EMB))


def hash_embed_vectors(spark, base):
    """D3 vectors: non-zero normalised weights of every chunk."""
    return _long_form(embedded_chunks(spark, base), ["doc_id", "chunk_index"])


def query_first_chunk_embed(spark, base):
    """Chat queries embed their first chunk only."""
    _prep(spark)
    q = read_table(spark, base, "benchmark").select("item_id", "text")
    e = embedding.embed_first_chunk(q, "text", "embedding", EMB, DEFAULT.chunk_width)
    return _long_form(e, ["item_id"])


def collection_rows(spark, base, batch_size: int = DEFAULT.write_batch_size) -> DataFrame:
    return index.index_rows(embedded_chunks(spark, base), "filename", "file_type", "embedding",
                            DEFAULT.with_(write_batch_size=batch_size))


def index_rows(spark, base):
    """E1-E4 (batch size 7 so that documents span several batches)."""
    r = collection_rows(spark, base, batch_size=7)
    return r.select("id", F.col("metadata.source").alias("source"), F.col("metadata.file_type").alias("file_type"),
                    F.col("metadata.chunk_index").alias("chunk_index"),
                    F.col("metadata.chunk_total").alias("chunk_total"),
                    F.col("metadata.batch").alias("batch"), F.length("document").alias("doc_len"))


def index_batches(spark, base):
    """E2 slices per source and batch (batch size 7)."""
    return index.index_batches(collection_rows(spark, base, batch_size=7))


def stored_collection(spark, base) -> str:
    """Folder of the stored chunk collection of ``base``: built by the first query of the application, opened by the others.

    The folder's name follows the files of ``documents``, so a rewritten table has a new collection.
    """
    _prep(spark)
    files = storage.fingerprint(spark, f"{base}/documents.parquet")
    name = hashlib.sha256(f"{spark.sparkContext.applicationId}|{base}|{files}".encode()).hexdigest()[:16]
    path = f"{checkpoint_dir(spark).rstrip('/')}/collection-{name}"
    v = collection.create(spark, path, DEFAULT.embed_dim, "hash")
    if not v.size:
        collection.append(spark, path, collection_rows(spark, base))
    return path


def _text_index(spark, base):
    return collection.open_index(spark, stored_collection(spark, base))


def text_search(spark, base):
    """every benchmark text embedded whole, k = clamp(default 5) = 10, over all chunks."""
    idx = _text_index(spark, base)
    q = read_table(spark, base, "benchmark").select(
        F.col("item_id").alias("query_id"), embedding.embed_column(F.col("text"), EMB).alias("embedding"),
        clamp(default(F.lit(None).cast("int"), DEFAULT.default_n_results), DEFAULT.k_min, DEFAULT.k_max).alias("k"))
    hits = search.search(idx, q, F.col("k"))
    return hits.select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


def text_search_va(spark, base):
    """F2 through the vector-approximation file: the same hits, one byte a component scanned."""
    va = vafile.build(collection.read(spark, stored_collection(spark, base)).select("id", "embedding"))
    q = read_table(spark, base, "benchmark").select(
        F.col("item_id").alias("query_id"), embedding.embed_column(F.col("text"), EMB).alias("embedding"),
        clamp(default(F.lit(None).cast("int"), DEFAULT.default_n_results), DEFAULT.k_min, DEFAULT.k_max).alias("k"))
    hits = vafile.search(va, q, F.col("k"))
    return hits.select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


def collection_appends(spark, base):
    """The chunks come in three appends, the last all of them again; then the search of ``text_search``."""
    _prep(spark)
    path = f"{checkpoint_dir(spark).rstrip('/')}/appends-{uuid.uuid4().hex}"
    collection.create(spark, path, DEFAULT.embed_dim, "hash")
    rows = collection.read(spark, stored_collection(spark, base))
    first = F.xxhash64("metadata.source") % 3 == 0
    for part in (rows.where(first), rows.where(~first), rows):
        collection.append(spark, path, part)
    q = read_table(spark, base, "benchmark").select(
        F.col("item_id").alias("query_id"), embedding.embed_column(F.col("text"), EMB).alias("embedding"),
        clamp(default(F.lit(None).cast("int"), DEFAULT.default_n_results), DEFAULT.k_min, DEFAULT.k_max).alias("k"))
    hits = search.search(collection.open_index(spark, path), q, F.col("k"))
    return hits.select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


def chat_hits(spark, base, k: int = DEFAULT.default_n_results) -> DataFrame:
    """first chunk of each query, k not clamped (default 5); hits carry their text."""
    idx = _text_index(spark, base)
    q = read_table(spark, base, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    q = embedding.embed_first_chunk(q, "text", "embedding", EMB, DEFAULT.chunk_width)
    return search.attach(idx, search.search(idx, q, k), ["document"], most=q.count() * k)


def chat_retrieval(spark, base):
    """F3 + I1: the context block (hits joined by newline, nearest first)."""
    from corpusflow.operators.prompt import context_block
    ctx = context_block(chat_hits(spark, base))
    return ctx.select("query_id", "n_hits", "context")


# --- the ready-made `embeddings` collection --------------------------------

def _emb(spark, base):
    _prep(spark)
    return read_table(spark, base, "embeddings")


def knn_batch(spark, base):
    """every vector of the collection queried against all of it, k = 10."""
    e = _emb(spark, base)
    idx = search.build_index(e, "vec_id", "embedding")
    hits = search.search(idx, e.withColumnRenamed("vec_id", "query_id"), 10)
    return hits.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"))


def knn_va(spark, base):
    """F4 through the vector-approximation file: every vector against the whole collection, k = 10."""
    e = _emb(spark, base)
    va = vafile.build(e, "vec_id", "embedding")
    hits = vafile.search(va, e.withColumnRenamed("vec_id", "query_id"), 10)
    return hits.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"))


def knn_quantised(spark, base):
    """F5 on the two-level quantised index, tuned for a recall of 0.9 on a sample of its rows."""
    e = _emb(spark, base)
    va = vafile.build(e, "vec_id", "embedding")
    idx = quantised.tune(quantised.build(e, "vec_id", "embedding"), lambda q, k: vafile.search(va, q, k))
    hits = quantised.search(idx, e.withColumnRenamed("vec_id", "query_id"), 10)
    return hits.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"))


def _mean_vector(e: DataFrame) -> DataFrame:
    """One-row DataFrame holding the mean vector of the collection (distributed)."""
    per_dim = e.select(F.posexplode("embedding").alias("pos", "x")).groupBy("pos").agg(
        F.avg(F.col("x").cast("double")).alias("m"))
    return per_dim.agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("v")).select(
        F.lit(0).cast("long").alias("query_id"), F.col("v.m").alias("embedding"))


def knn_single(spark, base):
    """one query (the collection's mean vector), k = 10, ascending distance."""
    e = _emb(spark, base)
    idx = search.build_index(e, "vec_id", "embedding")
    hits = search.search(idx, _mean_vector(e), 10)
    return hits.select("rank", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"))


def knn_per_row_k(spark, base):
    """F4 + C7 + C8: per-query limit from a nullable request field, clamped to 10..50."""
    e = _emb(spark, base)
    idx = search.build_index(e, "vec_id", "embedding")
    n_results = F.when(F.col("label") % 3 == 0, F.lit(None)).otherwise(F.col("label") * 7 - 10)
    q = e.select(F.col("vec_id").alias("query_id"), "embedding",
                 clamp(default(n_results, DEFAULT.default_n_results), DEFAULT.k_min, DEFAULT.k_max).alias("k"))
    hits = search.search(idx, q, F.col("k"))
    return hits.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"))


def knn_nested(spark, base):
    """per query the parallel lists, nearest first (ids rendered as one string)."""
    e = _emb(spark, base)
    idx = search.build_index(e, "vec_id", "embedding")
    hits = search.search(idx, e.withColumnRenamed("vec_id", "query_id"), 5)
    nested = search.nest_results(hits)
    return nested.select("query_id", F.array_join("ids", ",").alias("ids"), F.size("ids").alias("n"),
                         F.round(F.aggregate("distances", F.lit(0.0), lambda a, x: a + x), 6).alias("dist_sum"))


def knn_approx(spark, base):
    """approximate k-NN (no exactness pass); as many cells as a measured sample needs for a recall of 0.9."""
    e = _emb(spark, base)
    idx = search.build_index(e, "vec_id", "embedding")
    q = e.withColumnRenamed("vec_id", "query_id")
    hits = search.search(idx, q, 10, exact=False, n_probe=search.probes_for(idx, q, 10))
    return hits.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"))


def search_json(spark, base):
    """``{"data": {"ids": [...]}, "query": ...}`` response rows for text search."""
    idx = _text_index(spark, base)
    bq = read_table(spark, base, "benchmark")
    q = bq.select(F.col("item_id").alias("query_id"), embedding.embed_column(F.col("text"), EMB).alias("embedding"))
    hits = search.search(idx, q, DEFAULT.k_min)
    nested = search.nest_results(hits).join(bq.select(F.col("item_id").alias("query_id"), "text"), "query_id")
    return nested.select("query_id", F.to_json(F.struct(F.struct(F.col("ids")).alias("data"),
                                                         F.col("text").alias("query"))).alias("body"))
