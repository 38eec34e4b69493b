"""Registered ingest queries: file types, routing, decoding, validation, paged text,
and collection checks (B2, C6, C15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.config import DEFAULT
from corpusflow.operators import index
from corpusflow.plans import retrieval
from corpusflow.plans.retrieval import _prep
from corpusflow.sources import files
from corpusflow.sources.tables import read_table

# --- fixed values: extensions given to synthetic file names (doc_id mod 21; the
# 21st form is a leading-dot name without extension) ------------------------
NAME_EXTS = [".txt", ".md", ".xml", ".csv", ".pdf", ".docx", ".doc", ".png", ".jpg", ".jpeg",
             ".avi", ".mp4", ".mov", ".mpeg", ".TXT", ".tar.gz", "", ".", ".zip", ".Md"]


def named_documents(spark, base) -> DataFrame:
    _prep(spark)
    d = read_table(spark, base, "documents").select("doc_id", "text")
    i = F.pmod(F.col("doc_id"), F.lit(len(NAME_EXTS) + 1))
    ext = F.element_at(F.array(*[F.lit(e) for e in NAME_EXTS]), (i + 1).cast("int"))
    name = F.when(i == len(NAME_EXTS), F.concat(F.lit(".doc_"), F.col("doc_id").cast("string"))).otherwise(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), ext))
    return d.withColumn("filename", name)


def file_type_derivation(spark, base):
    """A2: suffix and stored file type of every file name."""
    d = named_documents(spark, base)
    return d.select("doc_id", "filename", files.file_suffix(F.col("filename")).alias("suffix"),
                    files.file_type(F.col("filename")).alias("file_type"))


def format_dispatch_counts(spark, base):
    """A3: files per extractor, unsupported ones counted apart."""
    good, bad = files.route(named_documents(spark, base).select("doc_id", "filename"))
    return (good.select("extractor").unionByName(bad.select(F.lit("unsupported").alias("extractor")))
            .groupBy("extractor").agg(F.count(F.lit(1)).alias("n")))


def unsupported_rejects(spark, base):
    """A10: files whose type has no extractor, with the reason."""
    _, bad = files.route(named_documents(spark, base).select("doc_id", "filename"))
    return bad.select("doc_id", "filename", "file_type", "reason")


def text_newline_normalise(spark, base):
    """A4: documents stored as bytes with CRLF (even ids) or CR (odd ids) line ends decode back."""
    _prep(spark)
    d = read_table(spark, base, "documents").select("doc_id", "text")
    eol = F.when(F.col("doc_id") % 2 == 0, F.lit("\r\n")).otherwise(F.lit("\r"))
    raw = d.withColumn("content", F.encode(F.replace(F.col("text"), F.lit("\n"), eol), "UTF-8"))
    dec = raw.withColumn("decoded", files.decode_text(F.col("content")))
    return dec.select("doc_id", F.length("decoded").alias("n_chars"), (F.col("decoded") == F.col("text")).alias("same"))


def empty_blank_rejects(spark, base):
    """Status of every document plus hand-written edge rows."""
    _prep(spark)
    d = read_table(spark, base, "documents").select("doc_id", "text")
    edge = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n "), (-4, "\u00a0"), (-5, " x")],
                                 "doc_id long, text string")
    return d.unionByName(edge).select("doc_id", files.text_status(F.col("text")).alias("status"))


def paged_text_concat(spark, base):
    """A7 + H7: conversations as paged files (conversation = file, turn = page)."""
    _prep(spark)
    p = read_table(spark, base, "conversations")
    return files.paged_text(p, "conv_id", "turn", "text")


def count_match_check(spark, base):
    """Per document, chunk and embedding counts agree."""
    ch = retrieval.embedded_chunks(spark, base)
    return index.count_match(ch, "doc_id", "embedding")


def dimension_check(spark, base):
    """Vector count and dimensions present in the collection against the expected 64."""
    _prep(spark)
    p = index.dimension_profile(read_table(spark, base, "embeddings"))
    return p.withColumn("matches", (F.col("min_dim") == DEFAULT.embed_dim) & (F.col("max_dim") == DEFAULT.embed_dim))


def insert_if_absent(spark, base):
    """B2/F8: existing = ids up to 2/3 of the id range; a second version of ids from 1/3 up
    (sent twice) is added; only ids not stored yet are appended. Returns the final collection."""
    _prep(spark)
    e = read_table(spark, base, "embeddings").select("vec_id", "label")
    top = e.agg(F.max("vec_id")).collect()[0][0]  # one scalar
    lo, hi = top // 3, 2 * top // 3
    existing = e.filter(F.col("vec_id") <= hi)
    second = e.filter(F.col("vec_id") >= lo).withColumn("label", F.col("label") + 100)
    new = second.withColumn("version", F.lit(2)).unionByName(second.withColumn("version", F.lit(3)))
    fresh = index.insert_if_absent(new, existing, "vec_id", "version").drop("version")
    return existing.unionByName(fresh)


def request_defaults(spark, base):
    """Benchmark texts as JSON request bodies (n_results missing, null or given)."""
    _prep(spark)
    b = read_table(spark, base, "benchmark").select("item_id", "text")
    n = F.col("item_id") % 3
    body = (F.when(n == 0, F.to_json(F.struct(F.col("text").alias("query"))))
            .when(n == 1, F.to_json(F.struct(F.col("text").alias("query"),
                                             F.lit(None).cast("int").alias("n_results")), {"ignoreNullFields": "false"}))
            .otherwise(F.to_json(F.struct(F.col("text").alias("query"),
                                          (F.col("item_id") % 60).cast("int").alias("n_results")))))
    r = files.requests_from_json(b.select("item_id", body.alias("value")), "value", DEFAULT.default_n_results)
    return r.select("item_id", F.length("query").alias("query_len"), "n_results")
