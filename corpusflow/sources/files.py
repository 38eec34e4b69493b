"""File scans, type routing, decoding and rejects.

Routing is a join against a fixed 15-row extension table (a bounded
broadcast); unknown extensions and extractor failures end in a ``rejects``
DataFrame with a reason instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.text import has_text

# --- fixed values: supported extensions and the extractor each one uses ------
SUPPORTED_FORMATS = [
    ("txt", "text"), ("md", "text"), ("xml", "text"),
    ("csv", "csv"), ("pdf", "pdf"), ("docx", "docx"), ("doc", "docx"),
    ("png", "image"), ("jpg", "image"), ("jpeg", "image"),
    ("avi", "video"), ("mp4", "video"), ("mov", "video"), ("mpeg", "video"),
]


def read_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """A1: whole files as rows ``path, modificationTime, length, content`` plus ``filename``."""
    r = spark.read.format("binaryFile")
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(path)
    return df.withColumn("filename", F.regexp_extract("path", r"([^/\\]*)$", 1))


def file_suffix(filename: Column) -> Column:
    """A2: lower-cased last extension with its dot; '.' when there is none.

    Leading dots of the base name do not start an extension (``.txt`` has
    none); ``a.`` has the bare extension ``.``.
    """
    base = F.regexp_extract(filename, r"([^/\\]*)$", 1)
    ext = F.lower(F.regexp_extract(F.regexp_replace(base, r"^\.+", ""), r"(\.[^.]*)$", 1))
    return F.when(ext.startswith("."), ext).otherwise(F.concat(F.lit("."), ext))


def file_type(filename: Column) -> Column:
    """A2: the stored file type is the suffix without its dot ('' when none)."""
    return F.substring(file_suffix(filename), 2, 1 << 20)


def formats_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SUPPORTED_FORMATS, "file_type string, extractor string")


def route(files: DataFrame, filename_col: str = "filename") -> tuple[DataFrame, DataFrame]:
    """A3 + A10: attach ``file_type`` and ``extractor``; unknown types go to rejects."""
    spark = files.sparkSession
    typed = files.withColumn("file_type", file_type(F.col(filename_col)))
    fm = F.broadcast(formats_table(spark))  # 14 rows: a fixed, bounded table
    routed = typed.join(fm, "file_type", "left")
    good = routed.filter(F.col("extractor").isNotNull())
    bad = (routed.filter(F.col("extractor").isNull()).drop("extractor")
           .withColumn("reason", F.lit("unsupported")))
    return good, bad


def decode_text(content: Column) -> Column:
    """A4: strict UTF-8 decode with universal newlines; invalid bytes give null.

    (A byte-order mark is kept as U+FEFF, as a plain UTF-8 read does.)
    """
    text = F.when(F.is_valid_utf8(content), F.decode(content, "UTF-8"))
    return F.regexp_replace(text, "\r\n?", "\n")


def text_status(text: Column) -> Column:
    """``empty`` for a null or '' text, ``blank`` for whitespace only, else ``ok``."""
    return (F.when(text.isNull() | (F.length(text) == 0), F.lit("empty"))
            .when(~has_text(text), F.lit("blank"))
            .otherwise(F.lit("ok")))


def split_valid(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """C1/C2 on a documents table: (good, rejects with reason)."""
    s = docs.withColumn("_status", text_status(F.col(text_col)))
    return (s.filter(F.col("_status") == "ok").drop("_status"),
            s.filter(F.col("_status") != "ok").withColumnRenamed("_status", "reason"))


def paged_text(pages: DataFrame, key: str, page_col: str, text_col: str) -> DataFrame:
    """A7 + H7: a paged document's text: every page followed by a newline, in page order."""
    from corpusflow.operators.prompt import ordered_join

    return pages.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.concat(ordered_join(F.col(page_col), F.col(text_col), "\n"), F.lit("\n")).alias("text"))


def requests_from_json(raw: DataFrame, value_col: str = "value", default_n_results: int = 5) -> DataFrame:
    """Decode request bodies; a missing or null ``n_results`` becomes the default.

    Other columns of ``raw`` (e.g. a request key) are kept.
    """
    schema = "query string, n_results int, conversation_id long"
    keep = [c for c in raw.columns if c != value_col]
    r = raw.select(*keep, F.from_json(F.col(value_col), schema).alias("r")).select(*keep, "r.*")
    return r.withColumn("n_results", F.coalesce("n_results", F.lit(default_n_results)))
