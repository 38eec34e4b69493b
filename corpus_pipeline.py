"""Corpus pipeline: five stages over ``documents``, each written as Parquet and reread by the next.

Counted as part of the ``llm`` subpackage. A stage takes ``(spark, docs,
sf_dir)`` and returns a DataFrame; all but the last return the columns of
``documents``. Nulls, repeated rows and odd texts are handled as the operators'
docstrings say; of rows that repeat an id the second stage keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import mix_tree, odd_sketch, packing, quality_rules, secrets
from corpusflow.llm.common import load, stored
from corpusflow.session import ship_package


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that break a rule go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3 on five-word shingles: one document of each group stays, the one with the smallest id."""
    return odd_sketch.distinct_documents(docs, size=5)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: found secrets are replaced in the text; ``n_chars`` follows it."""
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: every source comes near its target; a document comes once for each pass that takes it."""
    return mix_tree.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: pieces of sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, packing.public_tokenizer())


STAGES = [
    ("quality_rules", rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("packing", pack),
]

#: SQL cannot express the tokenizer of the last stage; a brute-force version in the tests checks the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
