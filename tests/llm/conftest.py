import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

LONG = "alpha beta gamma delta " * 30_000

#: Null and odd values in every column, repeated rows, and extra columns whose names the operators use.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs to the river", "en", "b", 5),
    (1, "The quick brown fox jumps over the lazy dog and runs to the river", "en", "b", 5),
    (2, "the QUICK brown fox jumps over the lazy dog and runs to the river", "en", "a", 5),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, " \n\t ", "en", None, 4),
    (6, "one two", "en", "c", 7),
    (7, "one two", "en", "c", 7),
    (8, LONG, "en", "b", len(LONG)),
    (9, "ünï cödé — password: hunter22x and ßtraße İstanbul", "de", "", 3),
    (None, "no id here at all but some words", "en", "a", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ROWS, SCHEMA)
    for c in ("id", "key", "size", "kept", "n_words", "score", "sketch", "spans", "_row", "y", "word", "a", "b"):
        docs = docs.withColumn(c, F.lit("clash"))
    return docs


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
