import textwrap

import pytest
from hypothesis import assume, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusflow.operators.chunking import chunk_documents, chunk_stats, chunk_text

EDGE = [
    "  leading blanks then words that wrap around",
    "inner  runs   of    blanks survive inside a line",
    "tab\tseparated\twords here",
    "blank line\n\nbetween paragraphs",
    "a hyphenated well-known mother-in-law self-evident x-ray word",
    "a supercalifragilisticexpialidocious word longer than the width",
    "x" * 12,
    "y" * 13,
    "em space and nbsp joined",
    "",
    " \n ",
]


def ref(text, width):
    w = textwrap.TextWrapper(width=width, break_long_words=False)
    return [c for c in w.wrap(text) if c.strip()]


@pytest.mark.parametrize("width", [6, 12, 20])
def test_exact_matches_stdlib_on_edges(spark, width):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(EDGE)], "id int, text string")
    got = {r.id: r.c for r in df.select("id", chunk_text(F.col("text"), width, "exact").alias("c")).collect()}
    for i, t in enumerate(EDGE):
        assert got[i] == ref(t, width), t


@pytest.mark.parametrize("width", [6, 12, 20])
def test_native_matches_stdlib_without_tabs(spark, width):
    rows = [(i, t) for i, t in enumerate(EDGE) if "\t" not in t]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: r.c for r in df.select("id", chunk_text(F.col("text"), width, "native").alias("c")).collect()}
    for i, t in rows:
        assert got[i] == ref(t, width), t


def test_exact_and_native_agree_on_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a = d.select(chunk_text(F.col("text"), 500, "exact").alias("a"), chunk_text(F.col("text"), 500, "native").alias("b"))
    assert a.filter(F.col("a") != F.col("b")).count() == 0


words = st.text(alphabet="abcdé-. ", min_size=0, max_size=12)


@settings(max_examples=25, deadline=None)
@given(st.lists(words, min_size=0, max_size=30), st.integers(min_value=4, max_value=30))
def test_property_native_equals_stdlib(spark, parts, width):
    text = " ".join(parts)
    assume("--" not in text)  # em-dash breaks are handled by the exact path only
    df = spark.createDataFrame([(text,)], "text string")
    got = df.select(chunk_text(F.col("text"), width, "native").alias("c")).first().c
    assert got == ref(text, width)


def test_numbering_and_widths(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    ch = chunk_documents(d, "text", 500)
    bad = ch.filter((F.length("chunk") > 500) & F.col("chunk").contains(" "))
    assert bad.count() == 0  # only a single over-long word may exceed the width
    per_doc = ch.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("chunk_index").alias("mx"),
                                       F.first("chunk_total").alias("t"))
    assert per_doc.filter((F.col("n") != F.col("t")) | (F.col("mx") != F.col("t") - 1)).count() == 0
    st_ = chunk_stats(ch).filter(F.length("preview") > 100)
    assert st_.count() == 0


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="ab-\t .\n\u00a0", max_size=10), max_size=25), st.integers(min_value=3, max_value=25))
def test_property_exact_equals_stdlib(spark, parts, width):
    text = " ".join(parts)
    df = spark.createDataFrame([(text,)], "text string")
    got = df.select(chunk_text(F.col("text"), width, "exact").alias("c")).first().c
    assert got == ref(text, width)


def test_native_computes_the_text_and_its_pieces_once(spark):
    text = "  " + "some words of a mother-in-law, é " * 400
    df = spark.createDataFrame([(text,)], "text string").select(chunk_text(F.col("text"), 30, "native").alias("c"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # inside a lambda they would be computed for every line
    assert plan.count("regexp_replace(") == 1 and plan.count("split(") == 1
    assert df.first().c == ref(text, 30)
