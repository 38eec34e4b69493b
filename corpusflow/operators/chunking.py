"""Fixed-width greedy chunking of documents.

Two interchangeable implementations of the same rule (greedy fill to
``width`` characters, words never broken, lines break at whitespace and after
a hyphen between letters, blank chunks dropped):

* ``exact``  - an Arrow-batched pandas UDF around the stdlib wrapper; the
  semantic definition, including tab expansion and em-dash breaks.
* ``native`` - a JVM expression: split at break points, then an ``aggregate``
  fold over piece offsets. No Python worker. It treats a tab as one space and
  does not split at ``--``; use ``exact`` for text that has those.

Both are map-only (no shuffle); a document is chunked inside one task.
"""

from __future__ import annotations

import textwrap

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.text import has_text

_L = r"[\p{L}\p{Nl}\p{No}_]"  # a letter in the wrapper's sense: word char, not a digit
# Break points: before a word that follows a space, and after a hyphen that sits
# between letters (two letters, or letter-hyphen-letter, before it; letter,
# optional hyphen, letter after it).
_BREAK = r"(?<= )(?=[^ ])|(?<=(?:" + _L + "{2}|" + _L + "-" + _L + ")-)(?=" + _L + "-?" + _L + ")"


def _wrap_udf(width: int):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def wrap(texts: pd.Series) -> pd.Series:
        w = textwrap.TextWrapper(width=width, break_long_words=False)

        def one(t):
            if t is None:
                return None
            return [c for c in w.wrap(t) if c.strip()]

        return texts.map(one)

    return wrap


def chunk_exact(text: Column, width: int = 500) -> Column:
    return _wrap_udf(width)(text)


def _bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body (and its lambdas) use it."""
    return F.transform(F.array(value), body)[0]


def chunk_native(text: Column, width: int = 500) -> Column:
    t = F.regexp_replace(text, r"[\t\n\x{0B}\f\r]", " ")
    # an expression inside a lambda is computed again for every element, so the pieces are bound
    return _bound(F.split(t, _BREAK), lambda pieces: _lines(pieces, width))


def _lines(pieces: Column, width: int) -> Column:
    W = F.lit(width)
    zero = F.lit(0)
    # place of the next piece (number, character), and the open line: first and end piece, first character, or -1
    init = F.struct(zero.alias("i"), zero.alias("pos"), F.lit(-1).alias("ls"), F.lit(-1).alias("a"), F.lit(-1).alias("b"),
                    F.array().cast("array<struct<a:int,b:int>>").alias("done"))

    def step(acc, p):
        plen = F.length(p)
        wlen = F.length(F.rtrim(p))
        i, ws, we = acc["i"], acc["pos"], acc["pos"] + wlen
        first = F.size(acc["done"]) == 0
        opened = acc["ls"] >= 0

        def state(ls, a, b, done):
            return F.struct((i + 1).alias("i"), (ws + plen).alias("pos"), ls.alias("ls"), a.alias("a"), b.alias("b"), done.alias("done"))

        # start of a fresh line: offset 0 on the first line (leading blanks
        # are kept there), else the word's own start; an over-long first word
        # after leading blanks stands alone.
        lead = first & (we <= W)
        keep = state(acc["ls"], acc["a"], acc["b"], acc["done"])
        extend = state(acc["ls"], acc["a"], i + 1, acc["done"])
        open_ = state(F.when(lead, zero).otherwise(ws), F.when(lead, zero).otherwise(i), i + 1, acc["done"])
        close_open = state(ws, i, i + 1, F.array_append(acc["done"], F.struct(acc["a"].alias("a"), acc["b"].alias("b"))))
        return (F.when(wlen == 0, keep)
                .when(~opened, open_)
                .when(we - acc["ls"] <= W, extend)
                .otherwise(close_open))

    def finish(acc):
        done = F.when(acc["ls"] >= 0, F.array_append(acc["done"], F.struct(acc["a"].alias("a"), acc["b"].alias("b")))).otherwise(acc["done"])
        # a line's last piece holds a word; the blanks after it belong to no line
        return F.transform(done, lambda r: F.rtrim(F.array_join(F.slice(pieces, r["a"] + 1, r["b"] - r["a"]), "")))

    lines = F.aggregate(pieces, init, step, finish)
    return F.filter(lines, lambda c: has_text(c))


def chunk_text(text: Column, width: int = 500, method: str = "exact") -> Column:
    """``array<string>`` of chunks for a text column (D1 + C3)."""
    if method == "exact":
        return chunk_exact(text, width)
    if method == "native":
        return chunk_native(text, width)
    raise ValueError(f"unknown chunk method {method!r}")


def explode_chunks(df: DataFrame, chunks_col: str = "chunks") -> DataFrame:
    """One row per chunk with ``chunk_index`` and the per-document ``chunk_total``.

    The total is ``size(array)`` carried on each row, so no window is needed.
    The outer form plus a filter keeps Catalyst from inferring
    ``size(chunks) > 0`` and pushing a second evaluation of the chunker below
    an earlier repartition.
    """
    others = [c for c in df.columns if c != chunks_col]
    return (df.select(*others, F.size(chunks_col).alias("chunk_total"),
                      F.posexplode_outer(chunks_col).alias("chunk_index", "chunk"))
            .filter(F.col("chunk_index").isNotNull())
            .withColumn("chunk_index", F.col("chunk_index").cast("int")))


def chunk_documents(docs: DataFrame, text_col: str = "text", width: int = 500, method: str = "exact") -> DataFrame:
    """Documents → one row per chunk."""
    return explode_chunks(docs.withColumn("chunks", chunk_text(F.col(text_col), width, method)).drop(text_col))


def chunk_stats(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document chunk count and the first 100 characters of its first chunk."""
    return chunks.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.min_by(F.substring("chunk", 1, 100), "chunk_index").alias("preview"),
        F.max(F.length("chunk")).alias("max_len"),
        F.sum(F.length("chunk")).alias("total_len"))
