"""Embedding of text columns.

``Embedder`` is the plug-in surface: ``dimension`` plus ``embed(list[str]) ->
float matrix``. Model-backed embedders run in an iterator pandas UDF so the
model loads once per Python worker and sees Arrow batches. The default
``HashEmbedder`` needs no model: a deterministic hashed bag of words that is
also a pure JVM expression (and reproducible in SQL):

  lower-case; split on runs of non letter/digit; bucket = first 8 hex digits
  of md5(word) as an integer, mod d; count per bucket; L2-normalise (float64).
"""

from __future__ import annotations

import hashlib
import re
from typing import Iterator, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.operators.chunking import chunk_text

WORD_SPLIT = r"[^\p{L}\p{N}]+"


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray:  # (n, dimension) float
        ...


class HashEmbedder:
    """Deterministic hashed bag-of-words embedder (default; no model needed)."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    # JVM path -------------------------------------------------------------
    def buckets(self, text: Column) -> Column:
        words = F.filter(F.split(F.lower(text), WORD_SPLIT), lambda w: F.length(w) > 0)
        return F.transform(words, lambda w: F.pmod(
            F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(self.dimension)).cast("int"))

    def column(self, text: Column) -> Column:
        """The JVM cuts the words; a word is hashed once per batch of rows, and
        counting and normalising are vectorised numpy steps."""
        # bytes, not strings: a text need not be valid UTF-8
        return _count_udf(self.dimension)(F.split(F.lower(text), WORD_SPLIT).cast("array<binary>"))

    # Python path (brute-force checks, custom pipelines) ---------------------
    _split = re.compile(r"[^\w]+|_+")

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for i, t in enumerate(texts):
            for w in self._split.split(t.lower()):
                if w:
                    h = int(hashlib.md5(w.encode("utf-8")).hexdigest()[:8], 16)
                    out[i, h % self.dimension] += 1.0
        n = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, n, out=out, where=n > 0)


def _count_udf(dim: int):
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def counts_to_vec(words: pa.Array) -> pa.Array:
        n = len(words)
        of = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
        # a batch repeats its words: only distinct ones are hashed; before and after a text's words may stand an empty one
        coded = words.flatten().dictionary_encode()
        places = [int(hashlib.md5(w).hexdigest()[:8], 16) % dim if w else -1 for w in coded.dictionary.to_pylist()]
        bucket = np.array(places, dtype=np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        some = bucket >= 0
        v = np.bincount(of[some] * dim + bucket[some], minlength=n * dim).astype(np.float64).reshape(n, dim)
        norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
        v = np.divide(v, norm, out=v, where=norm > 0)
        offsets = np.arange(n + 1, dtype=np.int32) * dim
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.ravel()), mask=words.is_null())

    return counts_to_vec


def _model_udf(embedder: Embedder):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed_batches(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = embedder  # loaded once per worker; heavy models load lazily here
        if hasattr(model, "load"):
            model.load()
        for s in it:
            mat = np.asarray(model.embed(s.fillna("").tolist()), dtype=np.float64)
            yield pd.Series(list(mat))

    return embed_batches


def embed_column(text: Column, embedder: Embedder | None = None) -> Column:
    """``array<double>`` embedding of a text column."""
    embedder = embedder or HashEmbedder()
    if hasattr(embedder, "column"):
        return embedder.column(text)
    return _model_udf(embedder)(text)


def first_chunk(text: Column, width: int = 500, method: str = "exact") -> Column:
    """The first chunk of a text (the whole text when it fits one chunk)."""
    return F.element_at(chunk_text(text, width, method), 1)


def embed(df: DataFrame, text_col: str, out_col: str = "embedding", embedder: Embedder | None = None) -> DataFrame:
    """D3/D4 on a DataFrame: adds ``out_col``; the text is materialised first."""
    return df.withColumn(out_col, embed_column(F.col(text_col), embedder))


def embed_first_chunk(df: DataFrame, text_col: str, out_col: str = "embedding",
                      embedder: Embedder | None = None, width: int = 500, method: str = "exact") -> DataFrame:
    """Chat paths embed only the first chunk of the query text."""
    tmp = f"_{out_col}_first"
    return embed(df.withColumn(tmp, F.coalesce(first_chunk(F.col(text_col), width, method), F.lit(""))),
                 tmp, out_col, embedder).drop(tmp)
