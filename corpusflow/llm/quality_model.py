"""Quality classifier: boosted trees over document statistics.

Fitted on at most ``sample_rows`` labelled documents, whose statistics (not
texts) come to the driver; every document is then scored in one map over the
scan with the flat arrays of the trees. No shuffle of texts.

Defined results: null and blank texts have all statistics 0 and get the score
the trees give those; rows repeating an id get equal scores for equal texts;
labels, language, source and ids are no inputs; without labels the score is
0.5; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.boosting import Forest, fit, labelled_sample
from corpusflow.llm.common import by_frame, crc_part, load
from corpusflow.llm.quality_rules import STOP_WORDS
from corpusflow.llm.shingles import words

_STOPS = frozenset(STOP_WORDS)
FEATURES = (
    "log_words", "mean_word", "long_word_share", "short_word_share", "distinct_share", "stop_share", "digit_share",
    "upper_share", "symbol_share", "bang_share", "end_share", "pipe_share", "accent_share", "repeat_share", "dup_line_share",
    "mean_line", "one_word_line_share", "char_entropy", "top_word_share", "letter_word_share",
)


def statistics(text: str | None) -> list[float]:
    """The values of ``FEATURES``; all 0 without a word."""
    tokens = words(text)
    n = len(tokens)
    if not n:
        return [0.0] * len(FEATURES)
    chars = Counter(text)
    counts = Counter(tokens)
    size = sum(map(len, tokens))
    lengths = list(map(len, tokens))
    triples = Counter(zip(tokens, tokens[1:], tokens[2:]))
    lines = [x for x in text.split("\n") if x.strip()]
    upper = digits = letters = symbols = accents = 0
    for c, k in chars.items():
        if c.isalpha():
            letters += k
            upper += k * c.isupper()
            accents += k * (c > "\x7f")
        elif c.isdigit():
            digits += k
        elif c in "#*$%&<>{}[]\\^~=+_/@":
            symbols += k
    total = len(text)
    repeats = sum(k for k in triples.values() if k > 1)
    return [
        math.log(n), size / n, sum(x > 12 for x in lengths) / n, sum(x < 3 for x in lengths) / n, len(counts) / n,
        sum(counts[w] for w in _STOPS if w in counts) / n, digits / size, upper / max(letters, 1), symbols / size,
        chars["!"] / n, sum(chars[c] for c in ".?") / n, chars["|"] / n, accents / max(letters, 1),
        repeats / max(n - 2, 1), 1 - len(set(lines)) / max(len(lines), 1), math.log(n / max(len(lines), 1)),
        sum(" " not in x.strip() for x in lines) / max(len(lines), 1),
        -sum(k / total * math.log2(k / total) for k in chars.values()), counts.most_common(1)[0][1] / n,
        sum(any(map(str.isalpha, w)) * k for w, k in counts.items()) / n,
    ]


def matrix(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, held_out, label: str = "quality", sample_rows: int = 20_000) -> Forest:
    """Trees from the labelled documents outside ``held_out``, ``sample_rows`` of them at most."""

    def frame(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"x": list(matrix(pdf["text"])), "y": pdf["y"].to_numpy()})

    rows = labelled_sample(docs, labels, label, held_out, sample_rows).mapInPandas(
        by_frame(frame), "x array<double>, y double").toPandas()
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    y = rows["y"].to_numpy(dtype=np.float64)
    order = np.lexsort([*x.T, y])  # the order in which tasks end must not matter
    return fit(x[order], y[order])


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """``doc_id, score`` of every row."""

    def frame(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "score": forest.probability(matrix(pdf["text"]))})

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
        by_frame(frame), "doc_id string, score double").withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def op9_quality_model(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    held = lambda c: crc_part(c, 3) == 1
    forest = train(docs, load(spark, sf_dir, "labels"), held)
    return score(docs, forest).select("doc_id", held(F.col("doc_id")).alias("held_out"), "score",
                                      (F.col("score") >= 0.5).cast("int").alias("predicted"))
