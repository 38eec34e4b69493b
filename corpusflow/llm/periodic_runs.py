"""Periodic runs of words: descending-LCP Kruskal over suffix classes.

A run is a maximal stretch of words with smallest period ``q`` that is at least
``max(6, 4 * q)`` words long. Suffixes that share a prefix of ``l`` words form a
class; classes are united from the largest ``l`` down, each being an ordered set
of positions. Two positions that become neighbours in a united class share
exactly ``l`` words; where they lie no more than ``l`` apart, their distance is
the smallest period of the stretch they span, and every such stretch is the tail
of a run. The first tail is the run itself.

A run of the wanted length repeats its first five words, so only positions whose
five-word window occurs twice in the same text enter the suffix structure. Texts
are worked on in batches of bounded size; a very long text is a batch of its own
and its cost grows with ``n log n``. There is no shuffle.

Defined results: null or blank texts have no words, no run, and the hash of the
empty string twice; a null id leaves the words as they are; rows repeating an id
are answered row by row; other columns are ignored; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.partitions import spread
from corpusflow.llm.common import WORD, load

#: Every run has this many words twice: the shortest run of period q shares max(6 - q, 3 q) words with its own shift.
WINDOW = 5
#: Words worked on together.
BATCH_WORDS = 200_000
_WORD = re.compile(WORD)


def rebuilt(words: list[str], doc_id: int | None) -> list[str]:
    """The contract's words: one id in ten gets a periodic tail, the others stay as they are."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a:a + p]
    times = -(-(n - a) // p)
    return words[:a] + (tail * times)[:n - a]


def _repeated_windows(codes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Positions whose five-word window lies in one text and (by a hash) occurs there again."""
    n = len(codes) - WINDOW + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    key = text[:n].astype(np.uint64)
    for k in range(WINDOW):
        key = key * np.uint64(0x9E3779B97F4A7C15) + codes[k:k + n].astype(np.uint64)
        key ^= key >> np.uint64(29)
    inside = np.flatnonzero(text[:n] == text[WINDOW - 1:])
    key = key[inside]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(inside), dtype=bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return inside[twice]


def _ranks(*columns: np.ndarray) -> np.ndarray:
    """Dense ranks of rows, compared exactly column by column."""
    rank = columns[0]
    for c in columns[1:]:
        _, rank = np.unique(rank.astype(np.int64) * (int(c.max()) + 1) + c, return_inverse=True)
    return rank


def _suffixes(s: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; every position after the end ranks lowest."""
    n, k = len(s), 1
    rank = _ranks(np.zeros(n, dtype=np.int64), s)
    while True:
        shifted = np.zeros(n, dtype=np.int64)
        shifted[:n - k] = rank[k:] + 1
        key = rank * (n + 1) + shifted
        order = np.argsort(key, kind="stable")
        step = np.zeros(n, dtype=np.int64)
        step[1:] = key[order[1:]] != key[order[:-1]]
        np.cumsum(step, out=step)
        rank = np.empty(n, dtype=np.int64)
        rank[order] = step
        k *= 2
        if step[-1] == n - 1 or k >= n:
            return order


def _common(s: list[int], order: list[int]) -> list[int]:
    """Length of the common prefix of every suffix with its predecessor in ``order``."""
    n = len(s)
    at, out, h = [0] * n, [0] * n, 0
    for r, i in enumerate(order):
        at[i] = r
    for i in range(n):
        r = at[i]
        if r:
            j = order[r - 1]
            while i + h < n and j + h < n and s[i + h] == s[j + h]:
                h += 1
            out[r] = h
            h = max(h - 1, 0)
        else:
            h = 0
    return out


def _kruskal(places: list[int], order: list[int], common: list[int]) -> dict[tuple[int, int], int]:
    """``(end, period) -> start`` of every periodic stretch, over word positions ``places``."""
    edges = np.array(common)
    ranks = np.flatnonzero(edges > 0)
    ranks = ranks[np.argsort(-edges[ranks], kind="stable")]
    root = list(range(len(order)))
    classes: list[list[int] | None] = [[places[i]] if places[i] >= 0 else [] for i in order]
    starts: dict[tuple[int, int], int] = {}

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for r in ranks.tolist():
        shared = common[r] + WINDOW - 1
        x, y = top(r - 1), top(r)
        if len(classes[x]) < len(classes[y]):
            x, y = y, x
        big, small = classes[x], classes[y]
        gaps = [bisect_left(big, p) for p in small]
        for k, (p, g) in enumerate(zip(small, gaps)):
            if g and (not k or gaps[k - 1] != g) and p - big[g - 1] <= shared:
                key, start = (p + shared, p - big[g - 1]), big[g - 1]
                if starts.get(key, start) >= start:
                    starts[key] = start
            if g < len(big) and (k + 1 == len(small) or gaps[k + 1] != g) and big[g] - p <= shared:
                key = (big[g] + shared, big[g] - p)
                if starts.get(key, p) >= p:
                    starts[key] = p
        if len(small) * 16 < len(big):
            for p in small:
                big.insert(bisect_left(big, p), p)
        else:
            big += small
            big.sort()
        root[y], classes[y] = x, None
    return starts


def runs_of(texts: list[list[str]]) -> list[list[tuple[int, int, int]]]:
    """``(start, length, period)`` of every run of each word list, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = [len(t) for t in texts]
    flat = [w for t in texts for w in t]
    if len(flat) < WINDOW + 1:
        return out
    codes = pd.factorize(np.array(flat, dtype=object))[0]
    text = np.repeat(np.arange(len(texts)), sizes)
    first = np.cumsum([0, *sizes])
    at = _repeated_windows(codes, text)
    if not len(at):
        return out
    # windows by exact rank; after each stretch of positions comes a symbol of its own
    window = _ranks(*(codes[at + k] for k in range(WINDOW)), text[at])
    last = np.append(np.diff(at) != 1, True) | np.append(np.diff(text[at]) != 0, True)
    n = len(at) + int(last.sum())
    slot = np.arange(len(at)) + np.concatenate([[0], np.cumsum(last)[:-1]])
    s = np.arange(n, dtype=np.int64) + len(at)
    s[slot] = window
    places = np.full(n, -1, dtype=np.int64)
    places[slot] = at
    order = _suffixes(s)
    common = _common(s.tolist(), order.tolist())
    for (end, period), start in _kruskal(places.tolist(), order.tolist(), common).items():
        if end - start >= max(6, 4 * period):
            k = int(text[start])
            out[k].append((start - int(first[k]), end - start, period))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words without those inside a run after its first period."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0)]


def _batches(pdf: pd.DataFrame) -> Iterator[tuple[list, list[list[str]]]]:
    ids, texts, n = [], [], 0
    for i, t in zip(pdf["doc_id"], pdf["text"]):
        w = _WORD.findall(t) if t else []
        if n and n + len(w) > BATCH_WORDS:
            yield ids, texts
            ids, texts, n = [], [], 0
        ids.append(None if i is None else int(i))
        texts.append(w)
        n += len(w)
    if ids:
        yield ids, texts


def periodic_runs(docs: DataFrame, rebuild=None) -> DataFrame:
    """Per row ``doc_id``, ``n_words``, ``runs`` (start, length, period by start, then period) and ``collapsed`` text.

    ``rebuild`` maps ``(words, doc_id)`` to the words to search; by default the text's own.
    """
    schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for ids, texts in _batches(pdf):
                if rebuild:
                    texts = [rebuild(w, i) for w, i in zip(texts, ids)]
                rows = [(i, len(w), [{"start": a, "length": n, "period": p} for a, n, p in r], " ".join(collapsed(w, r)))
                        for i, w, r in zip(ids, texts, runs_of(texts))]
                out = pd.DataFrame(rows, columns=["doc_id", "n_words", "runs", "collapsed"])
                yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    # an id as text keeps a null apart from a number in pandas
    narrow = spread(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"))
    return narrow.mapInPandas(run, schema)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of :func:`periodic_runs` over every document."""
    found = periodic_runs(load(spark, sf_dir, "documents"), rebuilt)
    # greatest length, then smallest start, then smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r.length.alias("length"), (-r.start).alias("s"), (-r.period).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"), F.expr("1000 * best.length div -best.p").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
