"""Exact top-k inner products with a bit-sliced index.

Vectors become integers, ``floor(scale * x)``. The index cuts the vectors into
blocks; in a block every dimension's values, shifted to be non-negative, are
stored as bitmaps, one for each of their ``slices`` most significant bits. A
query adds the slices of all dimensions, weighted by its own integers, with
bitwise adders over 64 rows a word; that gives bit slices of a lower bound of
every row's score. Going down from the most significant slice finds the k-th
largest bound; rows whose bound lies within the quantisation error of it are the
boundary, and their scores are computed exactly. So results equal brute force.

Blocks hold ``block_rows`` vectors and meet the queries in chunks of
``chunk_rows``: both are rows of bounded size, joined on a group of blocks. The
stated query set against all rows, in blocks; every pair keeps k rows a query.

Integers, products and sums are exact at every size: 64 bits where they suffice,
Python's integers in the blocks and queries where they do not. A score that a
``long`` cannot hold is ranked exactly and given as the largest or smallest one.

Defined results: vectors that are null or that hold a null or non-finite component
take no part; neither do null ids; vectors of different length multiply as far as
both go, an empty one scores 0; a query never matches a row with its own id, so rows repeating an id
do not match each other but are separate candidates (the same id may come twice
for a query); ties go to the smaller id; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions.partitions import parallelism
from corpusflow.llm.common import load, stored


def add(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Sum of two numbers given as bit slices, least significant first; arrays of any equal shape."""
    out, carry = [], None
    for i in range(max(len(a), len(b))):
        x, y = (s[i] if i < len(s) else None for s in (a, b))
        if x is None or y is None:
            x = x if y is None else y
            if carry is None:
                out.append(x)
            else:
                out.append(x ^ carry)
                carry = x & carry
        elif carry is None:
            out.append(x ^ y)
            carry = x & y
        else:
            half = x ^ y
            out.append(half ^ carry)
            carry = (x & y) | (half & carry)
    return [*out, carry] if carry is not None else out


def add_all(slices: np.ndarray) -> list[np.ndarray]:
    """Sum over the first axis of ``(numbers, bits, words)`` bitmaps, adding pairs of numbers together."""
    if not len(slices):
        return []
    held = [np.ascontiguousarray(slices[:, b]) for b in range(slices.shape[1])]
    odd: list[list[np.ndarray]] = []
    while len(held[0]) > 1:
        n = len(held[0])
        if n % 2:
            odd.append([s[-1] for s in held])
            held = [s[:-1] for s in held]
        held = add([s[0::2] for s in held], [s[1::2] for s in held])
    total = [s[0] for s in held]
    for extra in odd:
        total = add(total, extra)
    return total


def kth_largest(slices: list[np.ndarray], live: np.ndarray, k: int) -> int:
    """The k-th largest value among the rows of bitmap ``live`` (all of them at least k), from the top slice down."""
    value, among, above = 0, live, 0
    for b in reversed(range(len(slices))):
        ones = among & slices[b]
        n = int(np.bitwise_count(ones).sum())
        if above + n >= k:
            among, value = ones, value | (1 << b)
        else:
            above += n
            among = among & ~slices[b]
    return value


def at_least(slices: list[np.ndarray], live: np.ndarray, value: int) -> np.ndarray:
    """Bitmap of the rows of ``live`` whose number is ``value`` or more."""
    if value <= 0:
        return live
    if value >> len(slices):
        return np.zeros_like(live)
    more, same = np.zeros_like(live), live
    for b in reversed(range(len(slices))):
        if value >> b & 1:
            same = same & slices[b]
        else:
            more |= same & slices[b]
            same = same & ~slices[b]
    return more | same


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, exact: 64-bit integers where they fit, Python's otherwise."""
    if not x.size or np.abs(x).max() * scale < 2.0 ** 62:
        return np.floor(x * scale).astype(np.int64)
    exact = [math.floor(Fraction(v) * scale) for v in x.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(x.shape)


def order_key(score: int) -> bytes:
    """Bytes that sort as the integers do, of any size."""
    body = abs(score).to_bytes(max(1, (abs(score).bit_length() + 7) // 8), "big")
    key = len(body).to_bytes(2, "big") + body
    return b"\1" + key if score >= 0 else b"\0" + bytes(255 - b for b in key)


def _bits(n: int) -> int:
    return int(n).bit_length()


class Block:
    """Bit slices and exact integers of up to ``block_rows`` vectors."""

    def __init__(self, ids: np.ndarray, exact: np.ndarray, slices: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.exact = ids[order], exact[order]
        self.low = self.exact.min(axis=0)
        above = self.exact - self.low
        span = int(above.max())
        self.most = max(abs(int(exact.max())), abs(int(exact.min())))
        self.cut = max(0, _bits(span) - slices)  # low bits left out
        width = max(1, _bits(span) - self.cut)
        coarse = (above >> self.cut).astype(np.int64)
        pad = -len(ids) % 64
        bits = (coarse[:, :, None] >> np.arange(width)) & 1
        bits = np.pad(bits.astype(np.uint8), ((0, pad), (0, 0), (0, 0)))
        packed = np.packbits(bits, axis=0, bitorder="little").transpose(1, 2, 0)  # dimension, bit, bytes
        self.up = np.ascontiguousarray(packed).view(np.uint64)
        live = np.packbits(np.pad(np.ones(len(ids), dtype=np.uint8), (0, pad)), bitorder="little")
        self.live = live.view(np.uint64)

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best rows but the query's own; ``query`` is as wide as the block."""
        live = self.live.copy()
        for at in range(*np.searchsorted(self.ids, [query_id, query_id + 1])):
            live[at >> 6] &= ~np.uint64(1 << (at & 63))
        n = int(np.bitwise_count(live).sum())
        if not n:
            return self.ids[:0], self.ids[:0]
        # products and their sum fit 63 bits, or Python's integers are used
        largest = max(abs(int(query.max())), abs(int(query.min())))
        wide = query.dtype == object or self.exact.dtype == object or len(query) * largest * max(self.most, 1) >= 2**62
        if wide:
            query = query.astype(object)
        if n > k:
            # a negative weight takes the complement, top - value, so all weights are positive
            weight = np.abs(query)
            turned = (query < 0).astype(bool)
            total: list[np.ndarray] = []
            for bit in reversed(range(_bits(weight.max()))):
                chosen = (weight >> bit & 1).astype(bool)
                total = [np.zeros_like(live), *total] if total else []
                total = add(total, add_all(np.concatenate([self.up[chosen & ~turned], ~self.up[chosen & turned]]))) \
                    if chosen.any() else total
            if total:
                # the left-out low bits add less than this to any row's sum
                error = int(weight.sum()) if self.cut else 0
                live = at_least(total, live, kth_largest(total, live, k) - error)
        rows = np.flatnonzero(np.unpackbits(live.view(np.uint8), bitorder="little"))
        scores = (self.exact[rows].astype(object) * query).sum(axis=1) if wide else self.exact[rows] @ query
        best = np.array(sorted(range(len(rows)), key=lambda r: (-int(scores[r]), self.ids[rows[r]]))[:k], dtype=np.int64)
        return self.ids[rows[best]], scores[best]


def vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, v``: the usable vectors, as doubles."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fine = F.col(vector_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return table.where(F.col(id_col).isNotNull()).where(fine).select(F.col(id_col).cast("long").alias("id"), x.alias("v"))


def _as_wide(v: np.ndarray, width: int) -> np.ndarray:
    """A vector cut or filled with zeros to ``width``: a missing component adds nothing to a product."""
    return v[:width] if len(v) >= width else np.concatenate([v, np.zeros(width - len(v))])


def top_k(base: DataFrame, queries: DataFrame, k: int = 5, slices: int = 6, scale: int = 256, block_rows: int = 8192,
          chunk_rows: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every row of ``queries``; both tables are ``id, v``.

    Components become floor(scale * x). Vectors of different length multiply as far as both go.
    """

    def gather(name: str):
        def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = [(p["id"].to_numpy(dtype=np.int64), list(p["v"])) for p in frames if len(p)]
            if parts:
                ids = np.concatenate([i for i, _ in parts])
                rows = [np.asarray(v, dtype=np.float64) for _, vs in parts for v in vs]
                width = max(1, max(map(len, rows)))
                rows = np.stack([_as_wide(v, width) for v in rows])
                yield pd.DataFrame({name: [TaskContext.get().partitionId()], f"{name}_ids": [ids.tobytes()], f"{name}_rows": [rows.tobytes()]})

        return run

    # a partition dealt round robin is a block, or a chunk of queries
    n = max(1, -(-base.count() // block_rows))
    blocks = stored(base.repartition(n).mapInPandas(gather("block"), "block int, block_ids binary, block_rows binary"), "blocks")
    m = max(1, -(-queries.count() // chunk_rows))
    chunks = stored(queries.repartition(m).mapInPandas(gather("chunk"), "chunk int, chunk_ids binary, chunk_rows binary"), "chunks")
    # a chunk goes once to each group of blocks, and is never broadcast: by Spark's estimate, which leaves the
    # copies out, the driver would hold all of them. The blocks lead the merge join, so a block's rows come together.
    groups = min(n, 8 * parallelism(base.sparkSession))
    meets = chunks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    pairs = blocks.withColumn("group", F.pmod("block", F.lit(groups))).join(meets.hint("merge"), "group").drop("group")

    def matrix(ids: bytes, rows: bytes) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(ids, dtype=np.int64)
        return ids, np.frombuffer(rows, dtype=np.float64).reshape(len(ids), -1)

    def search(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, block = None, None
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                if r.block != last:
                    ids, rows = matrix(r.block_ids, r.block_rows)
                    last, block = r.block, Block(ids, integers(rows, scale), slices)
                ids, rows = matrix(r.chunk_ids, r.chunk_rows)
                width, found = block.exact.shape[1], []
                for i, (query_id, v) in enumerate(zip(ids.tolist(), rows)):
                    # each query by itself: one wide vector does not slow the others down
                    best, scores = block.search(query_id, integers(_as_wide(v, width), scale), k)
                    found += [(r.chunk << 32 | i, query_id, b, max(-2**63, min(s, 2**63 - 1)), order_key(s))
                              for b, s in zip(best.tolist(), scores.tolist())]
                if found:
                    yield pd.DataFrame(found, columns=["query", "query_id", "vec_id", "score", "key"])

    found = pairs.mapInPandas(search, "query long, query_id long, vec_id long, score long, key binary")
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.col("key").desc(), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_bit_sliced(spark, sf_dir: str) -> DataFrame:
    rows = stored(vectors(load(spark, sf_dir, "embeddings")), "vectors")
    return top_k(rows, rows.where(F.col("id") % 50 == 0), 5)


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
           where vec_id is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
s as (select q.vec_id as query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0)::bigint as score
      from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""
