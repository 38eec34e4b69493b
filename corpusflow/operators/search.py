"""K-nearest-neighbour search over a vector collection.

Exact search runs on an inverted-file layout, expressed with equi-joins only
(no cross join, no all-pairs per group):

1. Index build (once per collection): pick ``C`` cell centroids (``C`` grows
   as N / block_rows and is capped by ``Settings.max_cells`` so the centroid matrix
   held by the driver has a proven bound), assign each vector to its nearest
   centroid, and pack each cell into sub-blocks of about ``block_rows``
   vectors. A hot cell (e.g. a third of all rows are copies of one vector)
   simply has many sub-blocks, so it spreads over many tasks.
2. Probe: each query is routed to cells; queries of one group of cells are packed
   into query blocks. Few of them are broadcast, each once, and join the blocks on
   the group alone; more are replicated over its sub-blocks (the small side is
   replicated, the big side salted) and joined on ``(group, sub)``.
3. Score: numpy computes the block's distance matrix; a task holds, per query, the
   k best of all blocks it has met (ties included), with distances computed in index
   order, float64, so values are bit-identical to the plain expression
   ``sum((q_i - x_i)^2)``, and sends those. A per-query ``row_number`` ≤ k (partial
   ``WindowGroupLimit`` before the shuffle) gives the answer.
4. Exactness: pass 1 probes the nearest cells until they hold ≥ k vectors;
   pass 2 probes every other cell whose lower bound
   ``max(0, |q - c| - radius)^2`` does not exceed the pass-1 k-th distance.
   Vectors in cells left out are provably farther, so results equal brute
   force (ties by id). ``exact=False`` stops after pass 1 with ``n_probe``
   cells (F5, approximate).

Distances are squared L2 (the collection's default metric); rank 1 is the
nearest; ties break by id.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.partitions import parallelism

from corpusflow.config import DEFAULT, Settings
from corpusflow.session import materialize, ship_package, smallest

_EPS = 1e-9
#: Bytes of a hit row in memory, with room for long ids.
_HIT_BYTES = 512
#: Bytes of a query beside its vector, and of all queries that are broadcast.
_QUERY_BYTES = 128
SENT_BYTES = 16 << 20
#: Groups of cells that a query which looks at many cells is sent to.
GROUPS = 32
#: Distances and rows that a task holds before it sends them.
HELD = 4_000_000


class DimensionMismatch(ValueError):
    """Query vectors and collection vectors differ in length."""


def _as_matrix(col) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in col]) if len(col) else np.zeros((0, 0))


def _seq_sq_dist(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise squared L2 summed in index order (matches the JVM/SQL reduction)."""
    sq = (q - x) * (q - x)
    acc = sq[:, 0].copy()
    for j in range(1, sq.shape[1]):
        acc += sq[:, j]
    return acc


@dataclass
class IvfIndex:
    """A built collection: centroids on the driver (bounded), blocks on the cluster."""

    centroids: np.ndarray  # (C, d)
    counts: dict  # cell -> vectors
    radius: dict  # cell -> max L2 distance from centroid
    n_sub: dict  # cell -> sub-blocks
    blocks: DataFrame  # cell, sub, ids array<string|long>, vecs array<array<double>>
    rows: DataFrame  # id, vec and payload columns, materialised once
    id_type: T.DataType
    dimension: int
    settings: Settings

    @property
    def size(self) -> int:
        return int(sum(self.counts.values()))


def _assign_udf(centroids: np.ndarray):
    cT = centroids.T.copy()
    cn = (centroids * centroids).sum(axis=1)
    d = centroids.shape[1]

    @F.pandas_udf("cell int, cdist double")
    def assign(vecs: pd.Series) -> pd.DataFrame:
        if len(vecs) == 0:
            return pd.DataFrame({"cell": pd.Series([], dtype="int32"), "cdist": pd.Series([], dtype="float64")})
        X = _as_matrix(vecs)
        if X.shape[1] != d:
            raise DimensionMismatch(f"vector length {X.shape[1]} != index dimension {d}")
        D = (X * X).sum(axis=1)[:, None] + cn[None, :] - 2.0 * (X @ cT)
        cell = np.argmin(D, axis=1)
        dist = np.sqrt(np.maximum(D[np.arange(len(X)), cell], 0.0))
        return pd.DataFrame({"cell": cell.astype("int32"), "cdist": dist})

    return assign


def _plan_udf(centroids: np.ndarray, counts: np.ndarray, exact: bool, n_probe: int):
    """Per query: the pass-1 cells to probe."""
    cT = centroids.T.copy()
    cn = (centroids * centroids).sum(axis=1)
    d = centroids.shape[1]

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def plan(vecs: pd.Series, ks: pd.Series) -> pd.Series:
        if len(vecs) == 0:
            return pd.Series([], dtype=object)
        X = _as_matrix(vecs)
        if X.shape[1] != d:
            raise DimensionMismatch(f"query vector length {X.shape[1]} != index dimension {d}")
        D = np.sqrt(np.maximum((X * X).sum(axis=1)[:, None] + cn[None, :] - 2.0 * (X @ cT), 0.0))
        order = np.argsort(D, axis=1, kind="stable")
        p1 = []
        for i, k in enumerate(ks):
            o = order[i][counts[order[i]] > 0]
            cum = np.cumsum(counts[o])
            take = int(np.searchsorted(cum, max(int(k), 1))) + 1  # first prefix holding >= k
            # approximate: n_probe cells at least, and more where those hold fewer than k rows
            p1.append(o[:take if exact else max(take, n_probe, 1)].tolist())
        return pd.Series(p1)

    return plan


def _pass2_udf(centroids: np.ndarray, counts: np.ndarray, radius: np.ndarray):
    """Cells not yet probed whose lower bound can still reach the k-th distance."""
    cT = centroids.T.copy()
    cn = (centroids * centroids).sum(axis=1)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def pass2(vecs: pd.Series, p1: pd.Series, bound: pd.Series) -> pd.Series:
        if len(vecs) == 0:
            return pd.Series([], dtype=object)
        X = _as_matrix(vecs)
        # computed again: kept from pass 1 they would be a row of cells for every query, written and shuffled
        D = np.sqrt(np.maximum((X * X).sum(axis=1)[:, None] + cn[None, :] - 2.0 * (X @ cT), 0.0))
        out = []
        for dists, done, b in zip(D, p1, bound):
            cand = counts > 0
            cand[np.asarray(done, dtype=np.int64)] = False
            if b is not None and not (isinstance(b, float) and math.isnan(b)):
                lb = np.maximum(dists - radius - _EPS, 0.0)
                cand &= lb * lb <= b
            out.append(np.nonzero(cand)[0].tolist())
        return pd.Series(out)

    return pass2


def _grouped_udf(per: int):
    """A query's cells by groups of ``per`` cells."""

    @F.pandas_udf("array<struct<g:int,cells:array<int>>>")
    def grouped(cells: pd.Series) -> pd.Series:
        out = []
        for c in cells:
            c = np.sort(np.asarray(c if c is not None else [], dtype=np.int64))
            g, at = np.unique(c // per, return_index=True)
            out.append([{"g": int(k), "cells": part.tolist()} for k, part in zip(g, np.split(c, at[1:]))])
        return pd.Series(out, dtype=object)

    return grouped


def build_index(collection: DataFrame, id_col: str = "id", vec_col: str = "embedding",
                settings: Settings = DEFAULT, n_cells: int | None = None, seed: int = 17,
                payload: list[str] | None = None) -> IvfIndex:
    """Build the inverted-file layout of a collection (once; reuse for many searches).

    The collection is materialised once (checkpoint to ``spark.checkpoint.dir``):
    every later step reads it instead of recomputing an upstream pipeline,
    and ``payload`` columns (e.g. the chunk text) stay available to
    ``attach`` without another pass.
    """
    spark = collection.sparkSession
    ship_package(spark)
    base = collection.select(F.col(id_col).alias("id"),
                             F.transform(vec_col, lambda x: x.cast("double")).alias("vec"), *(payload or []))
    base = materialize(base)
    id_type = base.schema["id"].dataType
    n = base.count()
    if n == 0:
        empty = spark.createDataFrame([], T.StructType([
            T.StructField("cell", T.IntegerType()), T.StructField("sub", T.IntegerType()),
            T.StructField("ids", T.ArrayType(id_type)),
            T.StructField("vecs", T.ArrayType(T.ArrayType(T.DoubleType())))]))
        return IvfIndex(np.zeros((0, 0)), {}, {}, {}, empty, base, id_type, 0, settings)
    # about one block of vectors per cell: a probe scores whole blocks, and a
    # query is replicated to few cells even when pruning is weak
    c = n_cells or max(1, min(settings.max_cells, int(round(n / settings.block_rows))))
    # Centroids: the C vectors with the smallest seeded hash of their id — a
    # deterministic spread sample chosen by a distributed top-C (partial per
    # task). Any centroid choice keeps results exact; better ones only prune
    # more. The C x d matrix comes to the driver: bounded by max_cells.
    picked = smallest(base.select("id", "vec"), c, F.xxhash64(F.col("id"), F.lit(seed)), F.col("id"))
    cents = np.stack([np.asarray(r.vec, dtype=np.float64) for r in picked])
    dim = cents.shape[1]
    # the assignment is a cheap numpy pass; it runs once for the statistics
    # and once for the blocks rather than writing another copy
    assigned = base.withColumn("a", _assign_udf(cents)(F.col("vec"))).select(
        "id", "vec", F.col("a.cell").alias("cell"), F.col("a.cdist").alias("cdist"))
    stats = assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("cdist").alias("r")).collect()
    counts = {int(r.cell): int(r.n) for r in stats}
    radius = {int(r.cell): float(r.r) for r in stats}
    n_sub = {cell: max(1, -(-cnt // settings.block_rows)) for cell, cnt in counts.items()}
    sub_map = F.create_map(*[x for cell, s in n_sub.items() for x in (F.lit(cell), F.lit(s))])
    blocks = (assigned
              .withColumn("sub", F.pmod(F.xxhash64(F.col("id"), F.lit(seed + 1)), sub_map[F.col("cell")]).cast("int"))
              .groupBy("cell", "sub")
              .agg(F.collect_list(F.struct("id", "vec")).alias("rows"))
              .select("cell", "sub", F.col("rows.id").alias("ids"), F.col("rows.vec").alias("vecs")))
    parts = max(1, min(sum(n_sub.values()), parallelism(spark) * 4))
    blocks = blocks.repartition(parts, "cell", "sub")
    blocks = materialize(blocks)
    return IvfIndex(cents, counts, radius, n_sub, blocks, base, id_type, dim, settings)


def attach(index: IvfIndex, hits: DataFrame, cols: list[str], most: int | None = None) -> DataFrame:
    """Payload columns of the hit rows.

    As long as the hits fit ``broadcast_max_bytes`` they go to the collection's
    rows, which then are scanned in place and not shuffled. ``most`` is a bound
    of their number (queries x k); without one they are computed once and counted.
    """
    if most is None:
        hits = materialize(hits)
        most = hits.count()
    rows = index.rows.select("id", *cols)
    small = most * _HIT_BYTES <= index.settings.broadcast_max_bytes
    return rows.join(F.broadcast(hits), "id") if small else hits.join(rows, "id")


def _arrow_matrix(vecs: pa.Array) -> np.ndarray:
    """A list array of vectors as rows of doubles, without a copy where it has no nulls."""
    if not len(vecs):
        return np.zeros((0, 0))
    lengths = vecs.value_lengths()
    if lengths.null_count or len(lengths.unique()) > 1:
        raise DimensionMismatch("vectors that are null, or of different length")
    return vecs.flatten().to_numpy(zero_copy_only=False).reshape(len(vecs), -1)


def _rough(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by one matrix product, and a query's slack: twice what rounding can add to one of them."""
    qn, xn = (q * q).sum(axis=1), (x * x).sum(axis=1)
    n, d = np.concatenate([qn, xn]), q.shape[1]
    if ((n == 0) | ((n > 1e-12) & (n < 1e12))).all():
        a = np.concatenate([-2.0 * q, qn[:, None], np.ones((len(q), 1))], axis=1).astype(np.float32)
        b = np.concatenate([x, np.ones((len(x), 1)), xn[:, None]], axis=1).astype(np.float32)
        # d + 2 terms of at most 2 (qn + xn) together, rounded to single precision before, and at every sum
        return a @ b.T, (d + 8) * 2.0 ** -21 * (qn + xn.max())
    with np.errstate(all="ignore"):  # no such bound: double precision, and what is not a number is far
        far = qn[:, None] + xn[None, :] - 2.0 * (q @ x.T)
        far[np.isnan(far)] = np.inf
        return far, np.nan_to_num(_EPS * (1.0 + qn + xn.max()), nan=np.inf)


class _Nearest:
    """What a task holds for a block of queries: each one's ``k`` smallest distances so far, and the rows that can be among them."""

    def __init__(self, qids: pa.Array, ks: np.ndarray, bounds: np.ndarray):
        self.qids, self.ks = qids, ks
        self.best = np.full((len(ks), max(1, int(ks.max(initial=0)))), np.inf)  # sorted
        self.bounds = np.where(np.isnan(bounds), np.inf, bounds)  # none is proven yet
        self.slack = np.zeros(len(ks))
        self.held: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []  # query, id, distance
        self.n = 0

    def limit(self, of: np.ndarray) -> np.ndarray:
        return np.minimum(self.bounds[of], self.best[of, self.ks[of] - 1])

    def add(self, of: np.ndarray, q: np.ndarray, ids: pa.Array, x: np.ndarray) -> None:
        """The rows ``x`` for the queries ``of`` (vectors ``q``)."""
        far, slack = _rough(q, x)
        self.slack[of] = np.maximum(self.slack[of], slack)
        near = far <= (self.limit(of) + slack)[:, None]
        count = np.count_nonzero(near, axis=1)
        ks = self.ks[of]
        many = np.flatnonzero(count > ks)  # more than k of this block: its k-th is a bound
        if len(many):
            most = int(ks[many].max())
            kth = np.sort(np.partition(far[many], most - 1, axis=1)[:, :most], axis=1) if most < len(x) else np.sort(far[many], axis=1)
            near[many] &= far[many] <= (kth[np.arange(len(many)), ks[many] - 1] + slack[many])[:, None]
            count[many] = np.count_nonzero(near[many], axis=1)
        rows, cols = np.nonzero(near)
        if not len(rows):
            return
        exact = _seq_sq_dist(q[rows], x[cols])
        some = np.flatnonzero(count)
        c = count[some]
        wide = np.full((len(some), int(c.max())), np.inf)
        at = np.arange(len(rows)) - np.repeat(np.cumsum(c) - c, c)
        wide[np.repeat(np.arange(len(some)), c), at] = np.where(np.isnan(exact), np.inf, exact)
        self.best[of[some]] = np.sort(np.concatenate([self.best[of[some]], wide], axis=1), axis=1)[:, :self.best.shape[1]]
        self.held.append((of[rows], ids.take(pa.array(cols)), exact))
        self.n += len(rows)
        if len(self.held) >= 32:
            self._prune()

    def _prune(self) -> None:
        of, dist = (np.concatenate([h[j] for h in self.held]) for j in (0, 2))
        keep = np.flatnonzero(~(dist > self.limit(of) + self.slack[of]))
        ids = pa.concat_arrays([h[1] for h in self.held]).take(pa.array(keep))
        self.held, self.n = [(of[keep], ids, dist[keep])], len(keep)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        self._prune()
        of, ids, dist = self.held[0]
        if len(of):
            yield pa.RecordBatch.from_arrays([self.qids.take(pa.array(of)), ids, pa.array(dist), pa.array(self.ks[of].astype(np.int32))],
                                             names=["query_id", "id", "distance", "k"])


def _score_fn():
    """``mapInArrow`` body: a task sends a query's nearest rows of all blocks it has met for a group of cells."""

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], _Nearest] = {}
        for batch in it:
            names = ("g", "qsub", "qids", "qvecs", "ks", "bounds", "asked", "cell", "ids", "vecs")
            for g, qsub, qids, qvecs, ks, bounds, asked, cell, ids, vecs in zip(*(batch.column(c) for c in names)):
                ks = ks.values.to_numpy(zero_copy_only=False).astype(np.int64)
                cells = asked.values.flatten().to_numpy(zero_copy_only=False)
                of = np.repeat(np.arange(len(ks)), asked.values.value_lengths().to_numpy(zero_copy_only=False))
                of = of[cells == cell.as_py()]  # the queries that look at this cell
                of = of[ks[of] > 0]
                if not len(of) or not len(ids.values):
                    continue
                q, x = _arrow_matrix(qvecs.values), _arrow_matrix(vecs.values)
                if q.shape[1] != x.shape[1]:
                    raise DimensionMismatch(f"query length {q.shape[1]} != collection length {x.shape[1]}")
                key = g.as_py(), qsub.as_py()
                if key not in held:
                    held[key] = _Nearest(qids.values, ks, bounds.values.to_numpy(zero_copy_only=False).astype(np.float64))
                held[key].add(of, q[of], ids.values, x)
                if sum(h.n + h.best.size for h in held.values()) > HELD:
                    for h in held.values():
                        yield from h.rows()
                    held = {}
        for h in held.values():
            yield from h.rows()

    return score


def _cand_schema(qid_type: T.DataType, id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("query_id", qid_type), T.StructField("id", id_type),
                         T.StructField("distance", T.DoubleType()), T.StructField("k", T.IntegerType())])


def _probe(index: IvfIndex, asked: DataFrame) -> DataFrame:
    """Score (query_id, qvec, k, bound, cells) rows against the index blocks; a null ``bound`` keeps the k best of every block.

    Where queries look at many of the cells, a query is sent to groups of cells,
    ``GROUPS`` at most, and not to every single one.
    """
    spark = asked.sparkSession
    s = index.settings
    schema = _cand_schema(asked.schema["query_id"].dataType, index.id_type)
    asked = asked.where(F.size("cells") > 0)
    n_cells = len(index.centroids)
    # per-cell probe counts: at most C rows, sizes the query blocks; cell -1 counts the queries
    probe_counts = {int(r.cell): int(r.n) for r in asked.select(F.explode(F.concat("cells", F.array(F.lit(-1)))).alias("cell")).groupBy(
        "cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not probe_counts:
        return spark.createDataFrame([], schema)
    n_queries, looks = probe_counts.pop(-1), sum(probe_counts.values())
    most = max(probe_counts.values())  # as many queries at least
    dense = looks * 4 >= most * n_cells
    per = max(1, -(-n_cells // GROUPS)) if dense else 1
    asked = asked.withColumn("x", F.explode(_grouped_udf(per)("cells"))).select("query_id", "qvec", "k", "bound", "x.g", "x.cells")
    wanted: dict[int, int] = {}
    subs: dict[int, int] = {}
    for cell, n in probe_counts.items():
        wanted[cell // per] = max(wanted.get(cell // per, 0), n)
    for cell, n in index.n_sub.items():
        subs[cell // per] = max(subs.get(cell // per, 0), n)
    qsub = {g: max(1, -(-n // s.block_rows)) for g, n in wanted.items()}
    qsub_map = F.create_map(*[x for g, v in qsub.items() for x in (F.lit(g), F.lit(v))])
    nsub_map = F.create_map(*[x for g, v in subs.items() for x in (F.lit(g), F.lit(v))])
    qblocks = (asked
               .withColumn("qsub", F.pmod(F.xxhash64("query_id"), qsub_map[F.col("g")]))
               .groupBy("g", "qsub")
               .agg(F.collect_list(F.struct("query_id", "qvec", "k", "bound", "cells")).alias("q"))
               .select("g", "qsub", F.col("q.query_id").alias("qids"), F.col("q.qvec").alias("qvecs"),
                       F.col("q.k").alias("ks"), F.col("q.bound").alias("bounds"), F.col("q.cells").alias("asked")))
    blocks = index.blocks.withColumn("g", F.floor(F.col("cell") / per).cast("int"))
    sent = min(looks, n_queries * len(wanted))  # rows of queries, once for each of their groups
    if sent * (8 * index.dimension + _QUERY_BYTES) + 4 * looks <= min(SENT_BYTES, s.broadcast_max_bytes):
        pairs = blocks.join(F.broadcast(qblocks), "g")
    else:
        # replicated over every sub-block of its cells; Spark's estimate of the size does not know of that,
        # and would have the driver broadcast all the copies
        qblocks = qblocks.withColumn("sub", F.explode(F.sequence(F.lit(0), nsub_map[F.col("g")] - 1)))
        pairs = qblocks.hint("merge").join(blocks, ["g", "sub"], "inner")
    return pairs.select("g", "qsub", "qids", "qvecs", "ks", "bounds", "asked", "cell", "ids", "vecs").mapInArrow(_score_fn(), schema)


def _top_k(cands: DataFrame, k_lit: int | None) -> DataFrame:
    """Final rank per query. A literal bound lets Spark pre-limit each task (WindowGroupLimit)."""
    w = Window.partitionBy("query_id").orderBy(F.col("distance"), F.col("id"))
    ranked = cands.withColumn("rank", F.row_number().over(w).cast("long"))
    if k_lit is not None:
        ranked = ranked.filter(F.col("rank") <= F.lit(k_lit))
    return ranked.filter(F.col("rank") <= F.col("k")).drop("k")


def search(index: IvfIndex, queries: DataFrame, k: int | Column = 10, query_id: str = "query_id",
           query_vec: str = "embedding", exact: bool = True, n_probe: int = 2) -> DataFrame:
    """Batch k-NN (F4; F1 is a one-row ``queries``).

    Returns ``query_id, rank (long), id, distance`` with rank ≤ k. ``k`` may be
    a column (per-row limit). k above the collection size returns what exists.
    """
    spark = queries.sparkSession
    ship_package(spark)
    kcol = k if isinstance(k, Column) else F.lit(int(k))
    q = queries.select(F.col(query_id).alias("query_id"),
                       F.transform(query_vec, lambda x: x.cast("double")).alias("qvec"),
                       kcol.cast("int").alias("k"))
    out_cols = ["query_id", "rank", "id", "distance"]
    if index.size == 0:
        schema = T.StructType([T.StructField("query_id", q.schema["query_id"].dataType),
                               T.StructField("rank", T.LongType()), T.StructField("id", index.id_type),
                               T.StructField("distance", T.DoubleType())])
        return spark.createDataFrame([], schema)
    if isinstance(k, Column):
        k_lit = q.agg(F.max("k")).collect()[0][0] or 0
    else:
        k_lit = int(k)
    C = index.centroids.shape[0]
    counts = np.array([index.counts.get(c, 0) for c in range(C)], dtype=np.int64)
    radius = np.array([index.radius.get(c, 0.0) for c in range(C)], dtype=np.float64)
    q = q.withColumn("p1", _plan_udf(index.centroids, counts, exact, n_probe)(F.col("qvec"), F.col("k")))
    # checkpointed, not cached: nothing stays pinned in executor memory after
    # the search, and the returned plan reads from the shared folder
    q = materialize(q)
    cand1 = _probe(index, q.select("query_id", "qvec", "k", F.lit(None).cast("double").alias("bound"), F.col("p1").alias("cells")))
    if not exact:
        return _top_k(cand1, k_lit).select(*out_cols)
    cand1 = materialize(cand1)
    top1 = _top_k(cand1, k_lit)
    kth = top1.groupBy("query_id").agg(F.max("distance").alias("dk"), F.count(F.lit(1)).alias("got"))
    q2 = (q.join(kth, "query_id", "left")
          .withColumn("bound", F.when(F.col("got") >= F.col("k"), F.col("dk") * (1 + _EPS) + _EPS))
          .withColumn("p2", _pass2_udf(index.centroids, counts, radius)(F.col("qvec"), F.col("p1"), F.col("bound"))))
    # written: the cells are counted and then sent
    cand2 = _probe(index, materialize(q2.select("query_id", "qvec", "k", "bound", F.col("p2").alias("cells"))))
    return _top_k(cand1.unionByName(cand2), k_lit).select(*out_cols)


def probes_for(index: IvfIndex, queries: DataFrame, k: int, recall: float = 0.9, query_id: str = "query_id",
               query_vec: str = "embedding", sample: int = 500, seed: int = 23) -> int:
    """Cells to probe for ``recall`` against the exact search, measured on ``sample`` queries.

    The sample's exact neighbours are found, and the place of each one's cell in
    its query's order of cells; the fewest cells that hold the wanted share are
    taken. The sampling error of three standard deviations (queries as the unit) is added to the share.
    """
    if index.size == 0 or len(index.counts) < 2:
        return 1
    some = materialize(queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("embedding")).orderBy(
        F.xxhash64(F.col(query_id), F.lit(seed)), F.col(query_id)).limit(sample))
    hits = search(index, some, k).select("query_id", "id")
    C = index.centroids.shape[0]
    counts = np.array([index.counts.get(c, 0) for c in range(C)], dtype=np.int64)
    order = some.select("query_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec")).select(
        "query_id", _plan_udf(index.centroids, counts, False, C)(F.col("vec"), F.lit(1)).alias("cells"))
    found = hits.join(index.rows.select("id", "vec"), "id").withColumn("cell", _assign_udf(index.centroids)(F.col("vec"))["cell"])
    place = F.array_position("cells", F.col("cell"))
    # sample x k numbers at most come to the driver
    per = found.join(order, "query_id").groupBy("query_id").agg(F.collect_list(place).alias("p")).collect()
    if not per:
        return 1
    for n in range(1, C + 1):
        share = np.array([np.mean(np.asarray(r.p) <= n) for r in per])
        if share.mean() - 3 * share.std() / math.sqrt(len(share)) >= recall:
            return n
    return C


def knn(queries: DataFrame, collection: DataFrame, k: int | Column = 10, *, query_id: str = "query_id",
        query_vec: str = "embedding", id_col: str = "id", vec_col: str = "embedding",
        settings: Settings = DEFAULT, exact: bool = True) -> DataFrame:
    """Build an index over ``collection`` and search it with ``queries``."""
    index = build_index(collection, id_col, vec_col, settings)
    return search(index, queries, k, query_id, query_vec, exact=exact)


def nest_results(hits: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """one row per query with parallel lists ``ids``, ``distances`` (+ extras), nearest first."""
    extra = extra or []
    fields = ["rank", "id", "distance", *extra]
    g = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("r"))
    return g.select("query_id", F.col("r.id").alias("ids"), F.col("r.distance").alias("distances"),
                    *[F.col(f"r.{e}").alias(f"{e}s") for e in extra])


def save_index(index: IvfIndex, path: str) -> None:
    """Persist an index: blocks and rows as Parquet, centroids and cell statistics as a
    small table (one row per cell, bounded by ``max_cells``)."""
    spark = index.blocks.sparkSession
    index.blocks.write.mode("overwrite").parquet(f"{path}/blocks")
    index.rows.write.mode("overwrite").parquet(f"{path}/rows")
    cells = [(int(c), [float(x) for x in index.centroids[c]], int(index.counts.get(c, 0)),
              float(index.radius.get(c, 0.0)), int(index.n_sub.get(c, 1))) for c in range(index.centroids.shape[0])]
    spark.createDataFrame(cells, "cell int, centroid array<double>, n long, radius double, n_sub int") \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


def load_index(spark, path: str, settings: Settings = DEFAULT) -> IvfIndex:
    """Open an index written by ``save_index`` (no rebuild; blocks are re-partitioned on read)."""
    cells = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r.cell)
    cents = np.stack([np.asarray(r.centroid, dtype=np.float64) for r in cells]) if cells else np.zeros((0, 0))
    rows = spark.read.parquet(f"{path}/rows")
    blocks = spark.read.parquet(f"{path}/blocks")
    counts = {r.cell: int(r.n) for r in cells if r.n > 0}
    return IvfIndex(cents, counts, {r.cell: float(r.radius) for r in cells if r.n > 0},
                    {r.cell: int(r.n_sub) for r in cells if r.n > 0}, blocks, rows,
                    rows.schema["id"].dataType, cents.shape[1] if cells else 0, settings)
