"""Histogram gradient-boosted trees in flat arrays, fitted on a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Forest:
    """All trees' nodes in shared arrays; a leaf is its own child.

    ``score`` walks all rows through all trees at once, one numpy step a level.
    """

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for at in range(0, len(x), 4096):
            part = x[at:at + 4096]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            rows = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                node = np.where(part[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out[at:at + 4096] = self.base + self.value[node].sum(axis=1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0,
        least: float = 2.0) -> Forest:
    """Logistic loss, level by level; ``least`` is the smallest sum of second derivatives in a child.

    With one class only, or no rows, the forest is the constant prior.
    """
    n = len(y)
    prior = (float(np.sum(y)) + 1.0) / (n + 2.0)
    base = float(np.log(prior / (1 - prior)))
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []

    def leaf(value: float) -> int:
        at = len(nodes["value"])
        for k, v in (("feature", 0), ("threshold", np.inf), ("left", at), ("right", at), ("value", value)):
            nodes[k].append(v)
        return at

    if n and 0 < np.sum(y) < n:
        f = x.shape[1]
        cuts = []
        for j in range(f):
            q = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]))
            cuts.append((q[:-1] + q[1:]) / 2 if len(q) > 2 else q)
        binned = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], axis=1)
        flat = binned + np.arange(f) * bins
        margin = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            own = np.zeros(n, dtype=np.int64)  # row's node in the level, -1 once in a leaf
            level = [leaf(0.0)]
            roots.append(level[0])
            step = np.zeros(n)
            for d in range(depth + 1):
                live = own >= 0
                k = len(level)
                sums_g = np.bincount(own[live], g[live], k)
                sums_h = np.bincount(own[live], h[live], k)
                best = np.zeros(k)
                where = np.zeros((k, 2), dtype=np.int64)
                if d < depth:
                    index = (own[live][:, None] * (f * bins) + flat[live]).ravel()
                    hg = np.bincount(index, np.repeat(g[live], f), k * f * bins).reshape(k, f, bins).cumsum(axis=2)
                    hh = np.bincount(index, np.repeat(h[live], f), k * f * bins).reshape(k, f, bins).cumsum(axis=2)
                    rg, rh = sums_g[:, None, None] - hg, sums_h[:, None, None] - hh
                    gain = hg**2 / (hh + ridge) + rg**2 / (rh + ridge) - (sums_g**2 / (sums_h + ridge))[:, None, None]
                    gain[(hh < least) | (rh < least)] = 0
                    for j, c in enumerate(cuts):
                        gain[:, j, len(c):] = 0
                    top = gain.reshape(k, -1).argmax(axis=1)
                    best = gain.reshape(k, -1)[np.arange(k), top]
                    where = np.stack(np.unravel_index(top, (f, bins)), axis=1)
                children, move = [], np.full((k, 2), -1)
                for i, at in enumerate(level):
                    if best[i] > 1e-6:
                        j, b = where[i]
                        a, z = leaf(0.0), leaf(0.0)
                        nodes["feature"][at], nodes["threshold"][at] = int(j), float(cuts[j][b])
                        nodes["left"][at], nodes["right"][at] = a, z
                        move[i] = len(children), len(children) + 1
                        children += [a, z]
                    else:
                        nodes["value"][at] = float(-rate * sums_g[i] / (sums_h[i] + ridge))
                rows = np.flatnonzero(live)
                at = own[rows]
                ends = move[at, 0] < 0
                step[rows[ends]] = np.array([nodes["value"][v] for v in level])[at[ends]]
                goes = binned[rows, where[at, 0]] > where[at, 1]
                own[rows] = np.where(ends, -1, np.where(goes, move[at, 1], move[at, 0]))
                level = children
                if not level:
                    break
            margin += step
    if not roots:
        roots.append(leaf(0.0))
    arrays = {k: np.array(v, dtype=np.float64 if k in ("threshold", "value") else np.int64) for k, v in nodes.items()}
    return Forest(**arrays, roots=np.array(roots), depth=depth, base=base)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit: rising scores and the calibrated probabilities at them."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # lowest score, highest score, sum, count
    for s, v in zip(score[order], y[order]):
        blocks.append([s, s, float(v), 1.0])
        while len(blocks) > 1 and (blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3] or blocks[-2][1] == blocks[-1][0]):
            a, b = blocks.pop(-2), blocks.pop()
            blocks.append([a[0], b[1], a[2] + b[2], a[3] + b[3]])
    if not blocks:
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    # half a count of either class keeps the ends off 0 and 1
    xs = np.array([v for b in blocks for v in (b[0], b[1])])
    ys = np.repeat([(b[2] + 0.5) / (b[3] + 1) for b in blocks], 2)
    return xs, np.maximum.accumulate(ys)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out, limit: int) -> DataFrame:
    """``doc_id, text, y`` of at most ``limit`` labelled training documents, chosen by a hash of the id.

    ``held_out`` maps the id column to a condition. Conflicting repeated labels
    count as the larger one; null labels and ids are left out. The chosen ids,
    ``limit`` at most, are broadcast; the documents are not shuffled. Of rows that
    repeat an id the smallest text counts, so there are at most ``limit`` rows.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).withColumnRenamed("doc_id", "_id")
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
