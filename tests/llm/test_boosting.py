"""Trees, calibration and the labelled sample of operators 7 and 9, against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import boosting


def walk(forest, row):
    """One row, tree by tree, node by node."""
    total = forest.base
    for node in forest.roots.tolist():
        while forest.left[node] != node:
            node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
        total += forest.value[node]
    return total


@pytest.mark.parametrize("depth", [1, 2, 5])
def test_margins_equal_a_walk_of_every_tree(depth):
    rng = np.random.default_rng(depth)
    x = np.round(rng.normal(size=(600, 6)), 1)  # ties
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=600) > 0).astype(float)
    forest = boosting.fit(x, y, trees=25, depth=depth)
    new = np.vstack([x[:50], rng.normal(size=(50, 6)) * 5, np.full((1, 6), np.inf)])
    assert np.allclose(forest.margin(new), [walk(forest, r) for r in new], rtol=0, atol=1e-9)
    far = new[:, None].repeat(60, axis=1).reshape(-1, 6)  # more rows than a slice
    assert np.allclose(forest.margin(far).reshape(len(new), 60), forest.margin(new)[:, None])


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(200, 3)), 1)
    y = (x[:, 2] + 0.4 * rng.normal(size=200) > 0.3).astype(float)
    forest = boosting.fit(x, y, trees=1, depth=1, bins=64)
    p = (y.sum() + 1) / (len(y) + 2)
    g, h = p - y, np.full(len(y), p * (1 - p))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1.0)
    root = forest.roots[0]
    own = x[:, forest.feature[root]] <= forest.threshold[root]
    found = gain(own) + gain(~own)
    best = 0.0
    for j in range(3):
        q = np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1]))
        for c in (q[:-1] + q[1:]) / 2:
            m = x[:, j] <= c
            if min(h[m].sum(), h[~m].sum()) >= 2.0:
                best = max(best, gain(m) + gain(~m))
    assert found == pytest.approx(best)
    for side, node in ((own, forest.left[root]), (~own, forest.right[root])):
        assert forest.value[node] == pytest.approx(-0.15 * g[side].sum() / (h[side].sum() + 1.0))


def test_calibration_is_the_isotonic_regression():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 40):
        for _ in range(20):
            score = np.sort(rng.choice(n * 10, n, replace=False)).astype(float)
            y = rng.integers(0, 2, n).astype(float)
            # the least-squares rising fit: largest, over starts, of the smallest, over ends, mean
            fit = [max(min(y[a:b].mean() for b in range(i + 1, n + 1)) for a in range(i + 1)) for i in range(n)]
            xs, ys = boosting.isotonic(score, y)
            got = dict(zip(xs.tolist(), ys.tolist()))
            for v in sorted(set(fit)):
                block = [i for i in range(n) if fit[i] == pytest.approx(v)]
                want = (y[block].sum() + 0.5) / (len(block) + 1)
                # smoothed by half a count of either class, and rising after that
                assert got[score[block[0]]] >= want - 1e-12 and got[score[block[-1]]] >= want - 1e-12
            blocks = [(a, b) for a, b in zip(xs[::2], xs[1::2])]
            starts = [i for i in range(n) if i == 0 or not fit[i] == pytest.approx(fit[i - 1])]
            assert [a for a, _ in blocks] == [score[i] for i in starts]
            assert (np.diff(ys) >= 0).all()


def test_sample_has_one_row_an_id(spark):
    docs = spark.range(5000).select((F.col("id") % 40).alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    docs = docs.union(spark.createDataFrame([(None, "x"), (3, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(4, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    got = boosting.labelled_sample(docs, labels, "toxic", lambda c: c % 4 == 3, 20).collect()
    assert len(got) == 20 and len({r["doc_id"] for r in got}) == 20
    assert all(r["doc_id"] % 4 != 3 and r["text"] is not None and r["y"] == (1 if r["doc_id"] == 4 else r["doc_id"] % 2) for r in got)
    assert boosting.labelled_sample(docs.limit(0), labels, "toxic", lambda c: c < 0, 20).count() == 0
