"""Vector expressions over ``array<float|double>`` columns.

Sums run in index order in float64, so results are bit-identical to an
index-ordered list reduction in any other IEEE engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x: Column) -> Column:
    return x.cast("double")


def sq_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance (the collection's default metric)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (_d(x) - _d(y)) * (_d(x) - _d(y))),
                       F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: _d(x) * _d(y)), F.lit(0.0), lambda acc, v: acc + v)


def norm2(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + _d(v) * _d(v))


def mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + _d(v)) / F.size(a)


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two equal-length arrays; a constant array gives 1.0.

    (The frame comparison treats a zero-variance histogram as a perfect match;
    the plain formula would give NaN.)
    """
    ma, mb = mean(a), mean(b)
    cov = F.aggregate(F.zip_with(a, b, lambda x, y: (_d(x) - ma) * (_d(y) - mb)), F.lit(0.0), lambda s, v: s + v)
    va = F.aggregate(a, F.lit(0.0), lambda s, x: s + (_d(x) - ma) * (_d(x) - ma))
    vb = F.aggregate(b, F.lit(0.0), lambda s, y: s + (_d(y) - mb) * (_d(y) - mb))
    den = F.sqrt(va * vb)
    return F.when(den == 0, F.lit(1.0)).otherwise(cov / den)
