"""Vector arithmetic as Column expressions over array columns; all arithmetic is in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(v) -> Column:
    return _c(v).cast("array<double>")


def floats(v) -> Column:
    return _c(v).cast("array<float>")


def total(v) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a, b) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def l2_norm(v) -> Column:
    return F.sqrt(total(F.transform(doubles(v), lambda x: x * x)))


def l2_distance(a, b) -> Column:
    """Direct form, so that a vector is at exactly 0 from itself."""
    return F.sqrt(total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def l2_normalize(v, eps: float = EPS) -> Column:
    n = l2_norm(v) + F.lit(eps)
    return F.transform(doubles(v), lambda x: x / n)


def clip(v, low: float, high: float) -> Column:
    return F.transform(doubles(v), lambda x: F.greatest(F.lit(low), F.least(F.lit(high), x)))


def zscore(v, mean, std, eps: float = EPS) -> Column:
    centred = F.zip_with(doubles(v), _c(mean), lambda x, m: x - m)
    return F.zip_with(centred, _c(std), lambda x, s: x / (s + F.lit(eps)))


def minmax(v, low, high, eps: float = EPS) -> Column:
    width = F.zip_with(_c(high), _c(low), lambda h, l: (h - l) + F.lit(eps))  # noqa: E741
    return F.zip_with(F.zip_with(doubles(v), _c(low), lambda x, l: x - l), width, lambda x, w: x / w)  # noqa: E741
