"""Vector algebra on ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l1(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x))


def l2(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def scale(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def normalized(a: Column) -> Column:
    n = l2(a)
    return F.transform(a, lambda x: x / F.greatest(n, F.lit(1e-12)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(l2(a) * l2(b), F.lit(1e-12))


def mean_vector(a: Column, size: int) -> Column:
    """Aggregate: the mean of the vectors of a group, dimension by dimension."""
    return F.array(*(F.avg(F.get(a, F.lit(i))) for i in range(size)))


def weighted_sum(w: Column, a: Column, size: int) -> Column:
    """Aggregate: the sum of w * a over a group."""
    return F.array(*(F.sum(w * F.get(a, F.lit(i))) for i in range(size)))


def quantize(a: Column) -> Column:
    """Symmetric 8-bit integers and their scale."""
    s = F.greatest(F.array_max(F.transform(a, F.abs)), F.lit(1e-12)) / 127.0
    return F.struct(F.transform(a, lambda x: F.bround(x / s).cast("tinyint")).alias("q"), s.alias("scale"))


def dequantize(q: Column) -> Column:
    return F.transform(q.getField("q"), lambda x: x * q.getField("scale"))


def gaussian(rows: int, size: int, seed: int = 42) -> list[list[float]]:
    """Rows of a random projection that keeps lengths on average."""
    import numpy as np

    return (np.random.default_rng(seed).standard_normal((rows, size)) / rows**0.5).tolist()
