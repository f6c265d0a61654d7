"""Vector arithmetic on arrays, on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column, least: float = 1e-12) -> Column:
    """v divided by its norm, or by `least` if that is larger. The norm is computed once."""
    scaled = F.transform(F.array(F.greatest(norm(v), F.lit(least))), lambda n: F.transform(v, lambda x: x / n))
    return F.get(scaled, F.lit(0))


def mrl_truncate(v: Column, dims: int) -> Column:
    """The first dims numbers, scaled to length one."""
    head = F.slice(v, 1, dims)
    return F.get(F.transform(F.array(norm(head) + F.lit(1e-12)), lambda n: F.transform(head, lambda x: x / n)), F.lit(0))


def distance(a: Column, b: Column, eps: float = 0.0) -> Column:
    """Euclidean distance; eps is added to each difference, as some loss definitions do."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y + eps) * (x - y + eps)), F.lit(0.0), lambda s, x: s + x))
