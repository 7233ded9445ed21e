"""Array-column arithmetic for ARRAY<DOUBLE> vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_EPS = 1e-8


def _zero() -> Column:
    return F.lit(0.0)


def vsum(v: Column) -> Column:
    return F.aggregate(v, _zero(), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, _zero(), lambda acc, x: acc + x * x))


def dot(a: Column, b: Column) -> Column:
    return vsum(F.zip_with(a, b, lambda x, y: x * y))


def l2_normalize(v: Column, eps: float = NORM_EPS) -> Column:
    """x / (||x|| + eps)."""
    length = norm(v) + F.lit(eps)
    return F.transform(v, lambda x: x / length)
