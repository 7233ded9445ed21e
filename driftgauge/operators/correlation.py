"""Pearson and Spearman correlation per group, with two-sided p-values."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgauge.operators.ordered import distribution


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def _betainc(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def p_value(r: float | None, n: int) -> float | None:
    """Two-sided Student-t p-value of a correlation."""
    if r is None or math.isnan(r) or n < 3:
        return None
    df = n - 2
    return _betainc(df / 2.0, 0.5, max(0.0, 1.0 - r * r))


@F.pandas_udf(T.DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([p_value(None if pd.isna(a) else float(a), int(b)) for a, b in zip(r, n)], dtype="float64")


def complete_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows in which both sides are numbers (NULL and NaN are not)."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return df.where(a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b))


def pearson(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Correlation and number of complete pairs per group; NULL where a side is constant."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return complete_pairs(df, x, y).groupBy(*keys).agg(r.alias("r"), F.count(F.lit(1)).alias("n"))


def _centred_ranks(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Average rank minus the mean rank, a row of weight w counting as w rows."""
    dist = distribution(df, keys, value, {"__n": F.col("__w")})
    rank = F.col("__n_before") + (F.col("__n") + 1) / 2.0 - (F.col("__n_total") + 1) / 2.0
    return df.join(dist.select(*keys, value, rank.alias(out)), [*keys, value])


def spearman(df: DataFrame, keys: list[str], x: str, y: str, weight: Column | None = None) -> DataFrame:
    """Correlation of average ranks over complete pairs (optionally weighted); NULL where a side is constant.

    Ranks come from range-bucketed prefix counts and are centred exactly, so the sums need
    no second pass.
    """
    w = F.lit(1) if weight is None else weight
    slim = complete_pairs(df, x, y).select(
        *keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"), w.cast("bigint").alias("__w")
    )
    ranked = _centred_ranks(_centred_ranks(slim, keys, "__x", "__a"), keys, "__y", "__b")
    n, a, b = F.col("__w"), F.col("__a"), F.col("__b")
    rho = F.try_divide(F.sum(n * a * b), F.sqrt(F.sum(n * a * a) * F.sum(n * b * b)))
    return ranked.groupBy(*keys).agg(rho.alias("rho"), F.sum(n).alias("n"))


def with_p_value(df: DataFrame, r: str, out: str = "p_value") -> DataFrame:
    return df.withColumn(out, correlation_p(F.col(r), F.col("n")))
