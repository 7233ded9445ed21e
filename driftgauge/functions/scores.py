"""Per-sample scores from logits. Every score reads "higher = more in-distribution"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftgauge.functions.vectors import norm, vsum


def _exp_total(z: Column, temperature: Column) -> Column:
    top = F.array_max(z)
    return F.aggregate(z, F.lit(0.0), lambda acc, x: acc + F.exp((x - top) / temperature))


def _as_col(v: Column | float) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def msp(z: Column, temperature: Column | float = 1.0) -> Column:
    """Maximum softmax probability; the max class contributes exp(0) = 1."""
    return F.lit(1.0) / _exp_total(z, _as_col(temperature))


def energy(z: Column, temperature: Column | float = 1.0) -> Column:
    """T * logsumexp(z / T)."""
    t = _as_col(temperature)
    return F.array_max(z) + t * F.ln(_exp_total(z, t))


def logit_norm(z: Column) -> Column:
    return norm(z)


def logit_gap(z: Column) -> Column:
    """Top logit minus the mean of the others (one copy of the maximum left out)."""
    top = F.array_max(z)
    return top - (vsum(z) - top) / (F.size(z) - 1)


def softmax(z: Column) -> Column:
    top = F.array_max(z)
    total = _exp_total(z, F.lit(1.0))
    return F.transform(z, lambda x: F.exp(x - top) / total)


def predicted_class(z: Column) -> Column:
    """Index of the first maximum."""
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def correct(z: Column, label: Column) -> Column:
    return (predicted_class(z) == label).cast("double")


def nll(z: Column, label: Column, temperature: Column | float = 1.0) -> Column:
    """Negative log-likelihood of the label at a temperature (floored at 1e-3)."""
    t = F.greatest(_as_col(temperature), F.lit(1e-3))
    return F.array_max(z) / t + F.ln(_exp_total(z, t)) - F.get(z, label) / t


def predicted_confidence(predicted: Column, p_positive: Column, positive: str) -> Column:
    return F.when(predicted == positive, p_positive).otherwise(1.0 - p_positive)


def finite_or_error(score: Column, name: Column | str) -> Column:
    """Pass finite scores through; NaN, infinite or missing scores stop the job."""
    label = name if isinstance(name, Column) else F.lit(name)
    bad = score.isNull() | F.isnan(score) | (F.abs(score) == F.lit(float("inf")))
    return F.when(bad, F.raise_error(F.concat(F.lit("non-finite score: "), label))).otherwise(score)
