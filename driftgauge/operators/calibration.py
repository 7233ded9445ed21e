"""Accuracy, expected calibration error and temperature fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgauge.functions.scores import nll
from driftgauge.session import cut_lineage

N_BINS = 15
# Fixed search interval and tolerance of the temperature fit.
T_LOW, T_HIGH, T_TOLERANCE = 0.05, 10.0, 1e-4


def accuracy(df: DataFrame, keys: list[str], hit: str = "correct") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.col(hit).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def confidence_bin(conf: Column, n_bins: int = N_BINS) -> Column:
    """1-based equal-width bin, upper edge inclusive, first bin closed at 0."""
    width = 1.0 / n_bins
    bin_no = F.lit(1)
    for i in range(1, n_bins):
        bin_no = bin_no + (conf > F.lit(i * width)).cast("int")
    return bin_no


def reliability_bins(df: DataFrame, keys: list[str], conf: str, hit: str, n_bins: int = N_BINS) -> DataFrame:
    return (
        df.select(*keys, conf, hit, confidence_bin(F.col(conf), n_bins).alias("bin"))
        .groupBy(*keys, "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(conf).alias("mean_confidence"),
            F.avg(F.col(hit).cast("double")).alias("accuracy"),
        )
    )


def ece(df: DataFrame, keys: list[str], conf: str, hit: str, n_bins: int = N_BINS) -> DataFrame:
    """Sum over bins of |confidence - accuracy| weighted by the bin's share."""
    bins = reliability_bins(df, keys, conf, hit, n_bins)
    gap = F.abs(F.col("mean_confidence") - F.col("accuracy")) * F.col("n")
    return bins.groupBy(*keys).agg((F.sum(gap) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def binary_ece(df: DataFrame, keys: list[str], prob: str, label: str, n_bins: int = N_BINS) -> DataFrame:
    """ECE of a binary probability: confidence max(p, 1-p), prediction p > 0.5."""
    p = F.col(prob)
    prepared = df.select(
        *keys,
        F.greatest(p, 1.0 - p).alias("__conf"),
        ((p > 0.5).cast("int") == F.col(label)).alias("__hit"),
    )
    return ece(prepared, keys, "__conf", "__hit", n_bins)


def nll_curve(df: DataFrame, keys: list[str], temperatures: list[float], logits: str, label: str) -> DataFrame:
    """Mean negative log-likelihood for a list of temperatures in one aggregation."""
    cells = df.groupBy(*keys).agg(
        *[F.avg(nll(F.col(logits), F.col(label), t)).alias(f"t{i}") for i, t in enumerate(temperatures)]
    )
    pairs = F.array(*[F.struct(F.lit(float(t)).alias("t"), F.col(f"t{i}").alias("nll")) for i, t in enumerate(temperatures)])
    return cells.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.t", "p.nll")


def fit_temperature(
    df: DataFrame, keys: list[str], logits: str = "logits", label: str = "label", points: int = 16
) -> DataFrame:
    """Temperature with the least NLL per cell: a grid, then zooms around each cell's best point.

    Every round is one aggregation over the rows for all cells at once. The NLL is
    unimodal in T, so the minimum lies between the neighbours of the best grid point and
    the bracket shrinks by (points-1)/2 per round. The cell table (one row per cell)
    carries each bracket to the next round as a join, not through the driver.
    """
    slim = cut_lineage(df.select(*keys, logits, label))  # read once per round
    bracket = slim.groupBy(*keys).agg(F.lit(T_LOW).alias("lo"), F.lit(T_HIGH).alias("hi"))
    width = T_HIGH - T_LOW
    while width > T_TOLERANCE:
        step = (F.col("hi") - F.col("lo")) / (points - 1)
        joined = slim.join(bracket, keys)
        t_at = [F.col("lo") + step * i for i in range(points)]
        cells = joined.groupBy(*keys).agg(
            F.max("lo").alias("low"),
            F.max("hi").alias("high"),
            *[F.avg(nll(F.col(logits), F.col(label), t)).alias(f"n{i}") for i, t in enumerate(t_at)],
        )
        cells = cells.withColumnsRenamed({"low": "lo", "high": "hi"})
        grid = F.array(*[F.struct(F.col(f"n{i}").alias("nll"), t.alias("t")) for i, t in enumerate(t_at)])
        best = cells.select(*keys, "lo", "hi", F.array_min(grid).alias("b"))
        bracket = cut_lineage(
            best.select(
                *keys,
                F.greatest(F.lit(T_LOW), F.col("b.t") - step).alias("lo"),
                F.least(F.lit(T_HIGH), F.col("b.t") + step).alias("hi"),
                F.col("b.t").alias("t_star"),
                F.col("b.nll").alias("nll_at_tstar"),
            )
        )
        width = width * 2.0 / (points - 1)
        result = bracket.select(*keys, "t_star", "nll_at_tstar")
        bracket = bracket.drop("t_star", "nll_at_tstar")
    return result
