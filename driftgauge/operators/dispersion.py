"""Location, spread and trimmed statistics of per-sample quantities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.functions.scores import logit_gap, logit_norm
from driftgauge.operators.ordered import distribution, exact_percentiles, kept_after_trim, percentile_from

# Fixed values of the published metric definitions.
TRIM_SHARE = 0.01
CVID_EPS = 1e-8
PROFILE_TRIMS = (0.0, 0.01, 0.05, 0.10)
IQR_FENCE = 3.0


def _trimmed(dist: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """Two passes (mean, then centred squares) so that a large mean costs no precision."""
    kept = dist.select(*keys, value, kept_after_trim("n", share).cast("double").alias("__kept")).where("__kept > 0")
    mean = kept.groupBy(*keys).agg(
        (F.sum(F.col("__kept") * F.col(value)) / F.sum("__kept")).alias("trim_mean"),
        F.sum("__kept").cast("bigint").alias("n_kept"),
    )
    dev = F.col(value) - F.col("trim_mean")
    return (
        kept.join(mean, keys)
        .groupBy(*keys)
        .agg(
            F.max("trim_mean").alias("trim_mean"),
            F.sqrt(F.sum(F.col("__kept") * dev * dev) / F.sum("__kept")).alias("trim_std"),
            F.max("n_kept").alias("n_kept"),
        )
    )


def trimmed_stats(df: DataFrame, keys: list[str], value: str, share: float = TRIM_SHARE) -> DataFrame:
    """Mean and population std after dropping floor(share*n) rows from each tail."""
    return _trimmed(distribution(df, keys, value, {"n": F.lit(1)}), keys, value, share)


def cvid(df: DataFrame, keys: list[str], value: str = "logit_norm") -> DataFrame:
    """Coefficient of variation of the trimmed values."""
    return trimmed_stats(df, keys, value).select(
        *keys, (F.col("trim_std") / (F.abs("trim_mean") + F.lit(CVID_EPS))).alias("cvid_logit_norm")
    )


def with_logit_measures(df: DataFrame, logits: str = "logits") -> DataFrame:
    return df.withColumn("logit_norm", logit_norm(F.col(logits))).withColumn("logit_gap", logit_gap(F.col(logits)))


def logit_dispersion(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per cell: moments and median of logit norms, CVID, trimmed gap statistics.

    Both measures travel through one sorted distribution keyed by measure.
    """
    long = df.select(*keys, "logit_norm", "logit_gap").unpivot(
        keys, ["logit_norm", "logit_gap"], "measure", "value"
    )
    k = [*keys, "measure"]
    dist = distribution(long, k, "value", {"n": F.lit(1)})
    trim = _trimmed(dist, k, "value", TRIM_SHARE)
    mid = dist.groupBy(*k).agg(percentile_from("value", "n", 0.5).alias("median"))
    raw = long.groupBy(*k).agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("n")
    )
    all_ = raw.join(mid, k).join(trim, k)
    norm, gap = F.col("measure") == "logit_norm", F.col("measure") == "logit_gap"

    def pick(cond, col):
        return F.max(F.when(cond, F.col(col)))

    return all_.groupBy(*keys).agg(
        F.max("n").alias("n_samples"),
        pick(norm, "mean").alias("logit_norm_mean"),
        pick(norm, "std").alias("logit_norm_std"),
        pick(norm, "median").alias("logit_norm_median"),
        F.max(F.when(norm, F.col("trim_std") / (F.abs("trim_mean") + F.lit(CVID_EPS)))).alias("cvid_logit_norm"),
        pick(gap, "trim_mean").alias("logit_gap_mean"),
        pick(gap, "trim_std").alias("logit_gap_std"),
    )


def dispersion_table(df: DataFrame, keys: list[str], side: str = "side") -> DataFrame:
    """ID and OOD dispersion rows with OOD-minus-ID gaps (0 on the ID row)."""
    stats = logit_dispersion(df, [*keys, side])
    ref = stats.where(F.col(side) == "ID").select(
        *keys,
        F.col("cvid_logit_norm").alias("__cvid"),
        F.col("logit_norm_mean").alias("__norm"),
        F.col("logit_gap_mean").alias("__gap"),
    )
    return (
        stats.join(ref, keys)
        .withColumn("cvid_gap_vs_id", F.col("cvid_logit_norm") - F.col("__cvid"))
        .withColumn("logit_norm_mean_gap_vs_id", F.col("logit_norm_mean") - F.col("__norm"))
        .withColumn("logit_gap_mean_gap_vs_id", F.col("logit_gap_mean") - F.col("__gap"))
        .drop("__cvid", "__norm", "__gap")
    )


def robust_profile(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, median, tail percentiles, maximum, means under four trims, share beyond 3 IQR."""
    dist = distribution(df, keys, value, {"n": F.lit(1)})
    v = F.col(value)

    def trim_mean(share):
        kept = kept_after_trim("n", share).cast("double")
        return F.sum(kept * v) / F.sum(kept)

    head = dist.groupBy(*keys).agg(
        F.max("n_total").alias("n"),
        (F.sum(F.col("n") * v) / F.sum("n")).alias("mean"),
        *[
            percentile_from(value, "n", p).alias(a)
            for a, p in {"median": 0.5, "p01": 0.01, "p99": 0.99, "q1": 0.25, "q3": 0.75}.items()
        ],
        F.max(v).alias("max"),
        *[trim_mean(t).alias(f"trim_{int(t * 100):02d}") for t in PROFILE_TRIMS],
    )
    fence = F.lit(IQR_FENCE) * (F.col("q3") - F.col("q1"))
    out = (v < F.col("q1") - fence) | (v > F.col("q3") + fence)
    beyond = (
        dist.select(*keys, value, F.col("n").alias("__n"))
        .join(head.select(*keys, "q1", "q3"), keys)
        .groupBy(*keys)
        .agg((F.sum(F.when(out, F.col("__n")).otherwise(0)) / F.sum("__n")).alias("frac_beyond_3iqr"))
    )
    return head.drop("q1", "q3").join(beyond, keys)


def split_flag(df: DataFrame, keys: list[str], value: str, p: float, out: str = "flag") -> DataFrame:
    """'High' where value >= the group's percentile p, else 'Low'."""
    thr = exact_percentiles(df, keys, value, {"__thr": p})
    if not keys:
        return df.withColumn(out, F.when(F.col(value) >= thr.scalar(), "High").otherwise("Low"))
    flagged = df.join(thr, keys).withColumn(out, F.when(F.col(value) >= F.col("__thr"), "High").otherwise("Low"))
    return flagged.drop("__thr")


def dispersion_vs_separability(table: DataFrame, silhouette: DataFrame, gap_ci: DataFrame, keys: list[str], side: str = "side") -> DataFrame:
    """The two-row report per cell: dispersion, silhouette test, and gap limits on the OOD row only."""
    limits = [c for c in gap_ci.columns if c not in keys]
    joined = table.join(silhouette, keys).join(gap_ci, keys)
    return joined.withColumns({c: F.when(F.col(side) == "OOD", F.col(c)) for c in limits})
