"""How well a score separates in-distribution (ID) from shifted rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgauge.functions.scores import finite_or_error
from driftgauge.operators.ordered import distribution_checked, exact_percentiles, percentile_from

ID_TAIL = 0.05
# Score methods whose intervals are bootstrapped; the others report NULL limits.
BOOTSTRAPPED_METHODS = ("msp", "energy", "mahalanobis", "knn")


def _checked(df: DataFrame, keys: list[str], score: str, score_type: str) -> DataFrame:
    name = F.concat_ws("/", *keys) if keys else F.lit(score)
    return df.withColumn(score, finite_or_error(F.col(score).cast("double"), name).cast(score_type))


def score_distribution(
    df: DataFrame,
    keys: list[str],
    score: str = "score",
    is_id: str = "is_id",
    weight: Column | None = None,
    score_type: str = "double",
) -> tuple[DataFrame, bool]:
    """Distinct scores per cell with ID / OOD counts and running counts; ranged?"""
    w = weight if weight is not None else F.lit(1)
    one = F.col(is_id)
    return distribution_checked(
        _checked(df, keys, score, score_type),
        keys,
        score,
        {"n_id": F.when(one, w).otherwise(0), "n_ood": F.when(one, 0).otherwise(w)},
    )


def auroc_from() -> Column:
    """Aggregate over a score distribution; ties count one half."""
    n_id, n_ood = F.col("n_id").cast("double"), F.col("n_ood").cast("double")
    wins = F.sum(n_id * (F.col("n_ood_before") + 0.5 * n_ood))
    pairs = F.max("n_id_total").cast("double") * F.max("n_ood_total")
    return F.try_divide(wins, pairs)


def auroc(df: DataFrame, keys: list[str], **kw) -> DataFrame:
    """AUROC with ID as the positive class, one row per cell."""
    return score_distribution(df, keys, **kw)[0].groupBy(*keys).agg(auroc_from().alias("auroc"))


def separability(df: DataFrame, keys: list[str], score: str = "score", **kw) -> DataFrame:
    """AUROC, FPR at 95 % ID recall, its threshold and the counts, one row per cell.

    The threshold is the 5th ID percentile; FPR counts OOD strictly above it. While a cell
    fits a task everything comes out of one sort; beyond that the threshold table (one row
    per cell) is joined back to the ranged distribution.
    """
    dist, ranged = score_distribution(df, keys, score=score, **kw)
    facts = [
        auroc_from().alias("auroc"),
        F.max("n_id_total").alias("n_id"),
        F.max("n_ood_total").alias("n_ood"),
    ]
    above = F.sum(F.when(F.col(score) > F.col("threshold"), F.col("n_ood")).otherwise(0))
    if not ranged:
        whole = Window.partitionBy(*(keys or [F.lit(0)]))
        flat = dist.withColumn("threshold", percentile_from(score, "n_id", ID_TAIL, over=whole))
        head = flat.groupBy(*keys).agg(*facts, F.max("threshold").alias("thr"), above.alias("__above"))
    else:
        thr = dist.groupBy(*keys).agg(*facts, percentile_from(score, "n_id", ID_TAIL).alias("thr"))
        over = (
            dist.select(*keys, score, "n_ood")
            .join(thr.select(*keys, F.col("thr").alias("threshold")), keys)
            .groupBy(*keys)
            .agg(above.alias("__above"))
        )
        head = thr.join(over, keys)
    return head.select(
        *keys,
        "auroc",
        F.try_divide(F.col("__above").cast("double"), F.col("n_ood")).alias("fpr95"),
        F.col("thr").alias("threshold"),
        "n_id",
        "n_ood",
    )


def operating_point(df: DataFrame, keys: list[str], score: str = "score", is_id: str = "is_id") -> DataFrame:
    """ID / OOD rows strictly above the 95 %-recall threshold, and the precision (0 if none)."""
    thr = separability(df, keys, score=score, is_id=is_id).select(*keys, "threshold")
    above = F.col(score) > F.col("threshold")
    hit = df.select(*keys, score, is_id).join(thr, keys).groupBy(*keys).agg(
        F.max("threshold").alias("threshold"),
        F.count_if(F.col(is_id) & above).alias("tp"),
        F.count_if(~F.col(is_id) & above).alias("fp"),
    )
    precision = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))
    return hit.withColumn("precision", F.coalesce(precision, F.lit(0.0)))


def sign_audit(df: DataFrame, keys: list[str], score: str = "score", is_id: str = "is_id") -> DataFrame:
    """Is a below-chance AUROC a sign error? AUROC, flipped AUROC and location flags."""
    flipped = auroc(df.withColumn(score, -F.col(score)), keys, score=score, is_id=is_id)
    head = auroc(df, keys, score=score, is_id=is_id).join(
        flipped.withColumnRenamed("auroc", "auroc_flipped"), keys
    )
    medians = exact_percentiles(
        df.withColumn("__side", F.when(F.col(is_id), "id").otherwise("ood")), [*keys, "__side"], score, {"m": 0.5}
    )
    medians = medians.groupBy(*keys).agg(
        F.max(F.when(F.col("__side") == "id", F.col("m"))).alias("id_median"),
        F.max(F.when(F.col("__side") == "ood", F.col("m"))).alias("ood_median"),
    )
    means = df.groupBy(*keys).agg(
        F.avg(F.when(F.col(is_id), F.col(score))).alias("id_mean"),
        F.avg(F.when(~F.col(is_id), F.col(score))).alias("ood_mean"),
    )
    return (
        head.join(means, keys)
        .join(medians, keys)
        .withColumn("ood_minus_id_mean", F.col("ood_mean") - F.col("id_mean"))
        .withColumn("sum_to_one", F.abs(F.col("auroc") + F.col("auroc_flipped") - 1.0) < 1e-6)
        .withColumn("below_chance", F.col("auroc") < 0.5)
        .withColumn("ood_more_confident", F.col("ood_mean") > F.col("id_mean"))
    )


def sign_family_flags(audit: DataFrame, keys: list[str]) -> DataFrame:
    """Whole-family flags over the audited methods of a cell."""
    return audit.groupBy(*keys).agg(
        F.bool_and("below_chance").alias("family_all_below_chance"),
        (~F.bool_and("sum_to_one")).alias("sign_bug_suspected"),
        F.count(F.lit(1)).alias("n_methods"),
    )


def score_comparison(points: DataFrame, intervals: DataFrame, keys: list[str], method: str = "method") -> DataFrame:
    """Point estimates joined to bootstrap limits; methods without a bootstrap keep NULL limits."""
    limits = intervals.where(F.col(method).isin(*BOOTSTRAPPED_METHODS))
    return points.join(limits, [*keys, method], "left")
