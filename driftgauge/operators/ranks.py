"""Rank concordance across raters: ranks, Kendall's W, jackknives, spreads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FEATURE_METHODS = ("mahalanobis", "knn")
LOGIT_METHODS = ("msp", "energy", "logit_norm")
COMMON_METHODS = ("msp", "energy", "mahalanobis", "knn")


def item_ranks(df: DataFrame, rater: list[str], value: str, out: str = "rank") -> DataFrame:
    """Average-tie ranks of the items of one rater, 1 = highest.

    A rater scores a handful of methods, so one window per rater is small by design.
    """
    by_rater = Window.partitionBy(*rater).orderBy(F.col(value).desc())
    tied = Window.partitionBy(*rater, value)
    return df.withColumn("__tied", F.count(F.lit(1)).over(tied)).withColumn(
        out, F.rank().over(by_rater) + (F.col("__tied") - 1) / 2.0
    )


def votes(df: DataFrame, value: str) -> DataFrame:
    """Rows that carry a number: NULL and NaN are no votes."""
    return df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))


def complete_raters(df: DataFrame, group: list[str], rater: list[str], item: str, value: str) -> DataFrame:
    """The votes of raters that miss no item seen in their group; a NULL or NaN value is a missing item."""
    keys = [*group, *rater]
    need = df.select(*group, item).distinct().groupBy(*group).agg(F.count(F.lit(1)).alias("__need"))
    cast = votes(df, value)
    have = cast.groupBy(*keys).agg(F.count_distinct(item).alias("__have"))
    joined = have.join(need, group) if group else have.withColumn("__need", need.scalar())
    full = joined.where("__have = __need").select(*keys)
    return cast.join(full, keys, "left_semi")


def concordance(ranked: DataFrame, group: list[str], item: str, rank: str = "rank") -> DataFrame:
    """Tie-corrected Kendall's W and Friedman's chi-square from ranked rows.

    ``__tied`` (rows sharing a rank within the rater) gives the tie correction: summing
    t^2 - 1 over rows equals summing t^3 - t over tie groups.
    """
    per_item = ranked.groupBy(*group, item).agg(
        F.sum(rank).alias("R"), F.count(F.lit(1)).alias("k"), F.sum(F.col("__tied") * F.col("__tied") - 1).alias("T")
    )
    per_group = per_item.groupBy(*group).agg(
        F.max("k").alias("n_raters"),
        F.count(F.lit(1)).alias("n_items"),
        (F.sum(F.col("R") * F.col("R")) - F.sum("R") * F.sum("R") / F.count(F.lit(1))).alias("S"),
        F.sum("T").alias("T"),
    )
    k, n = F.col("n_raters").cast("double"), F.col("n_items").cast("double")
    denom = k * k * (n * n * n - n) - k * F.col("T")
    w = F.when((k >= 2) & (n >= 2) & (denom > 0), F.lit(12.0) * F.col("S") / denom)
    return per_group.select(
        *group, "n_raters", "n_items", w.alias("kendall_w"), (k * (n - 1) * w).alias("friedman_chi2")
    )


def kendall_w(df: DataFrame, group: list[str], rater: list[str], item: str, value: str) -> DataFrame:
    """Kendall's W per group over complete raters; NULL for a single rater.

    An item counts as seen in its group if any row names it, even with a NULL value, so a rater with a NULL cell is
    incomplete and does not vote.
    """
    rows = complete_raters(df, group, rater, item, value)
    return concordance(item_ranks(rows, [*group, *rater], value), group, item)


def leave_one_out(df: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Replicate each group once per member, without that member, tagged ``held_out``.

    Members (backbones, domains) are few; the row count grows by their number.
    """
    if keys:
        copies = df.join(df.select(*keys, F.col(member).alias("held_out")).distinct(), keys)
    else:
        copies = df.withColumn("held_out", F.explode(df.agg(F.collect_set(member)).scalar()))
    return copies.where(F.col(member) != F.col("held_out"))


def jackknife_w(df: DataFrame, group: list[str], rater: str, item: str, value: str) -> DataFrame:
    """W without each rater, and its distance to the full W."""
    full = kendall_w(df, group, [rater], item, value).select(*group, F.col("kendall_w").alias("full_w"))
    loo = kendall_w(leave_one_out(df, group, rater), [*group, "held_out"], [rater], item, value)
    return loo.join(full, group).select(
        *group, "held_out", "n_raters", "kendall_w", (F.col("kendall_w") - F.col("full_w")).alias("delta_vs_full")
    )


def spread(df: DataFrame, keys: list[str], value: str = "auroc") -> DataFrame:
    """Count, mean and sample standard deviation over raters (0 for a single rater)."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_backbones"),
        F.avg(value).alias("mean_auroc"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("spread"),
    )


def spread_wide(df: DataFrame, backbones: list[str], value: str = "auroc") -> DataFrame:
    """Spread table with one ``auroc_<backbone>`` column per named backbone."""
    wide = df.groupBy("domain", "method").pivot("backbone", backbones).agg(F.first(value))
    for b in backbones:
        wide = wide.withColumnRenamed(b, f"auroc_{b}")
    return spread(df, ["domain", "method"], value).join(wide, ["domain", "method"])


def mean_spread(spreads: DataFrame) -> DataFrame:
    return spreads.groupBy("method").agg(
        F.avg("spread").alias("mean_spread"), F.count(F.lit(1)).alias("n_domains")
    )


def leave_one_domain_spread(df: DataFrame, value: str = "auroc") -> DataFrame:
    """Mean per-domain spread by method, over all domains (held_out '(none)') and without each.

    Only domains with at least two backbones count, held out or kept.
    """
    per = spread(df, ["domain", "method"], value).where("n_backbones >= 2")
    all_ = mean_spread(per).withColumn("held_out", F.lit("(none)"))
    domains = df.agg(F.collect_set("domain")).scalar()
    loo = (
        per.withColumn("held_out", F.explode(domains))
        .where("domain != held_out")
        .groupBy("method", "held_out")
        .agg(F.avg("spread").alias("mean_spread"), F.count(F.lit(1)).alias("n_domains"))
    )
    return all_.unionByName(loo)


def rank_pivot(ranked: DataFrame, keys: list[str], rater: str, raters: list[str], rank: str = "rank") -> DataFrame:
    """Ranks as a matrix: one row per key, one column per rater."""
    return ranked.groupBy(*keys).pivot(rater, raters).agg(F.first(rank))


def method_summary(spreads: DataFrame) -> DataFrame:
    """Per method: mean AUROC, mean spread and their difference over domains."""
    return spreads.groupBy("method").agg(
        F.avg("mean_auroc").alias("mean_auroc"),
        F.avg("spread").alias("mean_spread"),
        (F.avg("mean_auroc") - F.avg("spread")).alias("mean_minus_spread"),
    )
