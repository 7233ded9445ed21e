"""Bootstrap intervals and permutation nulls.

A replicate is one more grouping key: rows get a weight per replicate and the metric
operators run unchanged on (cell, rep). Draws come from keyed hashes, so paired designs
share draws by sharing the key and recomputed tasks repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgauge.functions.draws import MODULUS, keyed_hash, poisson_weight, wide_hash
from driftgauge.operators import coverage as C
from driftgauge.operators.correlation import spearman
from driftgauge.operators.dispersion import CVID_EPS, TRIM_SHARE, _trimmed
from driftgauge.operators.ordered import distribution, exact_percentiles, prefix_sums
from driftgauge.operators.ranks import concordance, item_ranks, kendall_w
from driftgauge.operators.separability import separability

N_BOOTSTRAP = 1000
N_PERMUTATIONS = 10_000
CI_LOW, CI_HIGH = 0.025, 0.975
# Tolerance when a null statistic is compared with the observed one.
TIE_EPS = 1e-12
Z95 = 1.959963984540054


def with_replicates(df: DataFrame, n_reps: int) -> DataFrame:
    """Every row once per replicate.

    The rows are spread first: a few input partitions would otherwise make all copies.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n_reps))))


def poisson_replicates(df: DataFrame, sample_id: str, n_reps: int, seed: int) -> DataFrame:
    """Poisson(1) weight per (rep, sample): map-side only, any size. Zero weights are dropped."""
    reps = with_replicates(df, n_reps).withColumn("__h", keyed_hash(seed, F.col("rep"), F.col(sample_id)))
    return reps.withColumn("weight", poisson_weight(F.col("__h"))).drop("__h").where("weight > 0")


def multinomial_replicates(
    df: DataFrame, pool: list[str], sample_id: str, n_reps: int, seed: int
) -> DataFrame:
    """Exactly n draws with replacement from each pool of n samples, per replicate.

    The sample at position j of its pool makes draw j of every replicate; draws are counted
    by target position before they meet the rows. Rows of several methods or models that
    share (pool, sample) share the draw.
    """
    samples = df.select(*pool, sample_id).distinct()
    placed = prefix_sums(samples, pool, sample_id, {"n": F.lit(1).cast("bigint")}).select(
        *pool, sample_id, F.col("n_before").alias("__pos"), F.col("n_total").alias("__size")
    )
    target = (wide_hash(seed, F.col("rep"), F.col("__pos")) % F.col("__size")).alias("__pos")
    drawn = (
        with_replicates(placed, n_reps)
        .select(*pool, "rep", target)
        .groupBy(*pool, "rep", "__pos")
        .agg(F.count(F.lit(1)).alias("weight"))
    )
    weights = drawn.join(placed.drop("__size"), [*pool, "__pos"]).drop("__pos")
    return df.join(weights, [*pool, sample_id])


def percentile_ci(reps: DataFrame, keys: list[str], stats: list[str]) -> DataFrame:
    """2.5 / 97.5 percentiles of replicate statistics, ``<stat>_ci_low`` / ``_ci_high``."""
    long = reps.unpivot([*keys], stats, "__stat", "__value").where("__value is not null")
    ci = exact_percentiles(long, [*keys, "__stat"], "__value", {"lo": CI_LOW, "hi": CI_HIGH})
    aggs = []
    for s in stats:
        mine = F.col("__stat") == s
        aggs += [F.max(F.when(mine, F.col("lo"))).alias(f"{s}_ci_low"), F.max(F.when(mine, F.col("hi"))).alias(f"{s}_ci_high")]
    return ci.groupBy(*keys).agg(*aggs)


def separability_ci(weighted: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Bootstrap limits of AUROC and FPR95 from rows carrying (rep, weight)."""
    reps = separability(weighted, [*keys, "rep"], score=score, weight=F.col("weight"))
    return percentile_ci(reps, keys, ["auroc", "fpr95"])


def delta_auroc_ci(reps: DataFrame, keys: list[str], a: str, b: str, method: str = "method") -> DataFrame:
    """Limits of AUROC(a) - AUROC(b) from replicate AUROCs on shared draws."""
    pick = lambda m: F.max(F.when(F.col(method) == m, F.col("auroc")))
    return percentile_ci(
        reps.groupBy(*keys, "rep").agg((pick(a) - pick(b)).alias("delta_auroc")), keys, ["delta_auroc"]
    )


def coverage_reps(weighted: DataFrame, keys: list[str], target: float = 0.10, **kw) -> DataFrame:
    """Coverage at a risk target per (keys, rep)."""
    curve = C.risk_curve(weighted, [*keys, "rep"], weight=F.col("weight"), **kw)
    cov = C.coverage_at_risk(curve, [*keys, "rep"], (target,))
    return cov.select(*keys, "rep", F.col(f"coverage_at_risk{round(target * 100)}").alias("coverage"))


def paired_difference_ci(reps: DataFrame, keys: list[str], member: str, a: str, b: str, stat: str = "coverage") -> DataFrame:
    """Limits of stat(a), stat(b) and stat(a) - stat(b) over shared replicates."""
    pick = lambda m: F.max(F.when(F.col(member) == m, F.col(stat)))
    both = reps.groupBy(*keys, "rep").agg(pick(a).alias("a"), pick(b).alias("b"))
    return percentile_ci(both.withColumn("difference", F.col("a") - F.col("b")), keys, ["a", "b", "difference"])


def dispersion_gap_reps(weighted: DataFrame, keys: list[str], side: str = "side") -> DataFrame:
    """OOD - ID gaps of CVID and trimmed LogitGap mean per (keys, rep)."""
    k = [*keys, "rep", side, "measure"]
    ids = [*keys, "rep", side, "weight"]
    long = weighted.select(*ids, "logit_norm", "logit_gap").unpivot(ids, ["logit_norm", "logit_gap"], "measure", "value")
    trim = _trimmed(distribution(long, k, "value", {"n": F.col("weight")}), k, "value", TRIM_SHARE)
    stat = F.when(
        F.col("measure") == "logit_norm", F.col("trim_std") / (F.abs("trim_mean") + F.lit(CVID_EPS))
    ).otherwise(F.col("trim_mean"))
    of = lambda name, s: F.max(F.when((F.col("measure") == name) & (F.col(side) == s), stat))
    # NULL unless both sides drew something
    return trim.groupBy(*keys, "rep").agg(
        (of("logit_norm", "OOD") - of("logit_norm", "ID")).alias("cvid_gap"),
        (of("logit_gap", "OOD") - of("logit_gap", "ID")).alias("logit_gap_gap"),
    )


def _copies(weighted: DataFrame) -> DataFrame:
    """Weight w as w equal rows (w averages one)."""
    return weighted.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int")))).drop("__copy", "weight")


def spearman_reps(weighted: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation per (keys, rep), weighted rows counting as that many rows."""
    return spearman(weighted, [*keys, "rep"], x, y, weight=F.col("weight"))


def spread_reps(weighted: DataFrame, keys: list[str], value: str = "auroc") -> DataFrame:
    """Sample standard deviation of a resampled value per (keys, rep)."""
    return _copies(weighted).groupBy(*keys, "rep").agg(F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("spread"))


def normal_draw(seed: int, *keys: Column) -> Column:
    """Standard normal by Box-Muller from two keyed hashes."""
    u1 = (keyed_hash(seed, *keys) + F.lit(1)) / F.lit(float(MODULUS + 1))
    u2 = keyed_hash(seed + 1, *keys) / F.lit(float(MODULUS))
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2.0 * 3.141592653589793) * u2)


def parametric_spread_reps(cells: DataFrame, n_reps: int, seed: int) -> DataFrame:
    """Mean spread per (method, rep) with AUROC ~ N(point, (hi - lo) / 2z).

    Expects (domain, method, backbone, cell_id, auroc, ci_low, ci_high); cells without an
    interval stay at their point value.
    """
    se = F.coalesce((F.col("ci_high") - F.col("ci_low")) / F.lit(2.0 * Z95), F.lit(0.0))
    draws = with_replicates(cells.withColumn("__se", se), n_reps).withColumn(
        "draw",
        F.when(F.col("__se") > 0, F.col("auroc") + F.col("__se") * normal_draw(seed, F.col("rep"), F.col("cell_id"))).otherwise(
            F.col("auroc")
        ),
    )
    per_domain = draws.groupBy("domain", "method", "rep").agg(F.stddev_samp("draw").alias("spread"))
    return per_domain.groupBy("method", "rep").agg(F.avg("spread").alias("mean_spread"))


def spread_win_rate(reps: DataFrame, champion: str) -> DataFrame:
    """Share of replicates in which the champion's mean spread is below each other method's."""
    mine = reps.where(F.col("method") == champion).select("rep", F.col("mean_spread").alias("__c"))
    return (
        reps.where(F.col("method") != champion)
        .join(mine, "rep")
        .groupBy("method")
        .agg(F.avg((F.col("__c") < F.col("mean_spread")).cast("double")).alias("p_champion_lower"))
    )


def w_null_free(df: DataFrame, group: list[str], rater: str, item: str, n_perm: int, seed: int) -> DataFrame:
    """Null W per (group, rep): every rater gets a random order of the items.

    Expects numeric ``rater_no`` / ``item_no`` columns next to the names.
    """
    reps = with_replicates(df.select(*group, rater, item, "rater_no", "item_no"), n_perm)
    h = keyed_hash(seed, F.col("rep"), F.col("rater_no"), F.col("item_no"))
    w = Window.partitionBy(*group, "rep", rater).orderBy(h, F.col("item_no"))
    ranked = reps.withColumn("rank", F.row_number().over(w).cast("double")).withColumn("__tied", F.lit(1).cast("bigint"))
    return concordance(ranked, [*group, "rep"], item)


def w_null_locked(
    df: DataFrame, group: list[str], rater: str, item: str, value: str, locked: tuple[str, ...], n_perm: int, seed: int
) -> DataFrame:
    """Null W with the locked items' ranks fixed; the others' ranks are dealt among their slots.

    One rater's items are a handful, so its deal is an array operation inside a row.
    """
    ranked = item_ranks(df, [*group, rater], value)
    fixed = with_replicates(ranked.where(F.col(item).isin(*locked)), n_perm).select(*group, "rep", item, "rank", "__tied")
    free = with_replicates(ranked.where(~F.col(item).isin(*locked)), n_perm)
    h = keyed_hash(seed, F.col("rep"), F.col("rater_no"), F.col("item_no"))
    dealt = free.groupBy(*group, "rep", rater).agg(
        F.sort_array(F.collect_list(F.struct(F.col("item_no"), F.col(item).alias("item")))).alias("slots"),
        F.sort_array(F.collect_list(F.struct(h.alias("h"), F.col("item_no"), F.col("rank"), F.col("__tied")))).alias("hand"),
    )
    moved = dealt.select(
        *group, "rep", F.explode(F.arrays_zip(F.col("slots.item").alias("item"), F.col("hand").alias("hand"))).alias("z")
    ).select(*group, "rep", F.col("z.item").alias(item), F.col("z.hand.rank").alias("rank"), F.col("z.hand.__tied").alias("__tied"))
    return concordance(fixed.unionByName(moved), [*group, "rep"], item)


def permutation_p(null: DataFrame, observed: DataFrame, keys: list[str], stat: str) -> DataFrame:
    """(hits + 1) / (B + 1) in both directions."""
    o, v = F.col("__obs"), F.col(stat)
    joined = null.select(*keys, stat).join(observed.select(*keys, F.col(stat).alias("__obs")), keys)
    n = F.count(F.lit(1)) + 1
    return joined.groupBy(*keys).agg(
        F.max("__obs").alias(f"{stat}_observed"),
        ((F.count_if(v >= o - F.lit(TIE_EPS)) + 1) / n).alias("p_greater"),
        ((F.count_if(v <= o + F.lit(TIE_EPS)) + 1) / n).alias("p_less"),
    )


def w_permutation_test(
    df: DataFrame, group: list[str], rater: str, item: str, value: str, n_perm: int = N_PERMUTATIONS,
    locked: tuple[str, ...] | None = None, seed: int = 42,
) -> DataFrame:
    observed = kendall_w(df, group, [rater], item, value)
    if locked is None:
        null = w_null_free(df, group, rater, item, n_perm, seed)
    else:
        null = w_null_locked(df, group, rater, item, value, locked, n_perm, seed)
    return permutation_p(null, observed, group, "kendall_w")
