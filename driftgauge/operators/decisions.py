"""Verdict tables: group, aggregate conditionally, then the first matching rule wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgauge.operators.tables import baseline_jump

# Thresholds of the published decision rules.
JUMP_DELTA = 0.15
FEATURE_DRAG = 0.10
SATURATED_MEDIAN = 0.95
SATURATED_MIN = 0.90
ID_FLOOR = 0.97
RHO_GATE = 0.5
R_NOTABLE = 0.6
TAIL_SHARE = 0.02
COLLAPSE_LOW, COLLAPSE_HIGH = 0.70, 0.85
SEED_HITS = 4
SHRINK_SHARE = 0.5
OUTLIER_MARGIN, BAND_MARGIN = 0.08, 0.05


def first_rule(rules: list[tuple[Column, str]], default: str) -> Column:
    """Ordered CASE: the first true condition gives the code; NULL conditions do not match."""
    return reduce(lambda acc, r: acc.when(r[0], r[1]), rules[1:], F.when(*rules[0])).otherwise(default)


def decision_table(
    df: DataFrame, keys: list[str], aggregates: dict[str, Column], rules: list[tuple[Column, str]], default: str,
    out: str = "verdict",
) -> DataFrame:
    agg = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return agg.withColumn(out, first_rule(rules, default))


def value_of(name: str, who: str, metric: str) -> Column:
    """The metric of one named row of the group."""
    return F.max(F.when(F.col(name) == who, F.col(metric)))


def scenario(
    auroc: DataFrame, keys: list[str], baseline: list[str], family: list[str], originals: list[str], n_required: int
) -> DataFrame:
    """Which explanation fits the MSP jump of a domain?

    C: a feature method of a new backbone fell more than 0.10 under the originals' median;
    A: a backbone outside baseline and family jumped by 0.15; B: only the family jumped;
    no_jump; pending with too few backbones or a missing baseline.
    """
    msp = auroc.where(F.col("method") == "msp")
    jumped = baseline_jump(msp, keys, "backbone", baseline, "auroc")
    hit = F.col("jump") >= JUMP_DELTA
    in_family, in_base = F.col("backbone").isin(family), F.col("backbone").isin(baseline)
    jumps = jumped.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_backbones"),
        F.count_if(in_base).alias("n_baseline"),
        F.count_if(hit & in_family).alias("n_jump_family"),
        F.count_if(hit & ~in_family & ~in_base).alias("n_jump_other"),
    )
    features = auroc.where(F.col("method").isin("mahalanobis", "knn"))
    is_original = F.col("backbone").isin(originals)
    medians = features.where(is_original).groupBy(*keys, "method").agg(
        F.percentile("auroc", 0.5).alias("__med"), F.count(F.lit(1)).alias("__k")
    ).where(F.col("__k") == len(originals))
    drag = (
        features.where(~is_original)
        .join(medians, [*keys, "method"])
        .groupBy(*keys)
        .agg(F.count_if(F.col("auroc") < F.col("__med") - FEATURE_DRAG).alias("n_dragged"))
    )
    joined = jumps.join(drag, keys, "left").withColumn("n_dragged", F.coalesce("n_dragged", F.lit(0)))
    return joined.withColumn(
        "scenario",
        first_rule(
            [
                (F.col("n_backbones") < n_required, "pending_n"),
                (F.col("n_baseline") < len(baseline), "pending_baseline"),
                (F.col("n_dragged") > 0, "C"),
                (F.col("n_jump_other") > 0, "A"),
                (F.col("n_jump_family") > 0, "B"),
            ],
            "no_jump",
        ),
    )


def seed_verdict(jumps: DataFrame, keys: list[str]) -> DataFrame:
    """Does a jump survive the seeds? Mean, sample sd and hits over seeds."""
    return decision_table(
        jumps,
        keys,
        {
            "mean_jump": F.avg("jump"),
            "sd_jump": F.stddev_samp("jump"),
            "n_hit": F.count_if(F.col("jump") >= JUMP_DELTA),
            "n_seeds": F.count(F.lit(1)),
        },
        [
            ((F.col("mean_jump") >= JUMP_DELTA) & (F.col("n_hit") >= SEED_HITS), "robust"),
            (F.col("mean_jump") >= JUMP_DELTA, "high_variance"),
        ],
        "seed_fragile",
    )


def arm_classes(msp: DataFrame, keys: list[str], baseline: list[str], median: Column) -> DataFrame:
    """Shift arm: saturated, all of the other backbones jump, none, or mixed."""
    jumped = baseline_jump(msp, keys, "backbone", baseline, "auroc")
    other = ~F.col("backbone").isin(baseline)
    return decision_table(
        jumped,
        keys,
        {
            "median_msp": median,
            "min_msp": F.min("auroc"),
            "n_other": F.count_if(other),
            "n_hit": F.count_if(other & (F.col("jump") >= JUMP_DELTA)),
            "mean_jump": F.avg(F.when(other, F.col("jump"))),
        },
        [
            ((F.col("median_msp") >= SATURATED_MEDIAN) | (F.col("min_msp") >= SATURATED_MIN), "sat"),
            (F.col("n_hit") == F.col("n_other"), "all"),
            ((F.col("n_hit") == 0) & (F.col("mean_jump") < JUMP_DELTA), "none"),
        ],
        "mixed",
        "bucket",
    )


# Joint reading of two arms (task shift, far shift).
JOINT_READING = {
    ("none", "none"): "domain_specific",
    ("none", "sat"): "domain_specific_far_saturated",
    ("all", "all"): "classifier_not_shift",
    ("none", "all"): "odd_split",
    ("all", "none"): "survives_near_not_far",
    ("all", "sat"): "survives_near_far_uninformative",
    ("sat", "sat"): "both_saturated",
}


def joint_reading(task: DataFrame, far: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of the arm pair to the reading table, 'mixed' when not listed."""
    spark = task.sparkSession
    table = spark.createDataFrame([(a, b, c) for (a, b), c in JOINT_READING.items()], "task string, far string, reading string")
    pair = task.select(*keys, F.col("bucket").alias("task")).join(far.select(*keys, F.col("bucket").alias("far")), keys)
    return pair.join(F.broadcast(table), ["task", "far"], "left").withColumn("reading", F.coalesce("reading", F.lit("mixed")))


def recipe_verdict(cells: DataFrame, keys: list[str], reference_mean: float) -> DataFrame:
    """Matched-recipe readout; cells under the ID-accuracy floor do not count as evidence."""
    clean = F.col("id_acc").isNull() | (F.col("id_acc") >= ID_FLOOR)
    hit = (F.col("auroc") - F.lit(reference_mean)) >= JUMP_DELTA
    return decision_table(
        cells,
        keys,
        {"n_clean": F.count_if(clean), "n_hit": F.count_if(clean & hit), "n_dirty": F.count_if(~clean)},
        [
            (F.col("n_clean") == 0, "all_dirty"),
            (F.col("n_hit") == 0, "recipe_inflated"),
            (F.col("n_hit") >= 3, "recipe_independent"),
        ],
        "mixed",
    )


def survival_verdict(cells: DataFrame, keys: list[str], reference_mean: float) -> DataFrame:
    """Reverse readout: do baseline models enter the jump band under the other recipe?"""
    clean = F.col("id_acc").isNull() | (F.col("id_acc") >= ID_FLOOR)
    hit = F.col("auroc") >= F.lit(reference_mean + JUMP_DELTA)
    return decision_table(
        cells,
        keys,
        {"n_clean": F.count_if(clean), "n_hit": F.count_if(clean & hit)},
        [(F.col("n_clean") == 0, "all_dirty"), (F.col("n_hit") > 0, "recipe_can_jump")],
        "no_jump_survives",
    )


def covariate_verdict(wide: DataFrame, jump_line: float, gap_bar: float, dense_floor: float, coverage_floor: float) -> DataFrame:
    """Readout of a covariate-augmented rerun over two shift targets.

    Expects id_acc_min, dense_2, small_2, large_2, dense_1, small_1, small_coverage and the
    floors small_floor / large_floor. A model hits when it reaches the jump line, or is within
    the gap bar of the dense model and above its own floor.
    """

    def hits(msp, dense, floor):
        return (F.col(msp) >= jump_line) | ((F.col(dense) - F.col(msp) <= gap_bar) & (F.col(msp) >= F.col(floor)))

    dirty = (F.col("id_acc_min") < ID_FLOOR) | (F.col("dense_2") < dense_floor)
    covered = F.coalesce(F.col("small_coverage") >= coverage_floor, F.lit(False))
    return wide.withColumn(
        "verdict",
        first_rule(
            [
                (dirty, "dirty"),
                (~hits("small_2", "dense_2", "small_floor") | ~covered, "miss"),
                (~hits("large_2", "dense_2", "large_floor"), "weak_one_model"),
                (~hits("small_1", "dense_1", "small_floor"), "weak_one_target"),
            ],
            "strong",
        ),
    )


def encoder_verdict(cells: DataFrame) -> DataFrame:
    """Does a frozen encoder repeat the baseline's Mahalanobis-over-MSP order?

    Expects maha, msp, base_maha, base_msp (NULL without a baseline).
    """
    order, base = F.col("maha") > F.col("msp"), F.col("base_maha") > F.col("base_msp")
    return cells.withColumn(
        "verdict",
        first_rule(
            [
                (F.col("base_maha").isNull() | F.col("base_msp").isNull(), "no_baseline"),
                (order != base, "reverse"),
                ((F.col("maha") < COLLAPSE_LOW) & (F.col("base_maha") >= COLLAPSE_HIGH), "new_regime_collapse"),
                ((F.col("maha") >= COLLAPSE_HIGH) & (F.col("base_maha") < COLLAPSE_LOW), "new_regime_rescue"),
            ],
            "replicate",
        ),
    )


def resolution_verdict(cells: DataFrame) -> DataFrame:
    """Is an outlier due to input size? Expects msp_native, msp_matched, band_low, band_high."""
    still = F.col("msp_matched") >= F.col("msp_native") - OUTLIER_MARGIN
    dropped = F.col("msp_matched").between(F.col("band_low") - BAND_MARGIN, F.col("band_high") + BAND_MARGIN)
    return cells.withColumn(
        "verdict",
        first_rule(
            [
                (F.col("msp_matched").isNull(), "pending"),
                (still & ~dropped, "architecture"),
                (dropped, "resolution_artifact"),
            ],
            "mixed",
        ),
    )


def estimator_verdict(cells: DataFrame) -> DataFrame:
    """Is a gap's sign stable over trims and the median, against a reference model's sign?

    Expects gap_trim_01, gap_trim_05, gap_trim_10, gap_median, reference_gap, frac_beyond_3iqr.
    """
    signs = F.array(*[F.signum(c) for c in ("gap_trim_01", "gap_trim_05", "gap_trim_10", "gap_median")])
    stable = F.size(F.array_distinct(signs)) == 1
    reference = F.signum("reference_gap")
    matches = F.signum("gap_trim_01") == reference
    return cells.withColumn(
        "verdict",
        first_rule(
            [
                (stable & ~matches & (F.col("frac_beyond_3iqr") < TAIL_SHARE), "real"),
                (~matches & (F.signum("gap_trim_05") == reference), "tail_artifact"),
            ],
            "mixed",
        ),
    )


def shrink_verdict(cells: DataFrame) -> DataFrame:
    """Did a training change close at least half of the gap? Expects old_gap, new_gap."""
    return cells.withColumn("shrink", 1.0 - F.try_divide(F.col("new_gap"), F.col("old_gap"))).withColumn(
        "verdict",
        first_rule([(F.col("new_gap") <= F.lit(SHRINK_SHARE) * F.col("old_gap"), "promising")], "dead"),
    )


def correlation_verdict(df: DataFrame, r: str) -> DataFrame:
    return df.withColumn("notable", F.abs(F.col(r)) > R_NOTABLE)


def bound_verdict(msp: DataFrame, keys: list[str], baseline: list[str], probe: str, extra: list[str]) -> DataFrame:
    """Does the probe jump outside the original field, and how many extra models do?"""
    jumped = baseline_jump(msp, keys, "backbone", baseline, "auroc")
    return decision_table(
        jumped,
        keys,
        {
            "baseline_mean": F.max("baseline_mean"),
            "probe_jump": value_of("backbone", probe, "jump"),
            "n_extra_hit": F.count_if(F.col("backbone").isin(extra) & (F.col("jump") >= JUMP_DELTA)),
        },
        [(F.col("probe_jump") >= JUMP_DELTA, "hit")],
        "miss",
    )


def gate_choice(rho: DataFrame) -> DataFrame:
    """Low MSP / Mahalanobis rank agreement on ID rows selects Mahalanobis, else MSP."""
    return rho.withColumn("gate_choice", F.when(F.col("rho") < RHO_GATE, "mahalanobis").otherwise("msp"))


def gate_summary(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count_if(F.col("gate_choice") == "mahalanobis").alias("n_maha"),
        *[F.avg(f"auroc_{m}_eval").alias(f"mean_{m}") for m in ("gate", "maha", "msp")],
        *[F.stddev_samp(f"auroc_{m}_eval").alias(f"spread_{m}") for m in ("gate", "maha", "msp")],
    )
