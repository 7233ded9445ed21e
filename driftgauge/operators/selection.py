"""Model-selection pipelines on a group-disjoint split: choose on one half, report on the other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.operators.coverage import coverage_at_risk, risk_curve
from driftgauge.operators.ranks import COMMON_METHODS, item_ranks
from driftgauge.operators.separability import auroc
from driftgauge.operators.tables import pick_best

SCOPES = ("full", "val", "test")


def half_metrics(rows: DataFrame, model: str, target: float = 0.10) -> DataFrame:
    """AUROC and coverage@risk per model on all rows and on each half.

    Expects is_id, half (of shifted rows), score, correct, sample_id. ID rows serve every
    scope; coverage looks at shifted rows only.
    """
    scopes = F.when(F.col("is_id"), F.array(*[F.lit(s) for s in SCOPES])).otherwise(F.array(F.lit("full"), F.col("half")))
    long = rows.withColumn("scope", F.explode(scopes))
    keys = [model, "scope"]
    a = auroc(long, keys)
    curve = risk_curve(long.where(~F.col("is_id")), keys)
    name = f"coverage_at_risk{round(target * 100)}"
    c = coverage_at_risk(curve, keys, (target,)).select(*keys, F.col(name).alias("cov"), "n")
    both = a.join(c, keys)
    return both.groupBy(model).agg(
        *[
            F.max(F.when(F.col("scope") == s, F.col(src))).alias(f"{out}_{s}")
            for s in SCOPES
            for src, out in (("auroc", "auroc"), ("cov", "cov10"), ("n", "n"))
        ]
    )


def selection_report(metrics: DataFrame, model: str) -> DataFrame:
    """Which model each rule picks, and its held-out coverage: one row per rule."""
    rules = {
        "auroc_on_val": "auroc_val",
        "coverage_on_val": "cov10_val",
        "oracle_auroc_full": "auroc_full",
        "oracle_coverage_full": "cov10_full",
        "best_achievable_test": "cov10_test",
    }
    entries = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(c).alias("value")) for r, c in rules.items()])
    long = metrics.select(model, "cov10_test", "cov10_full", F.explode(entries).alias("e")).select(
        model, "cov10_test", "cov10_full", "e.rule", "e.value"
    )
    picked = pick_best(long, ["rule"], model, "value")
    return picked.join(long.select(model, "rule", "cov10_test", "cov10_full"), [model, "rule"]).select(
        "rule", F.col(model).alias("picked"), "value", "cov10_test", "cov10_full"
    )


def rank_utility(cells: DataFrame, risk: DataFrame, keys: list[str]) -> DataFrame:
    """Per (domain, backbone): common-method AUROCs, rank of MSP among them, top method, coverage and AURC.

    ``cells`` has (keys, method, auroc); ``risk`` has (keys, coverage_at_risk10, aurc, full_risk).
    """
    common = cells.where(F.col("method").isin(*COMMON_METHODS))
    ranked = item_ranks(common, keys, "auroc")
    pick = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    wide = ranked.groupBy(*keys).agg(
        *[pick(m, "auroc").alias(f"{m}_auroc") for m in COMMON_METHODS],
        pick("msp", "rank").alias("msp_rank"),
    )
    return wide.join(pick_best(common, keys, "method", "auroc").withColumnRenamed("method", "top1").drop("auroc"), keys).join(risk, keys)
