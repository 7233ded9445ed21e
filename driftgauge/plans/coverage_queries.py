"""Risk-coverage curves, held-out selection and their reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftgauge.functions import scores as S
from driftgauge.operators import coverage, sampling, selection, separability, tables
from driftgauge.plans import views as v
from driftgauge.plans.rank_queries import CELLS_SQL, cells
from driftgauge.plans.registry import query
from driftgauge.plans.views import R, rounded
from driftgauge.session import cut_lineage, scratch_path
from driftgauge.sources import writers

KEYS = ["model", "protocol"]


@query(
    "risk_curve",
    f"""WITH {v.ORDERS_SQL}, {v.curve_sql("scored", "model, protocol")}
SELECT model, protocol, sample_id, accepted, {R("coverage")} AS coverage, {R("risk")} AS risk FROM curve""",
)
def risk_curve(spark, sf):
    """Every prefix of every model, by descending score with ties by id."""
    out = coverage.risk_curve(v.order_scores(spark, sf), KEYS)
    return rounded(out, "coverage", "risk").select(*KEYS, "sample_id", "accepted", "coverage", "risk")


@query(
    "risk_at_grid",
    f"""WITH {v.ORDERS_SQL}, {v.curve_sql("scored", "model, protocol")}, {v.aurc_sql("model, protocol")}
SELECT model, protocol, CAST(p AS INTEGER) AS point, {R("c")} AS grid_coverage, accepted, {R("risk")} AS risk FROM ar_r""",
)
def risk_at_grid(spark, sf):
    curve = coverage.risk_curve(v.order_scores(spark, sf), KEYS)
    out = coverage.risk_at_grid(curve, KEYS)
    return rounded(out, "grid_coverage", "risk").select(*KEYS, "point", "grid_coverage", "accepted", "risk")


@query(
    "risk_at_truncated_grid",
    f"""WITH {v.ORDERS_SQL}, {v.curve_sql("scored", "model, protocol")},
g AS (SELECT model, protocol, p, greatest(1, CAST(floor((0.01::DOUBLE + p * 0.01::DOUBLE) * max(n)) AS BIGINT)) AS accepted FROM curve CROSS JOIN range(0, 100) t(p) GROUP BY model, protocol, p)
SELECT g.model, g.protocol, CAST(p AS INTEGER) AS point, g.accepted, {R("risk")} AS risk FROM g JOIN curve c ON g.model = c.model AND g.protocol = c.protocol AND g.accepted = c.accepted""",
)
def risk_at_truncated_grid(spark, sf):
    """The 100-point grid with truncated prefix lengths."""
    curve = coverage.risk_curve(v.order_scores(spark, sf), KEYS)
    out = coverage.risk_at_grid(curve, KEYS, n_points=100, top=0.01, step=0.01, k_rule="floor")
    return rounded(out, "risk").select(*KEYS, "point", "accepted", "risk")


@query(
    "aurc",
    f"""WITH {v.ORDERS_SQL}, {v.curve_sql("scored", "model, protocol")}, {v.aurc_sql("model, protocol")} SELECT model, protocol, {R("aurc")} AS aurc FROM ar""",
)
def aurc(spark, sf):
    curve = coverage.risk_curve(v.order_scores(spark, sf), KEYS)
    return rounded(coverage.aurc(coverage.risk_at_grid(curve, KEYS), KEYS), "aurc")


_COV = ["coverage_at_risk10", "coverage_at_risk15", "coverage_at_risk20"]


@query(
    "coverage_at_risk",
    f"""WITH {v.ORDERS_SQL}, {v.curve_sql("scored", "model, protocol")}, {v.coverage_sql("model, protocol")}
SELECT model, protocol, {", ".join(f"{R(c)} AS {c}" for c in _COV)}, {R("full_risk")} AS full_risk, n FROM cov""",
)
def coverage_at_risk(spark, sf):
    curve = coverage.risk_curve(v.order_scores(spark, sf), KEYS)
    return rounded(coverage.coverage_at_risk(curve, KEYS), *_COV, "full_risk")


_REPORT_SQL = f"""{v.ORDERS_SQL}, {v.curve_sql("scored", "model, protocol")},
{v.coverage_sql("model, protocol", (0.10, 0.15), eps="0", none="NULL")}, {v.aurc_sql("model, protocol")},
flag AS (SELECT model, protocol, score, priority IN ('1-URGENT', '2-HIGH') AS is_id FROM scored), {v.auroc_sql("flag", "model, protocol")},
report AS (SELECT cov.model, cov.protocol, au.auroc AS ood_auroc, aurc, coverage_at_risk10, coverage_at_risk15, full_risk, n
  FROM cov JOIN ar USING (model, protocol) JOIN au USING (model, protocol))"""


def _report(spark, sf):
    rows = v.order_scores(spark, sf)
    sel = coverage.selective_report(rows, KEYS)
    a = separability.auroc(rows.withColumn("is_id", F.col("priority").isin("1-URGENT", "2-HIGH")), KEYS)
    return cut_lineage(sel.join(a.withColumnRenamed("auroc", "ood_auroc"), KEYS))


@query(
    "selective_report",
    f"""WITH {_REPORT_SQL} SELECT model, protocol, {R("ood_auroc")} AS ood_auroc, {R("aurc")} AS aurc, {R("coverage_at_risk10")} AS coverage_at_risk10,
    {R("coverage_at_risk15")} AS coverage_at_risk15, {R("full_risk")} AS full_risk, n FROM report""",
)
def selective_report(spark, sf):
    """AURC, coverage at risk (NULL if never met), full risk and AUROC per model and protocol."""
    return rounded(_report(spark, sf), "ood_auroc", "aurc", "coverage_at_risk10", "coverage_at_risk15", "full_risk")


@query(
    "rank_disagreement",
    f"""WITH {_REPORT_SQL}, o AS (SELECT protocol,
  string_agg(model, '>' ORDER BY ood_auroc DESC NULLS LAST, model) AS rank_by_ood_auroc,
  string_agg(model, '>' ORDER BY coverage_at_risk10 DESC NULLS LAST, model) AS rank_by_coverage_at_risk10,
  string_agg(model, '>' ORDER BY aurc ASC NULLS LAST, model) AS rank_by_aurc FROM report GROUP BY protocol)
SELECT *, rank_by_ood_auroc <> rank_by_coverage_at_risk10 AS auroc_vs_coverage10_disagree, rank_by_ood_auroc <> rank_by_aurc AS auroc_vs_aurc_disagree FROM o""",
)
def rank_disagreement(spark, sf):
    return tables.rank_disagreement(_report(spark, sf).withColumn("ord", F.col("model")), ["protocol"], "model", "ord")


# --- selection on a group-disjoint split ------------------------------------------------

_SPLIT_SQL = """
grp AS (SELECT group_id, count(*) AS n, avg(CASE WHEN correct THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS label_frac FROM scored GROUP BY group_id),
split AS (SELECT group_id, n, label_frac, CASE WHEN (row_number() OVER (ORDER BY label_frac, group_id) - 1) % 4 IN (0, 3) THEN 'val' ELSE 'test' END AS half FROM grp)"""


@query(
    "group_split",
    f"""WITH {v.ORDERS_SQL}, {_SPLIT_SQL} SELECT group_id, n, {R("label_frac")} AS label_frac, half FROM split""",
)
def group_split(spark, sf):
    """Whole customers to val or test, balanced by label rate."""
    return rounded(sampling.group_split(v.order_scores(spark, sf), "group_id", "correct"), "label_frac")


@query(
    "split_half_rows",
    f"""WITH {v.ORDERS_SQL}, {_SPLIT_SQL} SELECT model, count(*) AS n, {R("avg(score)")} AS mean_score FROM scored
WHERE group_id IN (SELECT group_id FROM split WHERE half = 'val') GROUP BY model""",
)
def split_half_rows(spark, sf):
    """Semi join of rows to one frozen half."""
    rows = v.order_scores(spark, sf)
    split = cut_lineage(sampling.group_split(rows, "group_id", "correct"))
    val = sampling.split_half(rows, split, "group_id", "val")
    return rounded(val.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score")), "mean_score")


@query(
    "frozen_group_split",
    f"""WITH {v.ORDERS_SQL}, {_SPLIT_SQL} SELECT half, model, count(*) AS n, {R("avg(score)")} AS mean_score FROM scored JOIN split USING (group_id) GROUP BY half, model""",
)
def frozen_group_split(spark, sf):
    """The split is written once; a later run with other rows finds it and deals nothing anew."""
    rows = v.order_scores(spark, sf)
    path = scratch_path(spark, "group-split")
    writers.once(spark, path, lambda: sampling.group_split(rows, "group_id", "correct"))
    split = writers.once(spark, path, lambda: sampling.group_split(rows.where("score > 0 and group_id % 2 = 0"), "group_id", "correct"))
    dealt = sampling.apply_split(rows, split, "group_id")
    return rounded(dealt.groupBy("half", "model").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score")), "mean_score")


def _scope(s: str) -> str:
    where = "" if s == "full" else f" WHERE is_id OR half = '{s}'"
    return f"SELECT model, '{s}' AS scope, is_id, score, correct, sample_id FROM rows_{where}"


_SELECT_SQL = f"""{v.ORDERS_SQL}, {_SPLIT_SQL},
rows_ AS (SELECT s.*, split.half, priority IN ('1-URGENT', '2-HIGH') AS is_id FROM scored s JOIN split USING (group_id)),
long AS ({" UNION ALL ".join(_scope(s) for s in selection.SCOPES)}),
{v.auroc_sql("long", "model, scope")}, shifted AS (SELECT * FROM long WHERE NOT is_id), {v.curve_sql("shifted", "model, scope")},
{v.coverage_sql("model, scope", (0.10,))},
m AS (SELECT model, {", ".join(f"max(CASE WHEN scope = '{s}' THEN {src} END) AS {out}_{s}" for s in selection.SCOPES for src, out in (("auroc", "auroc"), ("coverage_at_risk10", "cov10"), ("cov.n", "n")))}
      FROM au JOIN cov USING (model, scope) GROUP BY model)"""
_METRICS = [f"{c}_{s}" for s in selection.SCOPES for c in ("auroc", "cov10")]


def _selection_metrics(spark, sf):
    rows = v.order_scores(spark, sf).withColumn("is_id", F.col("priority").isin("1-URGENT", "2-HIGH"))
    split = cut_lineage(sampling.group_split(rows, "group_id", "correct"))
    return cut_lineage(selection.half_metrics(sampling.apply_split(rows, split, "group_id"), "model"))


@query(
    "half_metrics",
    f"""WITH {_SELECT_SQL} SELECT model, {", ".join(f"{R(c)} AS {c}" for c in _METRICS)}, n_full, n_val, n_test FROM m""",
)
def half_metrics(spark, sf):
    return rounded(_selection_metrics(spark, sf), *_METRICS)


_RULES = {
    "auroc_on_val": "auroc_val",
    "coverage_on_val": "cov10_val",
    "oracle_auroc_full": "auroc_full",
    "oracle_coverage_full": "cov10_full",
    "best_achievable_test": "cov10_test",
}


@query(
    "selection_report",
    f"""WITH {_SELECT_SQL}, l AS ({" UNION ALL ".join(f"SELECT '{r}' AS rule, model, {c} AS value, cov10_test, cov10_full FROM m" for r, c in _RULES.items())}),
p AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY value DESC, model) AS rn FROM l WHERE value IS NOT NULL)
SELECT rule, model AS picked, {R("value")} AS value, {R("cov10_test")} AS cov10_test, {R("cov10_full")} AS cov10_full FROM p WHERE rn = 1""",
)
def selection_report(spark, sf):
    """Pick by AUROC versus by coverage on one half, report on the other."""
    return rounded(selection.selection_report(_selection_metrics(spark, sf), "model"), "value", "cov10_test", "cov10_full")


@query(
    "rank_utility",
    f"""WITH {CELLS_SQL}, com AS (SELECT domain, backbone, method, auroc FROM cells WHERE method IN ('msp', 'energy', 'mahalanobis', 'knn')),
{v.ranks_sql("com", "domain, backbone")},
sel AS (SELECT 'F' AS domain, 'm' || CAST(o_custkey % 8 AS VARCHAR) AS backbone, o_orderkey AS sample_id, o_totalprice AS score,
               NOT (o_orderstatus = 'P' AND o_orderkey % 7 < 3) AS correct FROM orders), {v.curve_sql("sel", "domain, backbone")},
{v.coverage_sql("domain, backbone", (0.10, 0.15), eps="0", none="NULL")}, {v.aurc_sql("domain, backbone")}
SELECT r.domain, r.backbone, {", ".join(f"{R(f'max(CASE WHEN method = {chr(39)}{m}{chr(39)} THEN auroc END)')} AS {m}_auroc" for m in ("msp", "energy", "mahalanobis", "knn"))},
  max(CASE WHEN method = 'msp' THEN rank END) AS msp_rank, arg_max(method, auroc) AS top1,
  {R("any_value(coverage_at_risk10)")} AS coverage_at_risk10, {R("any_value(aurc)")} AS aurc, {R("any_value(full_risk)")} AS full_risk
FROM rk r JOIN cov ON cov.domain = r.domain AND cov.backbone = r.backbone JOIN ar ON ar.domain = r.domain AND ar.backbone = r.backbone GROUP BY r.domain, r.backbone""",
)
def rank_utility(spark, sf):
    """Does the best-ranked score also serve best? Ranks joined with coverage and AURC."""
    rows = v.order_scores(spark, sf).select(F.lit("F").alias("domain"), F.col("model").alias("backbone"), "sample_id", "score", "correct")
    risk = coverage.selective_report(rows, ["domain", "backbone"]).select("domain", "backbone", "coverage_at_risk10", "aurc", "full_risk")
    out = selection.rank_utility(cells(spark, sf), risk, ["domain", "backbone"])
    return rounded(out, *[f"{m}_auroc" for m in ("msp", "energy", "mahalanobis", "knn")], "coverage_at_risk10", "aurc", "full_risk")


@query(
    "pick_best",
    f"""WITH {CELLS_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY domain, method ORDER BY auroc DESC, backbone) AS hi,
   row_number() OVER (PARTITION BY domain, method ORDER BY auroc, backbone) AS lo FROM cells)
SELECT domain, method, max(CASE WHEN hi = 1 THEN backbone END) AS best, {R("max(CASE WHEN hi = 1 THEN auroc END)")} AS best_auroc,
   max(CASE WHEN lo = 1 THEN backbone END) AS worst, {R("max(CASE WHEN lo = 1 THEN auroc END)")} AS worst_auroc FROM p GROUP BY ALL""",
)
def pick_best(spark, sf):
    c = cells(spark, sf)
    hi = tables.pick_best(c, ["domain", "method"], "backbone", "auroc").toDF("domain", "method", "best", "best_auroc")
    lo = tables.pick_best(c, ["domain", "method"], "backbone", "auroc", lowest=True).toDF("domain", "method", "worst", "worst_auroc")
    return rounded(hi.join(lo, ["domain", "method"]), "best_auroc", "worst_auroc")


@query(
    "vector_selective_report",
    f"""WITH {v.LOGITS_SQL}, scored AS (SELECT backbone, split, sample_id, msp AS score, pred = label AS correct FROM zstat WHERE split <> 'train'),
{v.curve_sql("scored", "backbone, split")}, {v.coverage_sql("backbone, split")}
SELECT backbone, split, {", ".join(f"{R(c)} AS {c}" for c in _COV)}, {R("full_risk")} AS full_risk, n FROM cov""",
)
def vector_selective_report(spark, sf):
    """From vectors: MSP as confidence, argmax as prediction, coverage per split."""
    z = F.col("logits")
    rows = v.with_logits(spark, sf).where("split <> 'train'").select(
        "backbone", "split", "sample_id", S.msp(z).alias("score"), S.correct(z, F.col("label")).alias("correct")
    )
    keys = ["backbone", "split"]
    return rounded(coverage.coverage_at_risk(coverage.risk_curve(rows, keys), keys), *_COV, "full_risk")
