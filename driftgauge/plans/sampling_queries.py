"""Seeded samples, splits, case selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftgauge.functions import labels as L
from driftgauge.functions.draws import keyed_hash_sql
from driftgauge.operators import cases, decisions, dispersion, sampling, tables
from driftgauge.operators.correlation import spearman
from driftgauge.operators.separability import auroc
from driftgauge.plans import views as v
from driftgauge.plans.model_queries import CHAIN_SQL, plane_model
from driftgauge.plans.registry import query
from driftgauge.plans.views import R, r6, rounded
from driftgauge.session import cut_lineage

SEED = 42


@query(
    "top_n_per_group",
    f"""WITH {v.EVENTS_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY score DESC, sample_id) AS rn FROM scored)
SELECT stratum, sample_id, score FROM p WHERE rn <= 24""",
)
def top_n_per_group(spark, sf):
    rows = v.event_scores(spark, sf)
    return sampling.top_n(rows, ["stratum"], [F.col("score").desc(), F.col("sample_id")], 24).select("stratum", "sample_id", "score")


def _pos_sql(src: str, group: str, seed: int = SEED) -> str:
    return f"""
pos AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {keyed_hash_sql(seed, "sample_id")}, sample_id) AS pos,
          count(*) OVER (PARTITION BY {group}) AS size FROM {src})"""


@query("seeded_sample", f"""WITH {v.EVENTS_SQL}, {_pos_sql("scored", "stratum")} SELECT stratum, sample_id FROM pos WHERE pos <= 100""")
def seeded_sample(spark, sf):
    """A fixed number of random rows per group without replacement."""
    return sampling.sample_n(v.event_scores(spark, sf), ["stratum"], "sample_id", 100, SEED).select("stratum", "sample_id")


@query(
    "stratified_fraction",
    f"""WITH {v.ORDERS_SQL}, {_pos_sql("scored", "priority, correct")}
SELECT priority, correct, count(*) AS n, CAST(sum(sample_id) AS BIGINT) AS id_sum FROM pos WHERE pos <= greatest(1, CAST(round_even(size * 0.05::DOUBLE, 0) AS BIGINT)) GROUP BY ALL""",
)
def stratified_fraction(spark, sf):
    """5 % of every (hospital-like, label) stratum, at least one row, with its count log."""
    some = sampling.stratified_fraction(v.order_scores(spark, sf), ["priority", "correct"], "sample_id", 0.05, SEED)
    return some.groupBy("priority", "correct").agg(F.count(F.lit(1)).alias("n"), F.sum("sample_id").alias("id_sum"))


@query(
    "half_split",
    f"""WITH {v.EVENTS_SQL}, {_pos_sql("scored", "stratum")} SELECT stratum, CASE WHEN pos <= size // 2 THEN 'calib' ELSE 'eval' END AS half,
    count(*) AS n, {R("avg(score)")} AS mean_score FROM pos GROUP BY ALL""",
)
def half_split(spark, sf):
    rows = sampling.half_split(v.event_scores(spark, sf), ["stratum"], "sample_id", SEED)
    return rounded(rows.groupBy("stratum", "half").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score")), "mean_score")


@query(
    "registry_order",
    """SELECT event_type AS stratum, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS ord, count(*) AS n
FROM events GROUP BY ALL ORDER BY ord, stratum""",
)
def registry_order(spark, sf):
    counts = tables.group_counts(v.event_scores(spark, sf), ["stratum"])
    return sampling.registry_order(counts, "stratum", ["view", "click", "purchase"]).orderBy("ord", "stratum")


# --- ID-only gate -----------------------------------------------------------------------

_GATE_POS = keyed_hash_sql(SEED, "sample_id")
_GATE_SQL = f"""{CHAIN_SQL}, two AS (SELECT d.domain, backbone, sample_id, split = 'id_val' AS is_id, round(msp, 9) AS a, round(mahalanobis, 9) AS b
   FROM wide JOIN (VALUES ('near'), ('far')) d(domain) ON split = 'id_val' OR split = d.domain),
pos AS (SELECT *, row_number() OVER (PARTITION BY domain, backbone ORDER BY {_GATE_POS}, sample_id) AS pos, count(*) OVER (PARTITION BY domain, backbone) AS size FROM two WHERE is_id),
cal AS (SELECT domain, backbone, rank() OVER (PARTITION BY domain, backbone ORDER BY a) + (count(*) OVER (PARTITION BY domain, backbone, a) - 1) / 2.0::DOUBLE AS ra,
   rank() OVER (PARTITION BY domain, backbone ORDER BY b) + (count(*) OVER (PARTITION BY domain, backbone, b) - 1) / 2.0::DOUBLE AS rb FROM pos WHERE pos <= size // 2),
rho AS (SELECT domain, backbone, corr(ra, rb) AS rho, count(*) AS n FROM cal GROUP BY ALL),
ev AS (SELECT domain, backbone, sample_id, is_id, a, b FROM pos WHERE pos > size // 2 UNION ALL SELECT domain, backbone, sample_id, is_id, a, b FROM two WHERE NOT is_id),
evl AS (SELECT * FROM ev UNPIVOT (score FOR m IN (a, b))), {v.auroc_sql("evl", "domain, backbone, m")},
gate AS (SELECT r.domain, r.backbone, r.n AS n_calib, rho, CASE WHEN rho < 0.5 THEN 'mahalanobis' ELSE 'msp' END AS gate_choice, x.auroc AS auroc_msp_eval, y.auroc AS auroc_maha_eval,
   CASE WHEN rho < 0.5 THEN y.auroc ELSE x.auroc END AS auroc_gate_eval FROM rho r JOIN au x ON x.domain = r.domain AND x.backbone = r.backbone AND x.m = 'a'
   JOIN au y ON y.domain = r.domain AND y.backbone = r.backbone AND y.m = 'b')"""


def _gate(spark, sf):
    """Calibrate on half of the ID rows, evaluate on the other half: softmax confidence against Mahalanobis score."""
    keys = ["domain", "backbone"]
    model, rows = plane_model(spark, sf, ("msp", "mahalanobis"))
    scored = v.by_domain(model.wide(rows.where("split <> 'train'")))
    two = cut_lineage(
        scored.select(*keys, "sample_id", "is_id", F.round("msp", 9).alias("msp"), F.round("mahalanobis", 9).alias("maha"))
    )
    halves = sampling.half_split(two.where("is_id"), keys, "sample_id", SEED)
    rho = decisions.gate_choice(spearman(halves.where("half = 'calib'"), keys, "msp", "maha"))
    ev = halves.where("half = 'eval'").drop("half").unionByName(two.where("not is_id"))
    long = ev.unpivot([*keys, "is_id"], ["msp", "maha"], "m", "score")
    a = auroc(long, [*keys, "m"])
    pair = a.groupBy(*keys).agg(
        F.max(F.when(F.col("m") == "msp", F.col("auroc"))).alias("auroc_msp_eval"),
        F.max(F.when(F.col("m") == "maha", F.col("auroc"))).alias("auroc_maha_eval"),
    )
    chosen = F.when(F.col("gate_choice") == "mahalanobis", F.col("auroc_maha_eval")).otherwise(F.col("auroc_msp_eval"))
    return rho.join(pair, keys).withColumn("auroc_gate_eval", chosen).withColumnRenamed("n", "n_calib")


@query(
    "id_only_gate",
    f"""WITH {_GATE_SQL} SELECT domain, backbone, n_calib, {R("rho")} AS rho, gate_choice, {R("auroc_msp_eval")} AS auroc_msp_eval,
    {R("auroc_maha_eval")} AS auroc_maha_eval, {R("auroc_gate_eval")} AS auroc_gate_eval FROM gate""",
)
def id_only_gate(spark, sf):
    return rounded(_gate(spark, sf), "rho", "auroc_msp_eval", "auroc_maha_eval", "auroc_gate_eval")


_GATE_OUT = [f"{s}_{m}" for s in ("mean", "spread") for m in ("gate", "maha", "msp")]


@query(
    "gate_summary",
    f"""WITH {_GATE_SQL} SELECT domain, count(*) AS n_cells, count(*) FILTER (gate_choice = 'mahalanobis') AS n_maha,
    {", ".join(f"{R(f'avg(auroc_{m}_eval)')} AS mean_{m}, {R(f'stddev_samp(auroc_{m}_eval)')} AS spread_{m}" for m in ("gate", "maha", "msp"))} FROM gate GROUP BY domain""",
)
def gate_summary(spark, sf):
    return rounded(decisions.gate_summary(_gate(spark, sf), ["domain"]), *_GATE_OUT)


# --- reader-study cases -----------------------------------------------------------------

_CASES_SQL = """
pool AS (SELECT o_orderkey AS case_no, 'img/' || CAST(o_orderkey AS VARCHAR) || '.png' AS image_path,
   CASE WHEN lower(trim(o_orderstatus)) IN ('p') THEN 'malignant' ELSE 'benign' END AS gt_label,
   CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'OOD' ELSE 'ID' END AS id_ood_flag,
   (o_orderkey * 7919 % 1009) / 1008.0::DOUBLE AS ai_prob_malignant, -o_totalprice / 10000.0::DOUBLE AS maha_score FROM orders),
pred AS (SELECT *, CASE WHEN ai_prob_malignant > 0.5 THEN 'malignant' ELSE 'benign' END AS ai_pred FROM pool),
thr AS (SELECT quantile_cont(maha_score, 0.15) AS t, min(maha_score) AS lo, max(maha_score) AS hi FROM pred),
beh AS (SELECT p.*, CASE WHEN maha_score >= t THEN 'High' ELSE 'Low' END AS reliability_flag,
   CASE WHEN ai_pred = 'malignant' THEN ai_prob_malignant ELSE 1.0::DOUBLE - ai_prob_malignant END AS ai_prob_pred,
   CASE WHEN ai_pred = gt_label THEN 1 ELSE 0 END AS ai_correct, (maha_score - lo) / (hi - lo + 1e-8::DOUBLE) AS mm FROM pred p CROSS JOIN thr),
grp AS (SELECT *, CASE WHEN id_ood_flag = 'OOD' AND ai_correct = 0 AND ai_prob_pred >= 0.60 AND reliability_flag = 'Low' THEN 'OOD_TRAP_RESCUE'
   WHEN id_ood_flag = 'OOD' AND reliability_flag = 'Low' THEN 'OOD_SHOULD_DEFER' WHEN id_ood_flag <> 'OOD' AND reliability_flag = 'Low' THEN 'ID_UNCERTAIN'
   WHEN id_ood_flag <> 'OOD' AND ai_correct = 1 AND ai_prob_pred >= 0.80 AND reliability_flag = 'High' THEN 'SAFE_TRUSTED'
   WHEN ai_correct = 0 AND ai_prob_pred >= 0.60 THEN 'DANGEROUS_TRAP' ELSE 'UNASSIGNED' END AS behavior_group,
   0.7::DOUBLE * ai_prob_pred + 0.3::DOUBLE * mm - 0.5::DOUBLE * ai_correct AS danger_score FROM beh)"""


def _pool(spark, sf):
    o = v.table(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    pool = o.select(
        F.col("o_orderkey").alias("case_no"),
        F.concat(F.lit("img/"), F.col("o_orderkey").cast("string"), F.lit(".png")).alias("image_path"),
        L.truth_label(F.when(F.lower(F.trim("o_orderstatus")) == "p", "malignant").otherwise("0")).alias("gt_label"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "OOD").otherwise("ID").alias("id_ood_flag"),
        ((F.col("o_orderkey") * 7919 % 1009) / F.lit(1008.0)).alias("ai_prob_malignant"),
        (-F.col("o_totalprice") / F.lit(10000.0)).alias("maha_score"),
    )
    pool = pool.withColumn("ai_pred", F.when(F.col("ai_prob_malignant") > 0.5, "malignant").otherwise("benign"))
    return cases.behavior_groups(dispersion.split_flag(pool, [], "maha_score", 0.15, "reliability_flag"))


@query(
    "behavior_groups",
    f"""WITH {_CASES_SQL} SELECT case_no, behavior_group, reliability_flag, CAST(ai_correct AS INTEGER) AS ai_correct, {R("ai_prob_pred")} AS ai_prob_pred, {R("danger_score")} AS danger_score FROM grp""",
)
def behavior_groups(spark, sf):
    out = _pool(spark, sf).select("case_no", "behavior_group", "reliability_flag", "ai_correct", "ai_prob_pred", "danger_score")
    return rounded(out, "ai_prob_pred", "danger_score")


@query(
    "behavior_crosstab",
    f"""WITH {_CASES_SQL} SELECT behavior_group, count(*) FILTER (reliability_flag = 'High') AS High, count(*) FILTER (reliability_flag = 'Low') AS Low FROM grp GROUP BY 1""",
)
def behavior_crosstab(spark, sf):
    return _pool(spark, sf).groupBy("behavior_group").pivot("reliability_flag", ["High", "Low"]).count().fillna(0)


@query(
    "case_selection",
    f"""WITH {_CASES_SQL},
k AS (SELECT *, CASE WHEN behavior_group IN ('DANGEROUS_TRAP', 'OOD_TRAP_RESCUE') THEN -danger_score ELSE CAST({keyed_hash_sql(SEED, "case_no")} AS DOUBLE) END AS k,
   CASE behavior_group WHEN 'SAFE_TRUSTED' THEN 0 WHEN 'ID_UNCERTAIN' THEN 1 WHEN 'DANGEROUS_TRAP' THEN 2 WHEN 'OOD_SHOULD_DEFER' THEN 3 WHEN 'OOD_TRAP_RESCUE' THEN 4 END AS stage FROM grp),
q AS (SELECT *, row_number() OVER (PARTITION BY behavior_group ORDER BY k, case_no) AS pos FROM k
      WHERE behavior_group IN ('SAFE_TRUSTED', 'DANGEROUS_TRAP', 'OOD_SHOULD_DEFER', 'OOD_TRAP_RESCUE')),
quota AS (SELECT case_no, image_path, behavior_group, danger_score, stage, pos FROM q WHERE pos <= 24),
rest AS (SELECT *, CASE behavior_group WHEN 'DANGEROUS_TRAP' THEN 5 WHEN 'OOD_TRAP_RESCUE' THEN 6 WHEN 'OOD_SHOULD_DEFER' THEN 7 WHEN 'SAFE_TRUSTED' THEN 8 WHEN 'ID_UNCERTAIN' THEN 9 ELSE 10 END AS st
      FROM grp WHERE case_no NOT IN (SELECT case_no FROM quota)),
fill AS (SELECT case_no, image_path, behavior_group, danger_score, st AS stage, row_number() OVER (ORDER BY st, danger_score DESC, case_no) AS pos FROM rest),
alls AS (SELECT * FROM quota UNION ALL SELECT * FROM fill WHERE pos <= 96 - (SELECT count(*) FROM quota))
SELECT 'RS_' || lpad(CAST(row_number() OVER (ORDER BY stage, pos) AS VARCHAR), 3, '0') AS case_id, case_no, behavior_group, {R("danger_score")} AS danger_score FROM alls""",
)
def case_selection(spark, sf):
    """96 cases: 24 per group, filled by priority and danger, numbered."""
    out = cases.select_cases(cut_lineage(_pool(spark, sf)), "case_no", SEED)
    return rounded(out.select("case_id", "case_no", "behavior_group", "danger_score"), "danger_score")


@query(
    "case_trim",
    f"""WITH {_CASES_SQL} SELECT case_no, behavior_group, {R("danger_score")} AS danger_score FROM grp
ORDER BY CASE behavior_group WHEN 'OOD_TRAP_RESCUE' THEN 5 WHEN 'DANGEROUS_TRAP' THEN 4 WHEN 'OOD_SHOULD_DEFER' THEN 3 WHEN 'ID_UNCERTAIN' THEN 2 WHEN 'SAFE_TRUSTED' THEN 1 ELSE 0 END DESC,
  grp.danger_score DESC, case_no LIMIT 96""",
)
def case_trim(spark, sf):
    """Over-target trim by priority, then danger."""
    return rounded(cases.trim_cases(_pool(spark, sf), "case_no").select("case_no", "behavior_group", "danger_score"), "danger_score")


@query(
    "case_showcase",
    f"""WITH {_CASES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY behavior_group ORDER BY
   CASE behavior_group WHEN 'SAFE_TRUSTED' THEN -ai_prob_pred WHEN 'OOD_SHOULD_DEFER' THEN maha_score ELSE -danger_score END,
   CASE behavior_group WHEN 'SAFE_TRUSTED' THEN -maha_score WHEN 'OOD_TRAP_RESCUE' THEN maha_score ELSE -ai_prob_pred END, case_no) AS rn FROM grp
   WHERE behavior_group IN ('SAFE_TRUSTED', 'DANGEROUS_TRAP', 'OOD_SHOULD_DEFER', 'OOD_TRAP_RESCUE'))
SELECT behavior_group, case_no FROM o WHERE rn <= 2""",
)
def case_showcase(spark, sf):
    return cases.showcase(_pool(spark, sf), "case_no").select("behavior_group", "case_no")


@query(
    "reader_reliability",
    f"""WITH r AS (SELECT event_id AS case_no, value AS m, CASE event_type WHEN 'view' THEN 'OOD_low_maha' WHEN 'click' THEN 'ID_low_reliability_error' WHEN 'error' THEN 'OOD_high_confident_wrong' ELSE 'ID_correct' END AS reader_group FROM events),
med AS (SELECT quantile_cont(m, 0.5) AS t FROM r WHERE reader_group = 'OOD_high_confident_wrong')
SELECT case_no, reader_group, CASE WHEN reader_group IN ('OOD_low_maha', 'ID_low_reliability_error') THEN 'Low' WHEN reader_group = 'OOD_high_confident_wrong' AND m < t THEN 'Low' ELSE 'High' END AS reader_reliability_flag
FROM r CROSS JOIN med""",
)
def reader_reliability(spark, sf):
    e = v.event_scores(spark, sf)
    names = F.create_map(*[F.lit(x) for x in ("view", "OOD_low_maha", "click", "ID_low_reliability_error", "error", "OOD_high_confident_wrong")])
    rows = e.select(
        F.col("sample_id").alias("case_no"),
        F.col("score").alias("maha_score"),
        F.coalesce(names[F.col("stratum")], F.lit("ID_correct")).alias("reader_group"),
    )
    return cases.reader_reliability(rows).select("case_no", "reader_group", "reader_reliability_flag")


@query(
    "min_max_scaled",
    f"""WITH s AS (SELECT event_id AS sample_id, (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER () + 1e-8::DOUBLE) AS x FROM events)
SELECT sample_id, {R("x")} AS scaled FROM s""",
)
def min_max_scaled(spark, sf):
    out = cases.min_max(v.event_scores(spark, sf), "score", "scaled")
    return out.select("sample_id", r6(F.col("scaled")).alias("scaled"))
