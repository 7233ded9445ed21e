"""Per-sample scores, separability, calibration and dispersion."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftgauge.functions import scores as S
from driftgauge.functions import vectors as V
from driftgauge.operators import calibration, correlation, dispersion, separability, tables
from driftgauge.operators.ordered import exact_percentiles
from driftgauge.plans import views as v
from driftgauge.plans.registry import query
from driftgauge.plans.views import R, r6, rounded

LOGIT_METHODS = ["msp", "energy", "logit_norm"]


@query(
    "msp_separability",
    f"""WITH {v.SCORES_SQL}, ms AS (SELECT * FROM scored WHERE method = 'msp'), {v.sep_sql("ms", "domain, backbone")}
SELECT domain, backbone, {R("auroc")} AS auroc, {R("fpr95")} AS fpr95, {R("threshold")} AS threshold, n_id, n_ood FROM sep""",
)
def msp_separability(spark, sf):
    """Flagship slice: vectors -> logits -> MSP -> AUROC and FPR95 per (domain, backbone)."""
    rows = v.by_domain(v.with_logits(spark, sf)).select("domain", "backbone", "is_id", S.msp(F.col("logits")).alias("score"))
    return rounded(separability.separability(rows, ["domain", "backbone"]), "auroc", "fpr95", "threshold")


@query(
    "logit_sample_scores",
    f"""WITH {v.LOGITS_SQL}
SELECT backbone, sample_id, split, {R("msp")} AS msp, {R("energy")} AS energy, {R("logit_norm")} AS logit_norm,
       {R("logit_gap")} AS logit_gap, pred = label AS correct, CAST(pred AS INTEGER) AS predicted FROM zstat""",
)
def logit_sample_scores(spark, sf):
    z = F.col("logits")
    return v.with_logits(spark, sf).select(
        "backbone",
        "sample_id",
        "split",
        r6(S.msp(z)).alias("msp"),
        r6(S.energy(z)).alias("energy"),
        r6(S.logit_norm(z)).alias("logit_norm"),
        r6(S.logit_gap(z)).alias("logit_gap"),
        (S.correct(z, F.col("label")) == 1.0).alias("correct"),
        S.predicted_class(z).alias("predicted"),
    )


@query(
    "score_family_separability",
    f"""WITH {v.SCORES_SQL}, {v.sep_sql("scored", "domain, backbone, method")}
SELECT domain, backbone, method, {R("auroc")} AS auroc, {R("fpr95")} AS fpr95, {R("threshold")} AS threshold, n_id, n_ood FROM sep""",
)
def score_family_separability(spark, sf):
    rows = v.logit_scores(v.by_domain(v.with_logits(spark, sf)))
    return rounded(separability.separability(rows, ["domain", "backbone", "method"]), "auroc", "fpr95", "threshold")


@query(
    "tempered_scores",
    f"""WITH {v.LOGITS_SQL}, t(temp) AS (VALUES (0.5::DOUBLE), (2.0::DOUBLE), (5.0::DOUBLE)),
x AS (SELECT backbone, sample_id, temp, 1.0::DOUBLE / sum(exp((z - zm) / temp)) AS msp,
             max(zm) + temp * ln(sum(exp((z - zm) / temp))) AS energy FROM zmax CROSS JOIN t GROUP BY backbone, sample_id, temp)
SELECT backbone, temp AS temperature, {R("avg(msp)")} AS mean_msp, {R("avg(energy)")} AS mean_energy, count(*) AS n
FROM x GROUP BY ALL""",
)
def tempered_scores(spark, sf):
    z = v.with_logits(spark, sf).select("backbone", "logits")
    t = z.withColumn("temperature", F.explode(F.array(F.lit(0.5), F.lit(2.0), F.lit(5.0))))
    out = t.groupBy("backbone", "temperature").agg(
        F.avg(S.msp(F.col("logits"), F.col("temperature"))).alias("mean_msp"),
        F.avg(S.energy(F.col("logits"), F.col("temperature"))).alias("mean_energy"),
        F.count(F.lit(1)).alias("n"),
    )
    return rounded(out, "mean_msp", "mean_energy")


@query(
    "softmax_profile",
    f"""WITH {v.LOGITS_SQL}, p AS (SELECT backbone, class, exp(z - zm) / sum(exp(z - zm)) OVER (PARTITION BY backbone, sample_id) AS p FROM zmax)
SELECT backbone, CAST(class AS INTEGER) AS class, {R("avg(p)")} AS mean_p, {R("max(p)")} AS max_p FROM p GROUP BY ALL""",
)
def softmax_profile(spark, sf):
    z = v.with_logits(spark, sf).select("backbone", F.posexplode(S.softmax(F.col("logits"))).alias("class", "p"))
    out = z.groupBy("backbone", "class").agg(F.avg("p").alias("mean_p"), F.max("p").alias("max_p"))
    return rounded(out, "mean_p", "max_p")


@query(
    "l2_normalized_features",
    f"""WITH {v.SAMPLES_SQL}, n AS (SELECT backbone, split, sample_id, feats, sqrt(list_dot_product(feats, feats)) AS len FROM samples),
u AS (SELECT backbone, split, list_transform(feats, lambda x: x / (len + 1e-8::DOUBLE)) AS u, len FROM n)
SELECT backbone, split, {R("avg(len)")} AS mean_norm, {R("avg(sqrt(list_dot_product(u, u)))")} AS mean_unit_norm,
       {R("avg(u[1])")} AS mean_first, count(*) AS n FROM u GROUP BY ALL""",
)
def l2_normalized_features(spark, sf):
    u = v.samples(spark, sf).select(
        "backbone", "split", V.norm(F.col("feats")).alias("len"), V.l2_normalize(F.col("feats")).alias("u")
    )
    out = u.groupBy("backbone", "split").agg(
        F.avg("len").alias("mean_norm"),
        F.avg(V.norm(F.col("u"))).alias("mean_unit_norm"),
        F.avg(F.col("u")[0]).alias("mean_first"),
        F.count(F.lit(1)).alias("n"),
    )
    return rounded(out, "mean_norm", "mean_unit_norm", "mean_first")


@query(
    "bulk_separability",
    f"""WITH {v.BULK_SQL}, {v.sep_sql("bulk", "domain, backbone, method")}
SELECT domain, backbone, method, {R("auroc")} AS auroc, {R("fpr95")} AS fpr95, {R("threshold")} AS threshold, n_id, n_ood FROM sep""",
)
def bulk_separability(spark, sf):
    """AUROC / FPR95 over all line items, one continuous and one heavily tied score."""
    rows = v.bulk_scores(spark, sf)
    return rounded(separability.separability(rows, ["domain", "backbone", "method"]), "auroc", "fpr95", "threshold")


@query(
    "bulk_float_auroc",
    f"""WITH {v.BULK_SQL}, f AS (SELECT domain, backbone, method, is_id, CAST(score AS FLOAT) AS score FROM bulk),
{v.auroc_sql("f", "domain, backbone, method")}
SELECT domain, backbone, method, {R("auroc")} AS auroc FROM au""",
)
def bulk_float_auroc(spark, sf):
    """Single-precision scores: nearly equal values become ties."""
    out = separability.auroc(v.bulk_scores(spark, sf), ["domain", "backbone", "method"], score_type="float")
    return rounded(out, "auroc")


@query(
    "pooled_domain_auroc",
    f"""WITH {v.BULK_SQL}, {v.auroc_sql("bulk", "method, backbone")}
SELECT method, backbone, {R("auroc")} AS auroc, n_id, n_ood FROM au""",
)
def pooled_domain_auroc(spark, sf):
    """Several shifted sources as one: rows are pooled before the metric, never averaged after."""
    rows = v.bulk_scores(spark, sf)
    parts = rows.where("domain = 'F'").unionByName(rows.where("domain = 'O'"))
    out = separability.separability(parts, ["method", "backbone"])
    return rounded(out, "auroc").select("method", "backbone", "auroc", "n_id", "n_ood")


@query(
    "operating_point",
    f"""WITH {v.BULK_SQL}, t AS (SELECT domain, backbone, method, quantile_cont(score, 0.05) AS threshold FROM bulk WHERE is_id GROUP BY ALL),
h AS (SELECT domain, backbone, method, max(threshold) AS threshold, count(*) FILTER (is_id AND score > threshold) AS tp,
             count(*) FILTER (NOT is_id AND score > threshold) AS fp FROM bulk JOIN t USING (domain, backbone, method) GROUP BY ALL)
SELECT domain, backbone, method, {R("threshold")} AS threshold, tp, fp, {R("coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0)")} AS precision FROM h""",
)
def operating_point(spark, sf):
    out = separability.operating_point(v.bulk_scores(spark, sf), ["domain", "backbone", "method"])
    return rounded(out, "threshold", "precision")


_AUDIT_SQL = f"""{v.SCORES_SQL}, {v.auroc_sql("scored", "domain, backbone, method")},
neg AS (SELECT domain, backbone, method, is_id, -score AS score FROM scored), {v.auroc_sql("neg", "domain, backbone, method", "fl")},
loc AS (SELECT domain, backbone, method, avg(score) FILTER (is_id) AS id_mean, avg(score) FILTER (NOT is_id) AS ood_mean,
               quantile_cont(score, 0.5) FILTER (is_id) AS id_median, quantile_cont(score, 0.5) FILTER (NOT is_id) AS ood_median
        FROM scored GROUP BY ALL),
audit AS (SELECT domain, backbone, method, au.auroc, fl.auroc AS auroc_flipped, id_mean, ood_mean, id_median, ood_median,
                 ood_mean - id_mean AS ood_minus_id_mean, abs(au.auroc + fl.auroc - 1) < 1e-6 AS sum_to_one, au.auroc < 0.5 AS below_chance,
                 ood_mean > id_mean AS ood_more_confident
          FROM au JOIN fl USING (domain, backbone, method) JOIN loc USING (domain, backbone, method))"""


@query(
    "sign_audit",
    f"""WITH {_AUDIT_SQL}
SELECT domain, backbone, method, {R("auroc")} AS auroc, {R("auroc_flipped")} AS auroc_flipped, {R("id_mean")} AS id_mean,
       {R("ood_mean")} AS ood_mean, {R("id_median")} AS id_median, {R("ood_median")} AS ood_median,
       {R("ood_minus_id_mean")} AS ood_minus_id_mean, sum_to_one, below_chance, ood_more_confident FROM audit""",
)
def sign_audit(spark, sf):
    rows = v.logit_scores(v.by_domain(v.with_logits(spark, sf)))
    out = separability.sign_audit(rows, ["domain", "backbone", "method"])
    return rounded(out, "auroc", "auroc_flipped", "id_mean", "ood_mean", "id_median", "ood_median", "ood_minus_id_mean")


@query(
    "sign_audit_family",
    f"""WITH {_AUDIT_SQL}
SELECT domain, backbone, bool_and(below_chance) AS family_all_below_chance, NOT bool_and(sum_to_one) AS sign_bug_suspected,
       count(*) AS n_methods FROM audit GROUP BY ALL""",
)
def sign_audit_family(spark, sf):
    rows = v.logit_scores(v.by_domain(v.with_logits(spark, sf)))
    return separability.sign_family_flags(separability.sign_audit(rows, ["domain", "backbone", "method"]), ["domain", "backbone"])


# --- calibration -----------------------------------------------------------------------


def _bin_sql(conf: str) -> str:
    return "1 + " + " + ".join(f"CASE WHEN {conf} > {i * (1.0 / 15)!r}::DOUBLE THEN 1 ELSE 0 END" for i in range(1, 15))


@query(
    "split_accuracy",
    f"""WITH {v.LOGITS_SQL}
SELECT backbone, split, {R("avg(CASE WHEN pred = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")} AS accuracy, count(*) AS n FROM zstat GROUP BY ALL""",
)
def split_accuracy(spark, sf):
    rows = v.with_logits(spark, sf).select("backbone", "split", S.correct(F.col("logits"), F.col("label")).alias("correct"))
    return rounded(calibration.accuracy(rows, ["backbone", "split"]), "accuracy")


@query(
    "ece_multiclass",
    f"""WITH {v.LOGITS_SQL}, b AS (SELECT backbone, split, {_bin_sql("msp")} AS bin, msp, pred = label AS hit FROM zstat),
g AS (SELECT backbone, split, bin, count(*) AS n, avg(msp) AS c, avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS a FROM b GROUP BY ALL)
SELECT backbone, split, {R("sum(abs(c - a) * n) / sum(n)")} AS ece, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY ALL""",
)
def ece_multiclass(spark, sf):
    z = F.col("logits")
    rows = v.with_logits(spark, sf).select(
        "backbone", "split", S.msp(z).alias("conf"), S.correct(z, F.col("label")).alias("correct")
    )
    return rounded(calibration.ece(rows, ["backbone", "split"], "conf", "correct"), "ece")


@query(
    "ece_binary",
    f"""WITH p AS (SELECT d.lang, (d.doc_id * 37 % 101) / 100.0::DOUBLE AS prob, l.quality AS label FROM documents d JOIN labels l USING (doc_id)),
c AS (SELECT lang, greatest(prob, 1.0::DOUBLE - prob) AS conf, (CASE WHEN prob > 0.5 THEN 1 ELSE 0 END) = label AS hit FROM p),
b AS (SELECT lang, {_bin_sql("conf")} AS bin, conf, hit FROM c),
g AS (SELECT lang, bin, count(*) AS n, avg(conf) AS c, avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS a FROM b GROUP BY ALL)
SELECT lang, {R("sum(abs(c - a) * n) / sum(n)")} AS ece, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY ALL""",
)
def ece_binary(spark, sf):
    """Binary calibration over a partial-label join."""
    docs = v.table(spark, sf, "documents", "doc_id", "lang").join(v.table(spark, sf, "labels", "doc_id", "quality"), "doc_id")
    rows = docs.select("lang", ((F.col("doc_id") * 37 % 101) / F.lit(100.0)).alias("prob"), F.col("quality").alias("label"))
    return rounded(calibration.binary_ece(rows, ["lang"], "prob", "label"), "ece")


@query(
    "reliability_bins",
    f"""WITH {v.LOGITS_SQL}, b AS (SELECT backbone, CAST({_bin_sql("msp")} AS INTEGER) AS bin, msp, pred = label AS hit FROM zstat)
SELECT backbone, bin, count(*) AS n, {R("avg(msp)")} AS mean_confidence,
       {R("avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")} AS accuracy FROM b GROUP BY ALL""",
)
def reliability_bins(spark, sf):
    z = F.col("logits")
    rows = v.with_logits(spark, sf).select("backbone", S.msp(z).alias("conf"), S.correct(z, F.col("label")).alias("correct"))
    return rounded(calibration.reliability_bins(rows, ["backbone"], "conf", "correct"), "mean_confidence", "accuracy")


_TEMPS = [0.05, 0.25, 0.5, 1.0, 2.0, 4.0, 10.0]


@query(
    "nll_temperature_curve",
    f"""WITH {v.LOGITS_SQL}, t(temp) AS (VALUES {", ".join(f"({x}::DOUBLE)" for x in _TEMPS)}),
n AS (SELECT backbone, sample_id, temp, max(zm) / temp + ln(sum(exp((z - zm) / temp))) - max(CASE WHEN class = label THEN z END) / temp AS nll
      FROM zmax CROSS JOIN t WHERE split = 'id_val' GROUP BY backbone, sample_id, temp)
SELECT backbone, temp AS t, {R("avg(nll)")} AS nll FROM n GROUP BY ALL""",
)
def nll_temperature_curve(spark, sf):
    rows = v.with_logits(spark, sf).where("split = 'id_val'")
    return rounded(calibration.nll_curve(rows, ["backbone"], _TEMPS, "logits", "label"), "nll")


# --- dispersion ------------------------------------------------------------------------

_TRIMMED_SQL = """
tr_r AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY x) AS rn, count(*) OVER (PARTITION BY {k}) AS n FROM {src}),
tr AS (SELECT {k}, avg(x) AS trim_mean, stddev_pop(x) AS trim_std, count(*) AS n_kept FROM tr_r
       WHERE n < 3 OR floor({share}::DOUBLE * n) <= 0 OR 2 * floor({share}::DOUBLE * n) >= n
          OR (rn > floor({share}::DOUBLE * n) AND rn <= n - floor({share}::DOUBLE * n)) GROUP BY {k})"""


def _trim_sql(src: str, keys: str, share: float = 0.01) -> str:
    return _TRIMMED_SQL.format(src=src, k=keys, share=share)


@query(
    "trimmed_stats",
    f"""WITH s AS (SELECT l_linestatus AS domain, l_returnflag AS side, l_extendedprice AS x FROM lineitem), {_trim_sql("s", "domain, side", 0.05)}
SELECT domain, side, {R("trim_mean")} AS trim_mean, {R("trim_std")} AS trim_std, n_kept FROM tr""",
)
def trimmed_stats(spark, sf):
    li = v.table(spark, sf, "lineitem", "l_linestatus", "l_returnflag", "l_extendedprice").toDF("domain", "side", "x")
    return rounded(dispersion.trimmed_stats(li, ["domain", "side"], "x", 0.05), "trim_mean", "trim_std")


_DISP_SQL = f"""{v.LOGITS_SQL},
side AS (SELECT domain, backbone, CASE WHEN is_id THEN 'ID' ELSE 'OOD' END AS side, logit_norm, logit_gap FROM dom),
m AS (SELECT domain, backbone, side, measure, x FROM side UNPIVOT (x FOR measure IN (logit_norm, logit_gap))),
{_trim_sql("m", "domain, backbone, side, measure")},
raw AS (SELECT domain, backbone, side, avg(logit_norm) AS nm, stddev_pop(logit_norm) AS ns, quantile_cont(logit_norm, 0.5) AS nmed, count(*) AS n
        FROM side GROUP BY ALL),
disp AS (SELECT r.domain, r.backbone, r.side, r.n AS n_samples, nm AS logit_norm_mean, ns AS logit_norm_std, nmed AS logit_norm_median,
                a.trim_std / (abs(a.trim_mean) + 1e-8::DOUBLE) AS cvid_logit_norm, g.trim_mean AS logit_gap_mean, g.trim_std AS logit_gap_std
         FROM raw r JOIN tr a ON a.domain = r.domain AND a.backbone = r.backbone AND a.side = r.side AND a.measure = 'logit_norm'
                    JOIN tr g ON g.domain = r.domain AND g.backbone = r.backbone AND g.side = r.side AND g.measure = 'logit_gap')"""
_DISP_COLS = ["logit_norm_mean", "logit_norm_std", "logit_norm_median", "cvid_logit_norm", "logit_gap_mean", "logit_gap_std"]


def _sides(spark, sf):
    rows = v.by_domain(v.with_logits(spark, sf)).withColumn("side", F.when(F.col("is_id"), "ID").otherwise("OOD"))
    return dispersion.with_logit_measures(rows).select("domain", "backbone", "side", "sample_id", "logit_norm", "logit_gap")


@query(
    "dispersion_table",
    f"""WITH {_DISP_SQL}
SELECT d.domain, d.backbone, d.side, d.n_samples, {", ".join(f"{R('d.' + c)} AS {c}" for c in _DISP_COLS)},
       {R("d.cvid_logit_norm - i.cvid_logit_norm")} AS cvid_gap_vs_id, {R("d.logit_norm_mean - i.logit_norm_mean")} AS logit_norm_mean_gap_vs_id,
       {R("d.logit_gap_mean - i.logit_gap_mean")} AS logit_gap_mean_gap_vs_id
FROM disp d JOIN disp i ON d.domain = i.domain AND d.backbone = i.backbone AND i.side = 'ID'""",
)
def dispersion_table(spark, sf):
    out = dispersion.dispersion_table(_sides(spark, sf), ["domain", "backbone"])
    return rounded(out, *_DISP_COLS, "cvid_gap_vs_id", "logit_norm_mean_gap_vs_id", "logit_gap_mean_gap_vs_id")


@query(
    "cvid_logit_norm",
    f"""WITH {_DISP_SQL} SELECT domain, backbone, side, {R("cvid_logit_norm")} AS cvid_logit_norm FROM disp""",
)
def cvid_logit_norm(spark, sf):
    return rounded(dispersion.cvid(_sides(spark, sf), ["domain", "backbone", "side"]), "cvid_logit_norm")


@query(
    "dispersion_regeneration_delta",
    f"""WITH {_DISP_SQL},
old AS (SELECT domain, backbone, side, avg(logit_norm) AS logit_norm_mean, avg(logit_gap) AS logit_gap_mean FROM side GROUP BY ALL)
SELECT d.domain, d.backbone, d.side, {R("d.logit_norm_mean")} AS logit_norm_mean, {R("d.logit_gap_mean")} AS logit_gap_mean,
       {R("d.logit_norm_mean - o.logit_norm_mean")} AS delta_logit_norm_mean, {R("d.logit_gap_mean - o.logit_gap_mean")} AS delta_logit_gap_mean
FROM disp d LEFT JOIN old o ON d.domain = o.domain AND d.backbone = o.backbone AND d.side = o.side""",
)
def dispersion_regeneration_delta(spark, sf):
    """New minus old dispersion numbers (old = untrimmed means)."""
    rows = _sides(spark, sf)
    keys = ["domain", "backbone", "side"]
    new = dispersion.logit_dispersion(rows, keys)
    old = rows.groupBy(*keys).agg(F.avg("logit_norm").alias("logit_norm_mean"), F.avg("logit_gap").alias("logit_gap_mean"))
    out = tables.difference(old, new, keys, ["logit_norm_mean", "logit_gap_mean"])
    return rounded(out, "logit_norm_mean", "logit_gap_mean", "delta_logit_norm_mean", "delta_logit_gap_mean")


def _band(share: float, x: str = "x") -> str:
    k = f"floor({share}::DOUBLE * n)"
    return f"avg({x}) FILTER (n < 3 OR {k} <= 0 OR 2 * {k} >= n OR (rn > {k} AND rn <= n - {k}))"


@query(
    "robust_profile",
    f"""WITH s AS (SELECT stratum, score AS x FROM ({"SELECT event_type AS stratum, value AS score FROM events"})),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY x) AS rn, count(*) OVER (PARTITION BY stratum) AS n FROM s),
q AS (SELECT stratum, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM s GROUP BY stratum)
SELECT stratum, count(*) AS n, {R("avg(x)")} AS mean, {R("quantile_cont(x, 0.5)")} AS median, {R("quantile_cont(x, 0.01)")} AS p01,
       {R("quantile_cont(x, 0.99)")} AS p99, {R("max(x)")} AS max, {R("avg(x)")} AS trim_00, {R(_band(0.01))} AS trim_01,
       {R(_band(0.05))} AS trim_05, {R(_band(0.10))} AS trim_10,
       {R("avg(CASE WHEN x < q1 - 3 * (q3 - q1) OR x > q3 + 3 * (q3 - q1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")} AS frac_beyond_3iqr
FROM r JOIN q USING (stratum) GROUP BY stratum""",
)
def robust_profile(spark, sf):
    out = dispersion.robust_profile(v.event_scores(spark, sf), ["stratum"], "score")
    return rounded(out, "mean", "median", "p01", "p99", "max", "trim_00", "trim_01", "trim_05", "trim_10", "frac_beyond_3iqr")


@query(
    "exact_percentiles",
    f"""SELECT l_linestatus AS domain, l_returnflag AS side, {R("quantile_cont(l_extendedprice, 0.05)")} AS p05,
       {R("quantile_cont(l_extendedprice, 0.5)")} AS p50, {R("quantile_cont(l_extendedprice, 0.975)")} AS p975 FROM lineitem GROUP BY ALL""",
)
def percentiles(spark, sf):
    li = v.table(spark, sf, "lineitem", "l_linestatus", "l_returnflag", "l_extendedprice").toDF("domain", "side", "x")
    return rounded(exact_percentiles(li, ["domain", "side"], "x", {"p05": 0.05, "p50": 0.5, "p975": 0.975}), "p05", "p50", "p975")


# --- correlation -----------------------------------------------------------------------


@query(
    "pearson_by_group",
    f"""SELECT l_linestatus AS domain, l_suppkey % 8 AS model, {R("corr(l_quantity, l_extendedprice)")} AS r, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def pearson_by_group(spark, sf):
    li = v.table(spark, sf, "lineitem", "l_linestatus", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = li.select(F.col("l_linestatus").alias("domain"), (F.col("l_suppkey") % 8).alias("model"), "l_quantity", "l_extendedprice")
    return rounded(correlation.pearson(rows, ["domain", "model"], "l_quantity", "l_extendedprice"), "r")


def _avg_rank_sql(keys: str, col: str) -> str:
    return (
        f"rank() OVER (PARTITION BY {keys} ORDER BY {col}) + (count(*) OVER (PARTITION BY {keys}, {col}) - 1) / 2.0::DOUBLE"
    )


@query(
    "spearman_by_group",
    f"""WITH s AS (SELECT l_linestatus AS domain, l_suppkey % 8 AS model, l_quantity AS x, l_extendedprice AS y FROM lineitem),
k AS (SELECT domain, model, {_avg_rank_sql("domain, model", "x")} AS rx, {_avg_rank_sql("domain, model", "y")} AS ry FROM s)
SELECT domain, model, {R("corr(rx, ry)")} AS rho, count(*) AS n FROM k GROUP BY ALL""",
)
def spearman_by_group(spark, sf):
    li = v.table(spark, sf, "lineitem", "l_linestatus", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = li.select(
        F.col("l_linestatus").alias("domain"), (F.col("l_suppkey") % 8).alias("model"),
        F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"),
    )
    return rounded(correlation.spearman(rows, ["domain", "model"], "x", "y"), "rho")


_HOLES = "CASE WHEN l_orderkey % 7 = 3 THEN NULL ELSE l_quantity END AS x, CASE WHEN l_linenumber = 4 THEN NULL ELSE l_extendedprice END AS y"


def _with_holes(spark, sf):
    li = v.table(spark, sf, "lineitem", "l_linestatus", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return li.select(
        F.col("l_linestatus").alias("domain"),
        (F.col("l_suppkey") % 8).alias("model"),
        F.when(F.col("l_orderkey") % 7 != 3, F.col("l_quantity")).alias("x"),
        F.when(F.col("l_linenumber") != 4, F.col("l_extendedprice")).alias("y"),
    )


@query(
    "pearson_with_nulls",
    f"""SELECT domain, model, {R("corr(x, y)")} AS r, count(*) AS n FROM (SELECT l_linestatus AS domain, l_suppkey % 8 AS model, {_HOLES} FROM lineitem)
WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL""",
)
def pearson_with_nulls(spark, sf):
    """Complete pairs only, in the deviations and the count too."""
    return rounded(correlation.pearson(_with_holes(spark, sf), ["domain", "model"], "x", "y"), "r")


@query(
    "spearman_with_nulls",
    f"""WITH s AS (SELECT * FROM (SELECT l_linestatus AS domain, l_suppkey % 8 AS model, {_HOLES} FROM lineitem) WHERE x IS NOT NULL AND y IS NOT NULL),
k AS (SELECT domain, model, {_avg_rank_sql("domain, model", "x")} AS rx, {_avg_rank_sql("domain, model", "y")} AS ry FROM s)
SELECT domain, model, {R("corr(rx, ry)")} AS rho, count(*) AS n FROM k GROUP BY ALL""",
)
def spearman_with_nulls(spark, sf):
    """Ranks are taken among complete pairs."""
    return rounded(correlation.spearman(_with_holes(spark, sf), ["domain", "model"], "x", "y"), "rho")
