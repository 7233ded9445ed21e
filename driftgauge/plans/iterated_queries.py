"""Iterative fits and matrix functions with SQL twins: the twin iterates too, as a recursive or unrolled query.

Probes and domain classifiers take Newton rounds on the planes (three coefficients, solved in closed form), the
temperature its grid rounds, p-values the steps of the beta continued fraction, and covariances of eight dimensions
Newton-Schulz steps for their root and inverse.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from driftgauge.functions import scores as S
from driftgauge.functions.draws import keyed_hash_sql
from driftgauge.operators import calibration, correlation, learners, moments, scorer
from driftgauge.plans import views as v
from driftgauge.plans.model_queries import _PLANE_SQL, CHAIN_SQL, KEYS, _readout, plane_model, planes
from driftgauge.plans.registry import query
from driftgauge.plans.views import R, rounded
from driftgauge.session import cut_lineage

ROUNDS = 25


def _newton_sql(rows: str, key: str, ridge: float) -> str:
    """CTE ``fit``(key, a, b, c): logistic coefficients of rows (key, x, y, t in {0, 1}, w); a growing step is halved."""
    k = [x.strip() for x in key.split(",")]
    on = " AND ".join(f"r.{x} = n.{x}" for x in k)
    keys = ", ".join(f"n.{x}" for x in k)
    free = learners.INTERCEPT_RIDGE
    p = "1 / (1 + exp(-(n.a * r.x + n.b * r.y + n.c)))"
    h = f"r.w * ({p}) * (1 - {p})"
    g = f"r.w * (({p}) - r.t)"
    return f"""
nw AS (SELECT DISTINCT {key}, 0 AS k, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c, 'inf'::DOUBLE AS size FROM {rows}
  UNION ALL
  SELECT {key}, k + 1, a - share * sa, b - share * sb, c - share * sc, step FROM (
    SELECT *, greatest(abs(sa), abs(sb), abs(sc)) AS step, CASE WHEN greatest(abs(sa), abs(sb), abs(sc)) > size THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS share FROM (
      SELECT *, (g1 * (h22 * h33 - h23 * h23) - h12 * (g2 * h33 - h23 * g3) + h13 * (g2 * h23 - h22 * g3)) / det AS sa,
                (h11 * (g2 * h33 - h23 * g3) - g1 * (h12 * h33 - h23 * h13) + h13 * (h12 * g3 - g2 * h13)) / det AS sb,
                (h11 * (h22 * g3 - g2 * h23) - h12 * (h12 * g3 - g2 * h13) + g1 * (h12 * h23 - h22 * h13)) / det AS sc FROM (
        SELECT *, h11 * (h22 * h33 - h23 * h23) - h12 * (h12 * h33 - h23 * h13) + h13 * (h12 * h23 - h22 * h13) AS det FROM (
          SELECT {keys}, max(n.k) AS k, max(n.a) AS a, max(n.b) AS b, max(n.c) AS c, max(n.size) AS size,
            sum({g} * r.x) + {ridge}::DOUBLE * max(n.a) AS g1, sum({g} * r.y) + {ridge}::DOUBLE * max(n.b) AS g2, sum({g}) + {free}::DOUBLE * max(n.c) AS g3,
            sum({h} * r.x * r.x) + {ridge}::DOUBLE AS h11, sum({h} * r.x * r.y) AS h12, sum({h} * r.x) AS h13,
            sum({h} * r.y * r.y) + {ridge}::DOUBLE AS h22, sum({h} * r.y) AS h23, sum({h}) + {free}::DOUBLE AS h33
          FROM nw n JOIN {rows} r ON {on} WHERE n.k < {ROUNDS} GROUP BY {keys}))))),
fit AS (SELECT {key}, a, b, c FROM nw WHERE k = {ROUNDS})"""


@query(
    "linear_probe_plane",
    f"""WITH RECURSIVE {_PLANE_SQL}, tr AS (SELECT backbone, a AS x, b AS y, label % 2 AS t, 1.0::DOUBLE AS w FROM pl WHERE split = 'train'), {_newton_sql("tr", "backbone", 1.0)}
SELECT p.backbone, split, {R("avg(CASE WHEN (f.a * p.a + f.b * p.b + f.c > 0) = (label % 2 = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")} AS accuracy, count(*) AS n,
  {R("max(f.a)")} AS weight_a, {R("max(f.b)")} AS weight_b, {R("max(f.c)")} AS bias FROM pl p JOIN fit f ON f.backbone = p.backbone GROUP BY p.backbone, split""",
)
def linear_probe_plane(spark, sf):
    """Probes of two classes on the planes: coefficients, and accuracy per split."""
    rows = planes(spark, sf).withColumn("label", F.col("label") % 2)
    heads = cut_lineage(learners.fit_probe(rows.where("split = 'train'"), KEYS))
    scored = scorer.linear_logits(rows, heads, KEYS).withColumn("ok", S.correct(F.col("logits"), F.col("label")))
    accuracy = scored.groupBy("backbone", "split").agg(F.avg("ok").alias("accuracy"), F.count(F.lit(1)).alias("n"))
    weights = heads.select("backbone", F.col("weight")[0].alias("weight_a"), F.col("weight")[1].alias("weight_b"), "bias")
    return rounded(accuracy.join(weights, "backbone"), "accuracy", "weight_a", "weight_b", "bias")


@query(
    "domain_classifier_plane",
    f"""WITH RECURSIVE {_PLANE_SQL},
ev AS (SELECT domain, backbone, sample_id, split = 'id_val' AS is_id, x, y FROM pu JOIN (VALUES ('near'), ('far')) d(domain) ON split = 'id_val' OR split = d.domain),
fo AS (SELECT *, row_number() OVER (PARTITION BY domain, backbone, is_id ORDER BY {keyed_hash_sql(42, "sample_id")}, sample_id) % 5 AS own FROM ev),
al AS (SELECT f.*, z.fold, own = z.fold AS held FROM fo f CROSS JOIN (SELECT unnest(range(0, 5)) AS fold) z),
st AS (SELECT domain, backbone, fold, avg(x) AS mx, avg(y) AS my, sqrt(greatest(avg(x * x) - avg(x) * avg(x), 0)) AS sx, sqrt(greatest(avg(y * y) - avg(y) * avg(y), 0)) AS sy,
   count(*) AS n, count(*) FILTER (is_id) AS n_id FROM al WHERE NOT held GROUP BY ALL),
sc AS (SELECT a.domain, a.backbone, a.fold, sample_id, is_id, held, (x - mx) / CASE WHEN sx > 0 THEN sx ELSE 1 END AS x, (y - my) / CASE WHEN sy > 0 THEN sy ELSE 1 END AS y,
   CASE WHEN is_id THEN 0 ELSE 1 END AS t, n / (2.0::DOUBLE * greatest(CASE WHEN is_id THEN n_id ELSE n - n_id END, 1)) AS w
   FROM al a JOIN st ON st.domain = a.domain AND st.backbone = a.backbone AND st.fold = a.fold),
tr AS (SELECT * FROM sc WHERE NOT held), {_newton_sql("tr", "domain, backbone, fold", 1.0)},
te AS (SELECT s.domain, s.backbone, s.fold, NOT is_id AS is_id, f.a * s.x + f.b * s.y + f.c AS score FROM sc s JOIN fit f ON f.domain = s.domain AND f.backbone = s.backbone AND f.fold = s.fold WHERE held),
{v.auroc_sql("te", "domain, backbone, fold")}
SELECT domain, backbone, {R("avg(auroc)")} AS mean_auroc, {R("stddev_pop(auroc)")} AS std_auroc, count(*) AS n_folds FROM au GROUP BY ALL""",
)
def domain_classifier_plane(spark, sf):
    """Five folds of each plane and shift, standardised, weighted and fitted anew in each."""
    keys = ["domain", "backbone"]
    rows = v.by_domain(planes(spark, sf)).select(*keys, "sample_id", "is_id", "feats")
    return rounded(learners.classifier_summary(learners.domain_classifier(rows, keys), keys), "mean_auroc", "std_auroc")


def _temperature_sql(points: int = 16) -> str:
    """CTEs of the grid rounds; ``best`` is the last one."""
    low, high = calibration.T_LOW, calibration.T_HIGH
    width, number, parts = high - low, 0, [f"br0 AS (SELECT DISTINCT backbone, {low}::DOUBLE AS lo, {high}::DOUBLE AS hi FROM zmax WHERE split = 'id_val')"]
    while width > calibration.T_TOLERANCE:
        parts.append(f"""gr{number} AS MATERIALIZED (SELECT b.backbone, lo, hi, lo + (hi - lo) / {points - 1} * i AS t, (hi - lo) / {points - 1} AS step FROM br{number} b CROSS JOIN (SELECT unnest(range(0, {points})) AS i)),
ro{number} AS (SELECT z.backbone, sample_id, t, max(zm) / t + ln(sum(exp((z - zm) / t))) - max(CASE WHEN class = label THEN z END) / t AS nll
   FROM zmax z JOIN gr{number} g ON g.backbone = z.backbone WHERE split = 'id_val' GROUP BY z.backbone, sample_id, t),
nl{number} AS MATERIALIZED (SELECT backbone, t, avg(nll) AS nll FROM ro{number} GROUP BY ALL),
be{number} AS MATERIALIZED (SELECT backbone, arg_min(t, nll) AS t_star, min(nll) AS nll_at_tstar FROM nl{number} GROUP BY backbone),
br{number + 1} AS MATERIALIZED (SELECT DISTINCT g.backbone, greatest({low}::DOUBLE, t_star - step) AS lo, least({high}::DOUBLE, t_star + step) AS hi FROM be{number} b JOIN gr{number} g ON g.backbone = b.backbone)""")
        width, number = width * 2.0 / (points - 1), number + 1
    return ", ".join([*parts, f"best AS (SELECT * FROM be{number - 1})"])


@query("temperature_fit", f"""WITH {v.LOGITS_SQL}, {_temperature_sql()} SELECT backbone, {R("t_star")} AS t_star, {R("nll_at_tstar")} AS nll_at_tstar FROM best""")
def temperature_fit(spark, sf):
    """T* per backbone on ID validation rows, by nested grids."""
    rows = v.with_logits(spark, sf).where("split = 'id_val'")
    return rounded(calibration.fit_temperature(rows, ["backbone"]), "t_star", "nll_at_tstar")


@query(
    "correlation_p_values",
    f"""WITH RECURSIVE {v.EVENTS_SQL}, r AS (SELECT stratum, corr(CAST(user_id AS DOUBLE), score) AS r, count(*) AS n FROM scored WHERE user_id IS NOT NULL AND score IS NOT NULL GROUP BY stratum),
q AS (SELECT stratum, (n - 2) / 2.0::DOUBLE AS a, 0.5::DOUBLE AS b, greatest(0.0::DOUBLE, 1 - r * r) AS x FROM r),
s AS (SELECT *, x < (a + 1) / (a + b + 2) AS straight FROM q),
u AS (SELECT stratum, straight, CASE WHEN straight THEN a ELSE b END AS a, CASE WHEN straight THEN b ELSE a END AS b, CASE WHEN straight THEN x ELSE 1 - x END AS x,
   exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(x) + b * ln(1 - x)) AS front FROM s),
f AS (SELECT stratum, 0 AS m, 1.0::DOUBLE AS c, 1 / (1 - (a + b) * x / (a + 1)) AS d, 1 / (1 - (a + b) * x / (a + 1)) AS h, 2.0::DOUBLE AS moved FROM u
  UNION ALL
  SELECT stratum, m + 1, c2, d2, h * (d1 * c1) * (d2 * c2), abs(d2 * c2 - 1) FROM (
    SELECT *, 1 / (1 + even * d1) AS d2, 1 + even / c1 AS c2 FROM (
      SELECT f.*, 1 / (1 + odd * d) AS d1, 1 + odd / c AS c1, odd, even FROM (
        SELECT f.*, (m + 1) * (b - m - 1) * x / ((a + 2 * m + 1) * (a + 2 * m + 2)) AS odd, -(a + m + 1) * (a + b + m + 1) * x / ((a + 2 * m + 2) * (a + 2 * m + 3)) AS even
        FROM f JOIN u ON u.stratum = f.stratum WHERE m < 399 AND moved >= 1e-15::DOUBLE) f))),
e AS (SELECT stratum, arg_max(h, m) AS h FROM f GROUP BY stratum)
SELECT r.stratum, {R("r.r")} AS r, n, {R("CASE WHEN straight THEN front * h / a ELSE 1 - front * h / a END")} AS p_value FROM r JOIN u ON u.stratum = r.stratum JOIN e ON e.stratum = r.stratum""",
)
def correlation_p_values(spark, sf):
    """Pearson with two-sided Student-t p-values."""
    e = v.event_scores(spark, sf)
    rows = e.select("stratum", F.col("user_id").cast("double").alias("x"), F.col("score").alias("y"))
    return rounded(correlation.with_p_value(correlation.pearson(rows, ["stratum"], "x", "y"), "r"), "r", "p_value")


@query(
    "per_sample_report_plane",
    f"""WITH {CHAIN_SQL}, pr AS (SELECT z.backbone, z.sample_id, arg_min(w.class, (-(a * wa + b * wb), w.class)) AS prediction FROM pl z JOIN w ON w.backbone = z.backbone WHERE split <> 'train' GROUP BY ALL),
la AS (SELECT backbone, sample_id, label FROM pl)
SELECT x.backbone, x.sample_id, split, label, CAST(prediction AS INTEGER) AS prediction, {", ".join(f"{R(m)} AS {m}" for m in scorer.METHODS)}
FROM wide x JOIN pr ON pr.backbone = x.backbone AND pr.sample_id = x.sample_id JOIN la ON la.backbone = x.backbone AND la.sample_id = x.sample_id WHERE split <> 'train'""",
)
def per_sample_report_plane(spark, sf):
    """Label, prediction and all seven scores of every evaluation row of the planes."""
    model, rows = plane_model(spark, sf)
    scored = rows.where("split <> 'train'").withColumn("prediction", S.predicted_class(F.col("logits")).cast("int"))
    out = model.wide(scored).select("backbone", "sample_id", "split", "label", "prediction", *scorer.METHODS)
    return rounded(out, *scorer.METHODS)


# --- eight dimensions: the root and the inverse of a covariance by Newton-Schulz steps -----------

_D = 8
_EIGHTS_SQL = f"""
oc AS (SELECT 'o' || CAST(k AS VARCHAR) AS backbone, vec_id AS sample_id,
   CASE WHEN vec_id % 5 IN (0, 3, 4) THEN CASE WHEN (vec_id // 5) % 10 = 0 THEN 'id_val' ELSE 'train' END WHEN vec_id % 5 = 1 THEN 'near' ELSE 'far' END AS split,
   list_transform(embedding[{_D} * k + 1 : {_D} * k + {_D}], lambda e: CAST(e AS DOUBLE) + CASE WHEN vec_id % 5 = 2 THEN {v.SHIFT}::DOUBLE ELSE 0.0::DOUBLE END) AS f
   FROM embeddings CROSS JOIN (SELECT unnest(range(0, {64 // _D})) AS k))"""
_ONE = "[" + ", ".join("1.0::DOUBLE" if i % (_D + 1) == 0 else "0.0::DOUBLE" for i in range(_D * _D)) + "]"


def _times(a: str, b: str) -> str:
    """Product of two matrices held as lists by rows."""
    column = f"list_transform(range(0, {_D}), lambda k: {b}[{_D} * k + (t % {_D}) + 1])"
    return f"list_transform(range(0, {_D * _D}), lambda t: list_dot_product({a}[{_D} * (t // {_D}) + 1 : {_D} * (t // {_D}) + {_D}], {column}))"


def _minus(scale: float, m: str) -> str:
    """scale * I - m."""
    return f"list_transform(range(0, {_D * _D}), lambda t: {scale}::DOUBLE * {_ONE}[t + 1] - {m}[t + 1])"


def eights(spark, sf):
    """The samples with eight groups of eight dimensions as backbones."""
    s = v.samples(spark, sf).where("backbone = 'b64'")
    parts = F.transform(F.sequence(F.lit(0), F.lit(64 // _D - 1)), lambda i: F.struct(i.alias("i"), F.slice("feats", _D * i + 1, _D).alias("f")))
    flat = s.withColumn("p", F.explode(parts))
    return cut_lineage(flat.withColumns({"backbone": F.concat(F.lit("o"), F.col("p.i").cast("string")), "feats": F.col("p.f")}).drop("p"))


_COV_SQL = f"""
lo AS (SELECT *, unnest(f) AS x, generate_subscripts(f, 1) - 1 AS i FROM s)"""


@query(
    "frechet_eight",
    f"""WITH RECURSIVE {_EIGHTS_SQL},
s AS (SELECT domain, backbone, sample_id, split = 'id_val' AS is_id, f FROM oc JOIN (VALUES ('near'), ('far')) d(domain) ON split = 'id_val' OR split = d.domain),
{_COV_SQL},
co AS (SELECT a.domain, a.backbone, a.is_id, list(c ORDER BY a.i, a.j) AS c, sum(CASE WHEN i = j THEN c END) AS tr FROM (
   SELECT a.domain, a.backbone, a.is_id, a.i, b.i AS j, covar_samp(a.x, b.x) AS c FROM lo a JOIN lo b ON a.domain = b.domain AND a.backbone = b.backbone AND a.is_id = b.is_id AND a.sample_id = b.sample_id GROUP BY ALL) a GROUP BY ALL),
me AS (SELECT domain, backbone, sum((p - q) * (p - q)) AS shift FROM (SELECT domain, backbone, i, avg(x) FILTER (is_id) AS p, avg(x) FILTER (NOT is_id) AS q FROM lo GROUP BY ALL) GROUP BY ALL),
pr AS (SELECT p.domain, p.backbone, p.tr + q.tr AS tr, p.c AS pc, q.c AS qc FROM co p JOIN co q ON p.domain = q.domain AND p.backbone = q.backbone AND p.is_id AND NOT q.is_id),
mm AS (SELECT domain, backbone, tr, {_times("pc", "qc")} AS m FROM pr),
sm AS (SELECT *, list_sum(list_transform(range(0, {_D}), lambda t: m[{_D + 1} * t + 1])) AS scale FROM mm),
it AS (SELECT domain, backbone, 0 AS k, list_transform(m, lambda e: e / scale) AS y, {_ONE} AS z FROM sm
  UNION ALL
  SELECT domain, backbone, k + 1, list_transform({_times("y", "w")}, lambda e: e / 2), list_transform({_times("w", "z")}, lambda e: e / 2) FROM (
    SELECT domain, backbone, k, y, z, {_minus(3, "zy")} AS w FROM (SELECT *, {_times("z", "y")} AS zy FROM it WHERE k < 40))),
ro AS (SELECT i.domain, i.backbone, sqrt(scale) * list_sum(list_transform(range(0, {_D}), lambda t: y[{_D + 1} * t + 1])) AS root FROM it i JOIN sm ON sm.domain = i.domain AND sm.backbone = i.backbone WHERE k = 40)
SELECT ro.domain, ro.backbone, {R("shift + tr - 2 * root")} AS fid FROM ro JOIN sm ON sm.domain = ro.domain AND sm.backbone = ro.backbone JOIN me ON me.domain = ro.domain AND me.backbone = ro.backbone""",
)
def frechet_eight(spark, sf):
    """Frechet distance in eight dimensions, both shifts."""
    rows = v.by_domain(eights(spark, sf)).withColumn("side", F.when(F.col("is_id"), "ID").otherwise("OOD"))
    return rounded(moments.frechet_distance(rows, ["domain", "backbone"]), "fid")


@query(
    "geometry_eight",
    f"""WITH RECURSIVE {_EIGHTS_SQL},
s AS (SELECT backbone, sample_id, split, list_transform(f, lambda e: e / (sqrt(list_dot_product(f, f)) + 1e-8::DOUBLE)) AS f FROM oc),
{_COV_SQL},
mu AS (SELECT backbone, i, avg(x) AS m FROM lo WHERE split = 'train' GROUP BY ALL),
ce AS (SELECT lo.backbone, sample_id, lo.i, x - m AS x FROM lo JOIN mu ON lo.backbone = mu.backbone AND lo.i = mu.i WHERE split = 'train'),
q4 AS (SELECT backbone, sum(s * s) AS q4, count(*) AS n FROM (SELECT backbone, sample_id, sum(x * x) AS s FROM ce GROUP BY ALL) GROUP BY backbone),
cv AS (SELECT a.backbone, a.i, b.i AS j, sum(a.x * b.x) / max(n) AS c FROM ce a JOIN ce b ON a.backbone = b.backbone AND a.sample_id = b.sample_id JOIN q4 ON q4.backbone = a.backbone GROUP BY a.backbone, a.i, b.i),
st AS (SELECT backbone, sum(CASE WHEN i = j THEN c END) / {_D} AS mu, sum(c * c) AS sq FROM cv GROUP BY backbone),
lw AS (SELECT st.backbone, mu, least((q4 / n - sq) / ({_D}::DOUBLE * n), sq / {_D} - mu * mu) / (sq / {_D} - mu * mu) AS w, n FROM st JOIN q4 ON q4.backbone = st.backbone),
k AS (SELECT cv.backbone, list((1 - w) * c + CASE WHEN i = j THEN w * mu ELSE 0 END ORDER BY i, j) AS a, max({_D} * mu) AS tr FROM cv JOIN lw ON lw.backbone = cv.backbone GROUP BY cv.backbone),
it AS (SELECT backbone, 0 AS n, a, list_transform({_ONE}, lambda e: e / tr) AS x FROM k
  UNION ALL
  SELECT backbone, n + 1, a, {_times("x", "w")} FROM (SELECT backbone, n, a, x, {_minus(2, "ax")} AS w FROM (SELECT *, {_times("a", "x")} AS ax FROM it WHERE n < 40))),
sh AS (SELECT lo.backbone, split AS domain, lo.i, avg(x) - max(m) AS d FROM lo JOIN mu ON lo.backbone = mu.backbone AND lo.i = mu.i WHERE split IN ('near', 'far') GROUP BY ALL),
dl AS (SELECT backbone, domain, list(d ORDER BY i) AS d FROM sh GROUP BY ALL),
no AS (SELECT backbone, split AS domain, count(*) AS n_ood FROM s WHERE split IN ('near', 'far') GROUP BY ALL)
SELECT dl.domain, dl.backbone, {R("sqrt(list_dot_product(d, d))")} AS mean_shift,
  {R(f"sqrt(list_sum(list_transform(range(0, {_D * _D}), lambda t: d[(t // {_D}) + 1] * x[t + 1] * d[(t % {_D}) + 1])))")} AS maha_mean_shift, lw.n AS n_train, n_ood, CAST({_D} AS INTEGER) AS feat_dim
FROM dl JOIN it ON it.backbone = dl.backbone AND it.n = 40 JOIN lw ON lw.backbone = dl.backbone JOIN no ON no.backbone = dl.backbone AND no.domain = dl.domain""",
)
def geometry_eight(spark, sf):
    """Mean shift and its Mahalanobis length in eight dimensions, both shifts."""
    out = _readout(eights(spark, sf)).drop("pct_shift_in_top5_eigenspace")
    return rounded(out, "mean_shift", "maha_mean_shift")
