"""Fitted scores: covariance, clip level, residual space, neighbours, probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftgauge.functions import scores as S
from driftgauge.functions.draws import keyed_hash_sql
from driftgauge.operators import (
    calibration, correlation, decisions, learners, moments, ranks, scorer, separability, sweeps, tables,
)
from driftgauge.operators.knn import knn_distance, knn_join
from driftgauge.plans import views as v
from driftgauge.plans.rank_queries import CELLS_SQL, cells
from driftgauge.plans.registry import query
from driftgauge.plans.views import R, r6, rounded
from driftgauge.session import cut_lineage, written_by

KEYS = ["backbone"]


def _train(spark, sf):
    return v.samples(spark, sf).where("split = 'train'")


_UNIT_SQL = """
un AS (SELECT backbone, sample_id, split, list_transform(feats, lambda x: x / (sqrt(list_dot_product(feats, feats)) + 1e-8::DOUBLE)) AS u FROM samples),
ue AS (SELECT backbone, sample_id, split, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM un)"""

_LW_SQL = f"""{v.SAMPLES_SQL}, {_UNIT_SQL},
mu AS (SELECT backbone, i, avg(x) AS m FROM ue WHERE split = 'train' GROUP BY ALL),
ce AS (SELECT ue.backbone, sample_id, ue.i, x - m AS x FROM ue JOIN mu ON ue.backbone = mu.backbone AND ue.i = mu.i WHERE split = 'train'),
cnt AS (SELECT backbone, count(DISTINCT sample_id) AS n, max(i) AS p FROM ce GROUP BY backbone),
q4 AS (SELECT backbone, sum(s * s) AS q4 FROM (SELECT backbone, sample_id, sum(x * x) AS s FROM ce GROUP BY ALL) GROUP BY backbone),
cov AS (SELECT a.backbone, a.i, b.i AS j, sum(a.x * b.x) / max(n) AS c FROM ce a JOIN ce b ON a.backbone = b.backbone AND a.sample_id = b.sample_id JOIN cnt ON cnt.backbone = a.backbone GROUP BY a.backbone, a.i, b.i),
st AS (SELECT backbone, sum(CASE WHEN i = j THEN c END) AS tr, sum(c * c) AS sq FROM cov GROUP BY backbone),
lw AS (SELECT st.backbone, n, p, tr / p AS mu, sq / p - (tr / p) * (tr / p) AS delta, (q4 / n - sq) / (CAST(p AS DOUBLE) * n) AS beta FROM st JOIN cnt USING (backbone) JOIN q4 USING (backbone))"""


@query(
    "ledoit_wolf_shrinkage",
    f"""WITH {_LW_SQL} SELECT backbone, n, CAST(p AS INTEGER) AS dim, {R("least(beta, delta) / delta")} AS shrinkage FROM lw""",
)
def ledoit_wolf_shrinkage(spark, sf):
    fit = moments.ledoit_wolf(_train(spark, sf), KEYS)
    return rounded(fit.select("backbone", "n", "dim", "shrinkage"), "shrinkage")


@query(
    "feature_means",
    f"""WITH {v.SAMPLES_SQL}, {_UNIT_SQL} SELECT backbone, split, CAST(i - 1 AS INTEGER) AS dim, {R("avg(x)")} AS mean FROM ue GROUP BY ALL""",
)
def feature_means(spark, sf):
    means = moments.vector_means(v.samples(spark, sf), ["backbone", "split"], "feats", normalize=True)
    return rounded(means.select("backbone", "split", F.posexplode("mean").alias("dim", "mean")), "mean")


@query(
    "feature_covariance",
    f"""WITH {v.SAMPLES_SQL}, e AS (SELECT backbone, split, sample_id, len(feats) AS d, unnest(feats) AS x, generate_subscripts(feats, 1) AS i FROM samples)
SELECT a.backbone, a.split, CAST((a.i - 1) * max(a.d) + b.i - 1 AS INTEGER) AS cell, {R("covar_samp(a.x, b.x)")} AS cov FROM e a JOIN e b ON a.backbone = b.backbone AND a.sample_id = b.sample_id GROUP BY a.backbone, a.split, a.i, b.i""",
)
def feature_covariance(spark, sf):
    cov = moments.mean_and_covariance(v.samples(spark, sf), ["backbone", "split"])
    return rounded(cov.select("backbone", "split", F.posexplode("cov").alias("cell", "cov")), "cov")


# Every pair of dimensions is a backbone of its own: 32 planes use all of the vector, and in a plane every fit has a
# closed form, so the fitted scores get a SQL twin.
_PLANES = 32
_PLANE_SQL = f"""
pl AS (SELECT 'p' || lpad(CAST(k AS VARCHAR), 2, '0') AS backbone, vec_id AS sample_id, label,
   CASE WHEN vec_id % 5 IN (0, 3, 4) THEN CASE WHEN (vec_id // 5) % 10 = 0 THEN 'id_val' ELSE 'train' END WHEN vec_id % 5 = 1 THEN 'near' ELSE 'far' END AS split,
   CAST(embedding[2 * k + 1] AS DOUBLE) + CASE WHEN vec_id % 5 = 2 THEN {v.SHIFT}::DOUBLE ELSE 0.0::DOUBLE END AS a,
   CAST(embedding[2 * k + 2] AS DOUBLE) + CASE WHEN vec_id % 5 = 2 THEN {v.SHIFT}::DOUBLE ELSE 0.0::DOUBLE END AS b FROM embeddings CROSS JOIN (SELECT unnest(range(0, {_PLANES})) AS k)),
pu AS (SELECT *, a / (sqrt(a * a + b * b) + 1e-8::DOUBLE) AS x, b / (sqrt(a * a + b * b) + 1e-8::DOUBLE) AS y FROM pl)"""


def planes(spark, sf):
    """The samples with 32 pairs of dimensions as backbones, written once by cell and split."""
    s = v.samples(spark, sf).where("backbone = 'b64'")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(_PLANES - 1)), lambda i: F.struct(i.alias("i"), F.slice("feats", 2 * i + 1, 2).alias("f")))
    flat = s.withColumn("p", F.explode(pairs)).withColumns(
        {"backbone": F.concat(F.lit("p"), F.lpad(F.col("p.i").cast("string"), 2, "0")), "feats": F.col("p.f")}
    ).drop("p")
    return written_by(flat, *KEYS, "split")


def plane_model(spark, sf, methods=None):
    """Fitted scorer and all rows of the planes."""
    rows = planes(spark, sf)
    h = cut_lineage(v.heads(rows))
    rows = scorer.linear_logits(rows, h, KEYS)
    return scorer.ShiftScorer(methods=methods).fit(rows.where("split = 'train'"), h, KEYS), rows


def _plane_fit_sql(src: str, key: str | None = None) -> str:
    """CTE ``k``: shrunk 2 x 2 covariance (kxx, kxy, kyy), mean (mx, my), weight w per key."""
    g, on = (f"{key}, ", f"USING ({key})") if key else ("", "ON true")
    by = f"GROUP BY {key}" if key else ""
    return f"""
m AS (SELECT {g}avg(x) AS mx, avg(y) AS my, count(*) AS n FROM {src} {by}),
c AS (SELECT {g}max(n) AS n, max(mx) AS mx, max(my) AS my, avg((x - mx) * (x - mx)) AS sxx, avg((x - mx) * (y - my)) AS sxy, avg((y - my) * (y - my)) AS syy,
   sum(((x - mx) * (x - mx) + (y - my) * (y - my)) * ((x - mx) * (x - mx) + (y - my) * (y - my))) AS q4 FROM {src} JOIN m {on} {by}),
s AS (SELECT *, (sxx + syy) / 2 AS mu, sxx * sxx + 2 * sxy * sxy + syy * syy AS sq FROM c),
sw AS (SELECT *, least((q4 / n - sq) / (2.0::DOUBLE * n), sq / 2 - mu * mu) / (sq / 2 - mu * mu) AS w FROM s),
kk AS (SELECT *, (1 - w) * sxx + w * mu AS kxx, (1 - w) * sxy AS kxy, (1 - w) * syy + w * mu AS kyy FROM sw),
k AS (SELECT *, ((kxx + kyy) / 2 + sqrt((kxx - kyy) * (kxx - kyy) / 4 + kxy * kxy)) / ((kxx + kyy) / 2 - sqrt((kxx - kyy) * (kxx - kyy) / 4 + kxy * kxy)) AS cond FROM kk)"""


def _plane_distance(dx: str, dy: str) -> str:
    return f"sqrt((({dx}) * ({dx}) * kyy - 2 * ({dx}) * ({dy}) * kxy + ({dy}) * ({dy}) * kxx) / (kxx * kyy - kxy * kxy))"


@query(
    "mahalanobis_plane",
    f"""WITH {_PLANE_SQL}, tr AS (SELECT backbone, x, y FROM pu WHERE split = 'train'), {_plane_fit_sql("tr", "backbone")}
SELECT pu.backbone, sample_id, split, {R("-" + _plane_distance("x - mx", "y - my"))} AS mahalanobis FROM pu JOIN k ON k.backbone = pu.backbone""",
)
def mahalanobis_plane(spark, sf):
    rows = planes(spark, sf)
    fit = cut_lineage(moments.ledoit_wolf(rows.where("split = 'train'"), KEYS))
    return scorer.mahalanobis_score(rows, fit, KEYS, out="mahalanobis").select(
        "backbone", "sample_id", "split", r6(F.col("mahalanobis")).alias("mahalanobis")
    )


@query(
    "frechet_plane",
    f"""WITH {_PLANE_SQL}, g AS (SELECT backbone, domain, CASE WHEN split = 'id_val' THEN 'ID' ELSE 'OOD' END AS side, avg(a) AS ma, avg(b) AS mb, covar_samp(a, a) AS aa, covar_samp(a, b) AS ab, covar_samp(b, b) AS bb
   FROM pl JOIN (VALUES ('near'), ('far')) d(domain) ON split = 'id_val' OR split = d.domain GROUP BY ALL), j AS (SELECT i.domain, i.backbone, i.ma - o.ma AS da, i.mb - o.mb AS db, i.aa + i.bb + o.aa + o.bb AS tr, i.aa * o.aa + 2 * i.ab * o.ab + i.bb * o.bb AS trp,
   (i.aa * i.bb - i.ab * i.ab) * (o.aa * o.bb - o.ab * o.ab) AS det FROM g i JOIN g o ON i.side = 'ID' AND o.side = 'OOD' AND i.backbone = o.backbone AND i.domain = o.domain)
SELECT domain, backbone, {R("da * da + db * db + tr - 2 * sqrt(trp + 2 * sqrt(det))")} AS fid FROM j""",
)
def frechet_plane(spark, sf):
    rows = v.by_domain(planes(spark, sf)).withColumn("side", F.when(F.col("is_id"), "ID").otherwise("OOD"))
    return rounded(moments.frechet_distance(rows, ["domain", "backbone"]), "fid")


def _readout(rows):
    """Both shifts against the training rows of their backbone."""
    shifted = rows.where("split in ('near', 'far')").withColumn("domain", F.col("split"))
    return moments.geometry_readout(rows.where("split = 'train'"), shifted, KEYS, by=("domain",))


@query(
    "geometry_plane",
    f"""WITH {_PLANE_SQL}, tr AS (SELECT backbone, x, y FROM pu WHERE split = 'train'), {_plane_fit_sql("tr", "backbone")}, o AS (SELECT backbone, split AS domain, avg(x) AS ox, avg(y) AS oy, count(*) AS n_ood FROM pu WHERE split IN ('near', 'far') GROUP BY ALL)
SELECT domain, k.backbone, {R("sqrt((ox - mx) * (ox - mx) + (oy - my) * (oy - my))")} AS mean_shift, {R(_plane_distance("ox - mx", "oy - my"))} AS maha_mean_shift,
  {R("100 * ((ox - mx) * (ox - mx) + (oy - my) * (oy - my)) / ((ox - mx) * (ox - mx) + (oy - my) * (oy - my) + 1e-12::DOUBLE)")} AS pct_shift_in_top5_eigenspace, n AS n_train, n_ood, CAST(2 AS INTEGER) AS feat_dim FROM k JOIN o ON o.backbone = k.backbone""",
)
def geometry_plane(spark, sf):
    out = _readout(planes(spark, sf))
    return rounded(out, "mean_shift", "maha_mean_shift", "pct_shift_in_top5_eigenspace")


def _plane_eval_sql(key: str) -> str:
    return f"""SELECT domain, k.backbone, k.{key}, sample_id, split = 'id_val' AS is_id, -{_plane_distance("x - mx", "y - my")} AS score FROM pu JOIN k ON k.backbone = pu.backbone
   JOIN (VALUES ('near'), ('far')) d(domain) ON split = 'id_val' OR split = d.domain"""


@query(
    "fit_size_plane",
    f"""WITH {_PLANE_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY backbone ORDER BY {keyed_hash_sql(42, "sample_id")}, sample_id) AS pos, count(*) OVER (PARTITION BY backbone) AS size FROM pu WHERE split = 'train'),
tr AS (SELECT backbone, n_train, x, y FROM o JOIN (VALUES (100), (500), (1000), (2500), (5000)) z(n_train) ON pos <= n_train AND n_train <= size), {_plane_fit_sql("tr", "backbone, n_train")},
scored AS ({_plane_eval_sql("n_train")}), {v.sep_sql("scored", "domain, backbone, n_train")}
SELECT sep.domain, sep.backbone, CAST(sep.n_train AS INTEGER) AS n_train, {R("auroc")} AS auroc, {R("fpr95")} AS fpr95, {R("w")} AS shrinkage FROM sep JOIN k ON sep.n_train = k.n_train AND sep.backbone = k.backbone""",
)
def fit_size_plane(spark, sf):
    """Refits on nested subsets of the published sizes, checked against closed forms; sizes over the table give no row."""
    rows = planes(spark, sf)
    out = sweeps.fit_size_ablation(rows.where("split = 'train'"), v.by_domain(rows), KEYS, by=("domain",))
    return rounded(out.select("domain", "backbone", "n_train", "auroc", "fpr95", "shrinkage"), "auroc", "fpr95", "shrinkage")


_REFIT = {
    "auroc_sub_mean": "avg(auroc)", "auroc_sub_std": "stddev_samp(auroc)", "auroc_sub_min": "min(auroc)", "auroc_sub_max": "max(auroc)",
    "cond_prec_sub_mean": "avg(cond)", "cond_prec_sub_std": "stddev_samp(cond)", "shrinkage_sub_mean": "avg(w)",
}
_REFIT_FULL = {n: "0.0::DOUBLE" if n.endswith("_std") else n.split("_sub_")[0] + "_full" for n in _REFIT}


@query(
    "subsample_refits_plane",
    f"""WITH {_PLANE_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY backbone, draw ORDER BY {keyed_hash_sql(42, "draw", "sample_id")}, sample_id) AS pos
   FROM pu CROSS JOIN (SELECT unnest(range(0, 20)) AS draw) WHERE split = 'train'),
tr AS (SELECT backbone, draw, x, y FROM o WHERE pos <= 120 UNION ALL SELECT backbone, -1, x, y FROM pu WHERE split = 'train'), {_plane_fit_sql("tr", "backbone, draw")}, scored AS ({_plane_eval_sql("draw")}), {v.auroc_sql("scored", "domain, backbone, draw")},
j AS (SELECT au.domain, au.backbone, au.draw, auroc, cond, w, n FROM au JOIN k ON au.draw = k.draw AND au.backbone = k.backbone), f AS (SELECT domain, backbone, n AS n_full, auroc AS auroc_full, cond AS cond_prec_full, w AS shrinkage_full FROM j WHERE draw = -1),
sub AS (SELECT domain, backbone, count(*) AS n_draws, {", ".join(f"{e} AS {n}" for n, e in _REFIT.items())} FROM j WHERE draw >= 0 GROUP BY ALL)
SELECT f.domain, f.backbone, n_full, {R("auroc_full")} AS auroc_full, {R("cond_prec_full")} AS cond_prec_full, {R("shrinkage_full")} AS shrinkage_full, n_full > 120 AS subsampled,
  CASE WHEN n_full > 120 THEN 120 ELSE n_full END AS n_sub, CASE WHEN n_full > 120 THEN n_draws ELSE 0 END AS n_draws,
  {", ".join(f"{R(f'CASE WHEN n_full > 120 THEN {n} ELSE {i} END')} AS {n}" for n, i in _REFIT_FULL.items())} FROM f JOIN sub ON sub.backbone = f.backbone AND sub.domain = f.domain""",
)
def subsample_refits_plane(spark, sf):
    """Twenty refits on subsamples without replacement beside the full fit."""
    rows = planes(spark, sf)
    out = sweeps.subsample_refits(rows.where("split = 'train'"), v.by_domain(rows), KEYS, n_sub=120, by=("domain",))
    return rounded(out, "auroc_full", "cond_prec_full", "shrinkage_full", *_REFIT)


@query("frechet_distance")
def frechet_distance(spark, sf):
    """All backbones and domains, all rows (matrix square root: no SQL twin beyond the plane)."""
    rows = v.by_domain(v.samples(spark, sf)).withColumn("side", F.when(F.col("is_id"), "ID").otherwise("OOD"))
    return rounded(moments.frechet_distance(rows, ["domain", "backbone"]), "fid")


@query("geometry_readout")
def geometry_readout(spark, sf):
    """Mean shift, Mahalanobis shift and top-eigenspace share (needs an inverse and eigenvectors)."""
    out = _readout(v.samples(spark, sf))
    return rounded(out, "mean_shift", "maha_mean_shift", "pct_shift_in_top5_eigenspace")


_MEAN_SQL = f"""{v.SAMPLES_SQL}, {_UNIT_SQL}, m AS (SELECT backbone, i, avg(x) AS a FROM ue WHERE split = 'train' GROUP BY ALL), o AS (SELECT backbone, split AS domain, i, avg(x) AS b FROM ue WHERE split IN ('near', 'far') GROUP BY ALL)"""


@query(
    "mean_shift",
    f"""WITH {_MEAN_SQL} SELECT domain, o.backbone, {R("sqrt(sum((b - a) * (b - a)))")} AS mean_shift FROM m JOIN o ON o.backbone = m.backbone AND o.i = m.i GROUP BY domain, o.backbone""",
)
def mean_shift(spark, sf):
    return rounded(_readout(v.samples(spark, sf)).select("domain", "backbone", "mean_shift"), "mean_shift")


# --- clipped-feature energy --------------------------------------------------------------

_TAU_SQL = f"""{v.LOGITS_SQL}, tau AS (SELECT backbone, quantile_cont(x, 0.9) AS tau FROM entries WHERE split = 'train' GROUP BY backbone)"""


@query("react_threshold", f"""WITH {_TAU_SQL} SELECT backbone, {R("tau")} AS tau FROM tau""")
def react_threshold(spark, sf):
    return rounded(scorer.react_threshold(_train(spark, sf), KEYS), "tau")


@query(
    "react_energy",
    f"""WITH {_TAU_SQL}, cl AS (SELECT s.backbone, s.sample_id, split, list_transform(feats, lambda x: least(x, tau)) AS f FROM samples s JOIN tau ON s.backbone = tau.backbone),
z AS (SELECT c.backbone, sample_id, split, list_dot_product(f, weight) AS z FROM cl c JOIN heads h ON c.backbone = h.backbone),
zm AS (SELECT *, max(z) OVER (PARTITION BY backbone, sample_id) AS m FROM z)
SELECT backbone, sample_id, split, {R("max(m) + ln(sum(exp(z - m)))")} AS react_energy FROM zm GROUP BY backbone, sample_id, split""",
)
def react_energy(spark, sf):
    """Needs the clip level alone: the other fits are switched off."""
    s = v.samples(spark, sf)
    h = cut_lineage(v.heads(s))
    model = scorer.ShiftScorer(methods=("react_energy",)).fit(s.where("split = 'train'"), h, KEYS)
    return model.wide(s).select("backbone", "sample_id", "split", r6(F.col("react_energy")).alias("react_energy"))


def _fitted(spark, sf, k=50, methods=None):
    """Model and rows; the rows are written once by cell and split, so every fit reads its columns of its split."""
    s = v.samples(spark, sf)
    h = cut_lineage(v.heads(s))
    rows = written_by(scorer.linear_logits(s, h, KEYS), *KEYS, "split")
    model = scorer.ShiftScorer(k_nearest=k, methods=methods).fit(rows.where("split = 'train'"), h, KEYS)
    return model, rows


# --- the whole chain -----------------------------------------------------------------------

CHAIN_SQL = f"""{_PLANE_SQL},
w AS (SELECT backbone, label AS class, {v.HEAD_SCALE}::DOUBLE * avg(a) AS wa, {v.HEAD_SCALE}::DOUBLE * avg(b) AS wb FROM pl WHERE split = 'train' GROUP BY ALL),
tau AS (SELECT backbone, quantile_cont(e, 0.9) AS tau FROM (SELECT backbone, a AS e FROM pl WHERE split = 'train' UNION ALL SELECT backbone, b FROM pl WHERE split = 'train') GROUP BY backbone),
z AS (SELECT pl.backbone, sample_id, split, a, b, a * wa + b * wb AS z, least(a, tau) * wa + least(b, tau) * wb AS zc FROM pl JOIN w ON pl.backbone = w.backbone JOIN tau ON tau.backbone = pl.backbone),
zm AS (SELECT *, max(z) OVER (PARTITION BY backbone, sample_id) AS m, max(zc) OVER (PARTITION BY backbone, sample_id) AS mc FROM z),
gg AS (SELECT backbone, avg(a * a) AS aa, avg(a * b) AS ab, avg(b * b) AS bb FROM pl WHERE split = 'train' GROUP BY backbone),
gl AS (SELECT *, (aa + bb) / 2 - sqrt((aa - bb) * (aa - bb) / 4 + ab * ab) AS lo FROM gg),
ge AS (SELECT backbone, ab / sqrt(ab * ab + (lo - aa) * (lo - aa)) AS va, (lo - aa) / sqrt(ab * ab + (lo - aa) * (lo - aa)) AS vb FROM gl),
lg AS (SELECT backbone, sample_id, any_value(split) AS split, 1.0 / sum(exp(z - m)) AS msp, max(m) + ln(sum(exp(z - m))) AS energy, sqrt(sum(z * z)) AS logit_norm,
   max(mc) + ln(sum(exp(zc - mc))) AS react_energy, max(m) AS top, any_value(a) AS a, any_value(b) AS b FROM zm GROUP BY backbone, sample_id),
rs AS (SELECT lg.*, abs(a * va + b * vb) AS res FROM lg JOIN ge ON ge.backbone = lg.backbone),
al AS (SELECT backbone, avg(top) / (avg(res) + 1e-12::DOUBLE) AS alpha FROM rs WHERE split = 'train' GROUP BY backbone),
tr AS (SELECT backbone, x, y FROM pu WHERE split = 'train'), {_plane_fit_sql("tr", "backbone")},
ma AS (SELECT pu.backbone, sample_id, -{_plane_distance("x - mx", "y - my")} AS mahalanobis FROM pu JOIN k ON k.backbone = pu.backbone),
nu AS (SELECT backbone, sample_id, split, a / sqrt(a * a + b * b) AS x, b / sqrt(a * a + b * b) AS y FROM pl),
nd AS (SELECT q.backbone, q.sample_id, t.sample_id AS t, greatest(0.0::DOUBLE, 1.0::DOUBLE - (q.x * t.x + q.y * t.y)) AS d FROM nu q JOIN nu t ON q.backbone = t.backbone WHERE q.split <> 'train' AND t.split = 'train'),
nr AS (SELECT *, row_number() OVER (PARTITION BY backbone, sample_id ORDER BY d, t) AS rn FROM nd),
kn AS (SELECT backbone, sample_id, -avg(d) AS knn FROM nr WHERE rn <= 50 GROUP BY backbone, sample_id),
wide AS (SELECT rs.backbone, rs.sample_id, rs.split, msp, energy, logit_norm, react_energy, energy - alpha * res AS vim, mahalanobis, knn
   FROM rs JOIN al ON al.backbone = rs.backbone JOIN ma ON ma.backbone = rs.backbone AND ma.sample_id = rs.sample_id JOIN kn ON kn.backbone = rs.backbone AND kn.sample_id = rs.sample_id),
long AS (SELECT domain, backbone, is_id, method, round(score, 9) AS score FROM (SELECT d.domain, wide.*, split = 'id_val' AS is_id FROM wide JOIN (VALUES ('near'), ('far')) d(domain) ON split = 'id_val' OR split = d.domain)
   UNPIVOT (score FOR method IN (msp, energy, logit_norm, react_energy, vim, mahalanobis, knn)))"""


@query(
    "vim_plane",
    f"""WITH {CHAIN_SQL} SELECT rs.backbone, sample_id, split, {R("energy - alpha * res")} AS vim FROM rs JOIN al ON al.backbone = rs.backbone""",
)
def vim_plane(spark, sf):
    """Residual-space score where the residual direction has a closed form."""
    model, rows = plane_model(spark, sf, ("vim",))
    return model.wide(rows).select("backbone", "sample_id", "split", r6(F.col("vim")).alias("vim"))


@query(
    "w_from_vectors",
    f"""WITH {CHAIN_SQL}, {v.auroc_sql("long", "domain, backbone, method")}, {v.ranks_sql("au", "domain, backbone")}, {v.w_sql("rk", "domain")},
loo AS (SELECT r.*, h.held_out FROM rk r JOIN (SELECT DISTINCT domain, backbone AS held_out FROM au) h ON r.domain = h.domain AND r.backbone <> h.held_out), {v.w_sql("loo", "domain, held_out", name="lw")}
SELECT domain, '(none)' AS held_out, n_raters, {R("kendall_w")} AS kendall_w, {R("0.0")} AS delta_vs_full FROM kw
UNION ALL SELECT l.domain, held_out, l.n_raters, {R("l.kendall_w")}, {R("l.kendall_w - k.kendall_w")} FROM lw l JOIN kw k ON l.domain = k.domain""",
)
def w_from_vectors(spark, sf):
    """Vectors to seven scores to AUROC to Kendall's W over 32 raters, and W without each rater."""
    model, rows = plane_model(spark, sf)
    long = cut_lineage(model.transform(rows.where("split <> 'train'")).withColumn("score", F.round("score", 9)))
    cell = cut_lineage(separability.auroc(v.by_domain(long), ["domain", "backbone", "method"]))
    full = ranks.kendall_w(cell, ["domain"], ["backbone"], "method", "auroc")
    full = full.select("domain", F.lit("(none)").alias("held_out"), "n_raters", "kendall_w", F.lit(0.0).alias("delta_vs_full"))
    return rounded(full.unionByName(ranks.jackknife_w(cell, ["domain"], "backbone", "method", "auroc")), "kendall_w", "delta_vs_full")


# --- neighbours ---------------------------------------------------------------------------

_NN_SQL = f"""{v.SAMPLES_SQL}, nu AS (SELECT backbone, sample_id, split, list_transform(feats, lambda x: x / sqrt(list_dot_product(feats, feats))) AS u FROM samples),
d AS (SELECT q.backbone, q.sample_id, t.sample_id AS neighbour, 1.0::DOUBLE - list_dot_product(q.u, t.u) AS distance FROM nu q JOIN nu t ON q.backbone = t.backbone WHERE q.split <> 'train' AND t.split = 'train'),
r AS (SELECT *, row_number() OVER (PARTITION BY backbone, sample_id ORDER BY distance, neighbour) AS rn FROM d)"""


@query(
    "knn_join",
    f"""WITH {_NN_SQL} SELECT backbone, sample_id, CAST(rn AS INTEGER) AS rn, neighbour, {R("distance")} AS distance FROM r WHERE rn <= 5""",
)
def knn_neighbours(spark, sf):
    """Exact nearest training rows; the SQL twin is the full cross product."""
    s = v.samples(spark, sf)
    near = knn_join(s.where("split = 'train'"), s.where("split <> 'train'"), KEYS, 5)
    flat = near.select("backbone", "sample_id", F.posexplode("neighbours").alias("p", "n"))
    return flat.select(
        "backbone", "sample_id", (F.col("p") + 1).alias("rn"), F.col("n.id").alias("neighbour"), r6(F.col("n.distance")).alias("distance")
    )


@query(
    "knn_score",
    f"""WITH {_NN_SQL} SELECT backbone, sample_id, {R("-avg(distance)")} AS knn FROM r WHERE rn <= 50 GROUP BY backbone, sample_id""",
)
def knn_score(spark, sf):
    s = v.samples(spark, sf)
    near = knn_distance(s.where("split = 'train'"), s.where("split <> 'train'"), KEYS, 50)
    return near.select("backbone", "sample_id", r6(-F.col("mean_distance")).alias("knn"))


@query("all_method_separability")
def all_method_separability(spark, sf):
    """All seven scores, AUROC and FPR95 per (domain, backbone, method)."""
    model, rows = _fitted(spark, sf)
    long = cut_lineage(model.transform(rows.where("split <> 'train'")))
    out = separability.separability(v.by_domain(long), ["domain", "backbone", "method"])
    return rounded(out, "auroc", "fpr95", "threshold")


@query("per_sample_report")
def per_sample_report(spark, sf):
    """Per-sample table of the older pipeline: label, prediction and every score."""
    model, rows = _fitted(spark, sf)
    scored = rows.where("split <> 'train'").withColumn("prediction", S.predicted_class(F.col("logits")))
    out = model.wide(scored)
    return rounded(out, *scorer.METHODS)


@query(
    "fill_missing_scores",
    f"""WITH {CHAIN_SQL}, {v.auroc_sql("long", "domain, backbone, method")}
SELECT domain, backbone, method, {R("auroc")} AS auroc, CASE WHEN method = 'vim' OR (method = 'mahalanobis' AND backbone = 'p02') THEN 'computed' ELSE 'table' END AS source
FROM au WHERE method <> 'knn'""",
)
def fill_missing_scores(spark, sf):
    """Table values win; holes are filled from freshly computed scores."""
    model, rows = plane_model(spark, sf, tuple(m for m in scorer.METHODS if m != "knn"))
    long = model.transform(rows.where("split <> 'train'")).withColumn("score", F.round("score", 9))
    keys = ["domain", "backbone", "method"]
    computed = cut_lineage(separability.auroc(v.by_domain(long), keys))
    table = computed.where("not (method = 'vim' or (method = 'mahalanobis' and backbone = 'p02'))")
    return rounded(tables.fill_missing(table, computed, keys, "auroc"), "auroc")


# --- refits and probes ---------------------------------------------------------------------


@query("fit_size_ablation")
def fit_size_ablation(spark, sf):
    """Nested training subsets, one covariance fit per size."""
    out = sweeps.fit_size_ablation(_train(spark, sf), v.by_domain(v.samples(spark, sf)), KEYS, by=("domain",))
    return rounded(out.select("domain", "backbone", "n_train", "n_fit", "auroc", "fpr95", "shrinkage"), "auroc", "fpr95", "shrinkage")


@query("subsample_refits")
def subsample_refits(spark, sf):
    """Repeated subsample fits: mean and sd of AUROC, conditioning and shrinkage."""
    out = sweeps.subsample_refits(_train(spark, sf), v.by_domain(v.samples(spark, sf)), KEYS, n_sub=150, by=("domain",))
    return rounded(out, *[c for c in out.columns if c not in ("domain", "backbone", "n_full", "subsampled", "n_sub", "n_draws")])


@query("linear_probe")
def linear_probe(spark, sf):
    """L2 logistic probes on the frozen features of every backbone, as heads: accuracy per split."""
    rows = v.samples(spark, sf)
    heads = cut_lineage(learners.fit_probe(rows.where("split = 'train'"), KEYS))
    scored = scorer.linear_logits(rows, heads, KEYS).withColumn("ok", S.correct(F.col("logits"), F.col("label")))
    return rounded(scored.groupBy("backbone", "split").agg(F.avg("ok").alias("accuracy"), F.count(F.lit(1)).alias("n")), "accuracy")


@query("domain_classifier")
def domain_classifier(spark, sf):
    """Cross-validated AUROC of telling each shift from ID, for every backbone."""
    keys = ["domain", "backbone"]
    rows = v.by_domain(v.samples(spark, sf)).select(*keys, "sample_id", "is_id", "feats")
    return rounded(learners.classifier_summary(learners.domain_classifier(rows, keys), keys), "mean_auroc", "std_auroc")


@query("temperature_jump")
def temperature_jump(spark, sf):
    """Fitted temperatures against the MSP jump, raw and at T*, per domain (iterative fit)."""
    rows = cut_lineage(v.with_logits(spark, sf).drop("feats"))
    t = calibration.fit_temperature(rows.where("split = 'id_val'"), KEYS)
    z = F.col("logits")
    ev = v.by_domain(rows.join(t, KEYS)).withColumns({"msp": S.msp(z), "msp_tstar": S.msp(z, F.col("t_star"))})
    long = ev.unpivot(["domain", "backbone", "is_id"], ["msp", "msp_tstar"], "method", "score")
    a = cut_lineage(separability.auroc(long, ["domain", "backbone", "method"]))
    jumps = tables.baseline_jump(a, ["domain", "method"], "backbone", ["b16", "b32"], "auroc")
    r = correlation.pearson(jumps.join(t, KEYS), ["domain", "method"], "t_star", "jump")
    return correlation.with_p_value(decisions.correlation_verdict(r, "r"), "r")


@query(
    "fill_missing_table",
    f"""WITH {CELLS_SQL} SELECT domain, backbone, method, {R("auroc")} AS auroc, CASE WHEN method = 'knn' OR (method = 'mahalanobis' AND backbone = 'm2') THEN 'computed' ELSE 'table' END AS source FROM cells""",
)
def fill_missing_table(spark, sf):
    c = cells(spark, sf)
    table = c.where("not (method = 'knn' or (method = 'mahalanobis' and backbone = 'm2'))")
    return rounded(tables.fill_missing(table, c, ["domain", "backbone", "method"], "auroc"), "auroc")
