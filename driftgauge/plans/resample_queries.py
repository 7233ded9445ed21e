"""Bootstrap intervals and permutation nulls."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftgauge.functions.draws import MODULUS, keyed_hash_sql, poisson_weight_sql, wide_hash_sql
from driftgauge.functions.scores import correct, msp
from driftgauge.operators import bootstrap, dispersion, ranks, resample, separability, silhouette, sweeps
from driftgauge.operators.silhouette import SHUFFLE_ROUNDS
from driftgauge.plans import views as v
from driftgauge.plans.rank_queries import CELLS_SQL, cells
from driftgauge.plans.registry import ORACLES, query
from driftgauge.plans.score_queries import _sides, dispersion_table
from driftgauge.plans.views import R, rounded
from driftgauge.session import cut_lineage

SEED = 42
# The published numbers of replicates and permutations.
REPS = resample.N_BOOTSTRAP
PERMS = resample.N_PERMUTATIONS


def _poisson_sql(src: str, name: str, reps: int = REPS, sid: str = "sample_id") -> str:
    """CTE ``name``: rows of src with rep and a positive Poisson weight."""
    return f"""
{name}_h AS (SELECT s.*, r.rep, {keyed_hash_sql(SEED, "r.rep", f"s.{sid}")} AS h FROM {src} s CROSS JOIN (SELECT unnest(range(1, {reps + 1})) AS rep) r),
{name}_w AS (SELECT *, {poisson_weight_sql("h")} AS weight FROM {name}_h), {name} AS (SELECT * FROM {name}_w WHERE weight > 0)"""


def _ci(stat: str, col: str | None = None) -> str:
    c = col or stat
    return f"{R(f'quantile_cont({c}, 0.025)')} AS {stat}_ci_low, {R(f'quantile_cont({c}, 0.975)')} AS {stat}_ci_high"


def _vector_scores(spark, sf):
    """All logit scores of the evaluation rows, written once before they are replicated."""
    return cut_lineage(
        v.logit_scores(v.by_domain(v.with_logits(spark, sf))).select("domain", "backbone", "sample_id", "is_id", "method", "score")
    )


_K = "domain, backbone, method"
_COPIES = "JOIN (SELECT unnest(range(1, 13)) AS copy) c ON c.copy <= w.weight"
_BOOT_SQL = f"""{{w}}, {v.auroc_sql("w", _K + ", rep", w="weight")},
cp AS (SELECT w.* FROM w {_COPIES}),
thr AS (SELECT {_K}, rep, quantile_cont(score, 0.05) AS t FROM cp WHERE is_id GROUP BY {_K}, rep),
fpr AS (SELECT cp.domain, cp.backbone, cp.method, cp.rep, avg(CASE WHEN score > t THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS fpr95
        FROM cp JOIN thr ON cp.domain = thr.domain AND cp.backbone = thr.backbone AND cp.method = thr.method AND cp.rep = thr.rep WHERE NOT is_id GROUP BY ALL),
ci AS (SELECT {_K}, {_ci("auroc")}, {_ci("fpr95")} FROM au JOIN fpr USING ({_K}, rep) GROUP BY {_K})"""


@query(
    "bootstrap_separability",
    f"""WITH {v.SCORES_SQL}, {_BOOT_SQL.format(w=_poisson_sql("scored", "w"))} SELECT * FROM ci""",
)
def bootstrap_separability(spark, sf):
    """AUROC and FPR95 limits from Poisson replicate weights."""
    keys = ["domain", "backbone", "method"]
    reps = bootstrap.bootstrap_separability(_vector_scores(spark, sf), keys, "sample_id", REPS, SEED)
    out = resample.percentile_ci(reps, keys, ["auroc", "fpr95"])
    return rounded(out, "auroc_ci_low", "auroc_ci_high", "fpr95_ci_low", "fpr95_ci_high")


_DRAWS_SQL = f"""
pool AS (SELECT domain, backbone, is_id, sample_id, row_number() OVER (PARTITION BY domain, backbone, is_id ORDER BY sample_id) - 1 AS pos,
           count(*) OVER (PARTITION BY domain, backbone, is_id) AS size FROM (SELECT DISTINCT domain, backbone, is_id, sample_id FROM scored)),
drawn AS (SELECT domain, backbone, is_id, rep, {wide_hash_sql(SEED, "rep", "pos")} % size AS pos, count(*) AS weight
          FROM pool CROSS JOIN (SELECT unnest(range(1, {REPS + 1})) AS rep) GROUP BY ALL),
w AS (SELECT s.domain, s.backbone, s.method, s.is_id, s.score, d.rep, d.weight FROM drawn d
      JOIN pool p ON p.domain = d.domain AND p.backbone = d.backbone AND p.is_id = d.is_id AND p.pos = d.pos
      JOIN scored s ON s.domain = p.domain AND s.backbone = p.backbone AND s.is_id = p.is_id AND s.sample_id = p.sample_id)"""


@query(
    "bootstrap_separability_exact_n",
    f"""WITH {v.SCORES_SQL}, {_BOOT_SQL.format(w=_DRAWS_SQL)} SELECT * FROM ci""",
)
def bootstrap_separability_exact_n(spark, sf):
    """Resamples of exactly n ID and n OOD rows, drawn independently."""
    rows = _vector_scores(spark, sf)
    keys, pool = ["domain", "backbone", "method"], ["domain", "backbone", "is_id"]
    reps = bootstrap.bootstrap_separability_exact_n(rows, keys, pool, "sample_id", REPS, SEED)
    if reps is not None:
        out = resample.percentile_ci(reps, keys, ["auroc", "fpr95"])
    else:  # larger cells: draws and scores as rows
        out = resample.separability_ci(resample.multinomial_replicates(rows, pool, "sample_id", REPS, SEED), keys)
    return rounded(out, "auroc_ci_low", "auroc_ci_high", "fpr95_ci_low", "fpr95_ci_high")


@query(
    "score_comparison",
    f"""WITH {v.SCORES_SQL}, {v.sep_sql("scored", _K)}, {_BOOT_SQL.format(w=_poisson_sql("scored", "w"))},
lim AS (SELECT * FROM ci WHERE method IN ('msp', 'energy', 'mahalanobis', 'knn'))
SELECT domain, backbone, method, {R("auroc")} AS auroc, {R("fpr95")} AS fpr95, {R("threshold")} AS threshold, n_id, n_ood, auroc_ci_low, auroc_ci_high, fpr95_ci_low, fpr95_ci_high
FROM sep LEFT JOIN lim USING ({_K})""",
)
def score_comparison(spark, sf):
    """Point estimates with limits; methods outside the bootstrap set keep NULL limits."""
    keys = ["domain", "backbone"]
    rows = _vector_scores(spark, sf)
    points = separability.separability(rows, [*keys, "method"])
    some = rows.where(F.col("method").isin(*separability.BOOTSTRAPPED_METHODS))
    reps = bootstrap.bootstrap_separability(some, [*keys, "method"], "sample_id", REPS, SEED)
    ci = resample.percentile_ci(reps, [*keys, "method"], ["auroc", "fpr95"])
    out = separability.score_comparison(points, ci, keys)
    return rounded(out, "auroc", "fpr95", "threshold", "auroc_ci_low", "auroc_ci_high", "fpr95_ci_low", "fpr95_ci_high")


@query(
    "bootstrap_delta_auroc",
    f"""WITH {v.SCORES_SQL}, {_poisson_sql("scored", "w")}, {v.auroc_sql("w", _K + ", rep", w="weight")},
d AS (SELECT domain, backbone, rep, max(CASE WHEN method = 'energy' THEN auroc END) - max(CASE WHEN method = 'msp' THEN auroc END) AS d FROM au GROUP BY ALL)
SELECT domain, backbone, {_ci("delta_auroc", "d")} FROM d GROUP BY ALL""",
)
def bootstrap_delta_auroc(spark, sf):
    """Difference of two scores' AUROCs on the same draws."""
    keys = ["domain", "backbone"]
    reps = bootstrap.bootstrap_separability(_vector_scores(spark, sf), [*keys, "method"], "sample_id", REPS, SEED)
    out = resample.delta_auroc_ci(reps, keys, "energy", "msp")
    return rounded(out, "delta_auroc_ci_low", "delta_auroc_ci_high")


_TRIM_W = """n < 3 OR floor(0.01::DOUBLE * n) <= 0 OR 2 * floor(0.01::DOUBLE * n) >= n OR (rn > floor(0.01::DOUBLE * n) AND rn <= n - floor(0.01::DOUBLE * n))"""


@query(
    "bootstrap_dispersion_gap",
    f"""WITH {v.LOGITS_SQL}, side AS (SELECT domain, backbone, sample_id, is_id, logit_norm, logit_gap FROM dom), {_poisson_sql("side", "w")},
cp AS (SELECT w.* FROM w {_COPIES}), l AS (SELECT domain, backbone, rep, is_id, measure, x FROM cp UNPIVOT (x FOR measure IN (logit_norm, logit_gap))),
r AS (SELECT *, row_number() OVER (PARTITION BY domain, backbone, rep, is_id, measure ORDER BY x) AS rn, count(*) OVER (PARTITION BY domain, backbone, rep, is_id, measure) AS n FROM l),
t AS (SELECT domain, backbone, rep, is_id, measure, CASE WHEN measure = 'logit_norm' THEN stddev_pop(x) / (abs(avg(x)) + 1e-8::DOUBLE) ELSE avg(x) END AS stat FROM r WHERE {_TRIM_W} GROUP BY domain, backbone, rep, is_id, measure),
g AS (SELECT domain, backbone, rep, sum(CASE WHEN measure = 'logit_norm' THEN CASE WHEN is_id THEN -stat ELSE stat END END) AS c,
        sum(CASE WHEN measure = 'logit_gap' THEN CASE WHEN is_id THEN -stat ELSE stat END END) AS g FROM t GROUP BY ALL)
SELECT domain, backbone, {_ci("cvid_gap", "c")}, {_ci("logit_gap_gap", "g")} FROM g GROUP BY ALL""",
)
def bootstrap_dispersion_gap(spark, sf):
    reps = bootstrap.bootstrap_dispersion_gap(cut_lineage(_sides(spark, sf)), ["domain", "backbone"], "sample_id", REPS, SEED)
    out = resample.percentile_ci(reps, ["domain", "backbone"], ["cvid_gap", "logit_gap_gap"])
    return rounded(out, "cvid_gap_ci_low", "cvid_gap_ci_high", "logit_gap_gap_ci_low", "logit_gap_gap_ci_high")


_COV_BOOT_SQL = f"""{v.LOGITS_SQL}, s AS (SELECT backbone, sample_id, msp AS score, pred = label AS correct FROM zstat WHERE split <> 'train'),
{_poisson_sql("s", "w")}, cp AS (SELECT w.*, w.sample_id * 100 + c.copy AS pick FROM w {_COPIES}),
cu AS (SELECT backbone, rep, row_number() OVER o AS k, sum(CASE WHEN correct THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) OVER o / row_number() OVER o AS risk,
         count(*) OVER (PARTITION BY backbone, rep) AS n FROM cp WINDOW o AS (PARTITION BY backbone, rep ORDER BY score DESC, pick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
cov AS (SELECT backbone, rep, coalesce(max(CASE WHEN risk <= 0.5::DOUBLE + 1e-12::DOUBLE THEN k END), 0) / CAST(max(n) AS DOUBLE) AS coverage FROM cu GROUP BY ALL)"""


def _coverage_reps(spark, sf):
    z = F.col("logits")
    rows = v.with_logits(spark, sf).where("split <> 'train'").select(
        "backbone", "sample_id", msp(z).alias("score"), correct(z, F.col("label")).alias("correct")
    )
    return cut_lineage(bootstrap.bootstrap_coverage(cut_lineage(rows), ["backbone"], "sample_id", 0.5, REPS, SEED))


@query("bootstrap_coverage", f"""WITH {_COV_BOOT_SQL} SELECT backbone, {_ci("coverage")} FROM cov GROUP BY backbone""")
def bootstrap_coverage(spark, sf):
    """Limits of coverage at a risk target; weighted rows count as that many prefixes."""
    out = resample.percentile_ci(_coverage_reps(spark, sf), ["backbone"], ["coverage"])
    return rounded(out, "coverage_ci_low", "coverage_ci_high")


@query(
    "bootstrap_coverage_paired",
    f"""WITH {_COV_BOOT_SQL}, p AS (SELECT rep, max(CASE WHEN backbone = 'b64' THEN coverage END) AS a, max(CASE WHEN backbone = 'b16' THEN coverage END) AS b FROM cov GROUP BY rep)
SELECT 'b64-b16' AS pair, {_ci("a")}, {_ci("b")}, {_ci("difference", "a - b")} FROM p""",
)
def bootstrap_coverage_paired(spark, sf):
    """Two models on the same resampled rows, and their difference."""
    reps = _coverage_reps(spark, sf).withColumn("pair", F.lit("b64-b16"))
    out = resample.paired_difference_ci(reps, ["pair"], "backbone", "b64", "b16")
    return rounded(out, *[f"{s}_ci_{e}" for s in ("a", "b", "difference") for e in ("low", "high")])


@query(
    "bootstrap_spread",
    f"""WITH {CELLS_SQL}, s AS (SELECT domain, method, CAST(substr(backbone, 2) AS BIGINT) AS sample_id, auroc FROM cells), {_poisson_sql("s", "w")}, cp AS (SELECT w.* FROM w {_COPIES}),
r AS (SELECT domain, method, rep, coalesce(stddev_samp(auroc), 0) AS spread FROM cp GROUP BY ALL)
SELECT domain, method, {_ci("spread")} FROM r GROUP BY ALL""",
)
def bootstrap_spread(spark, sf):
    """Spread over backbones with the backbones resampled."""
    c = cells(spark, sf).withColumn("sample_id", F.substring("backbone", 2, 9).cast("bigint"))
    reps = resample.spread_reps(resample.poisson_replicates(c, "sample_id", REPS, SEED), ["domain", "method"])
    return rounded(resample.percentile_ci(reps, ["domain", "method"], ["spread"]), "spread_ci_low", "spread_ci_high")


@query(
    "bootstrap_spearman",
    f"""WITH {v.EVENTS_SQL}, s AS (SELECT stratum, sample_id, user_id, score FROM scored), {_poisson_sql("s", "w")}, cp AS (SELECT w.* FROM w {_COPIES}),
k AS (SELECT stratum, rep, rank() OVER (PARTITION BY stratum, rep ORDER BY user_id) + (count(*) OVER (PARTITION BY stratum, rep, user_id) - 1) / 2.0::DOUBLE AS a,
        rank() OVER (PARTITION BY stratum, rep ORDER BY score) + (count(*) OVER (PARTITION BY stratum, rep, score) - 1) / 2.0::DOUBLE AS b FROM cp),
c AS (SELECT stratum, rep, corr(a, b) AS rho FROM k GROUP BY ALL)
SELECT stratum, {_ci("rho")} FROM c GROUP BY stratum""",
)
def bootstrap_spearman(spark, sf):
    # kept, as the interval reads them twice
    reps = cut_lineage(bootstrap.bootstrap_spearman(v.event_scores(spark, sf), ["stratum"], "sample_id", "user_id", "score", REPS, SEED))
    return rounded(resample.percentile_ci(reps, ["stratum"], ["rho"]), "rho_ci_low", "rho_ci_high")


_PARAM_SQL = f"""{CELLS_SQL}, pc AS (SELECT domain, method, backbone, auroc, CASE WHEN method = 'logit_norm' THEN 0.0::DOUBLE ELSE 0.04::DOUBLE / (2.0::DOUBLE * {resample.Z95}::DOUBLE) END AS se,
   (CASE domain WHEN 'F' THEN 0 ELSE 1 END) * 1000 + (CASE method WHEN 'msp' THEN 0 WHEN 'energy' THEN 1 WHEN 'logit_norm' THEN 2 WHEN 'mahalanobis' THEN 3 ELSE 4 END) * 100 + CAST(substr(backbone, 2) AS BIGINT) AS cell_id FROM cells),
pr AS (SELECT *, {keyed_hash_sql(SEED, "rep", "cell_id")} AS h1, {keyed_hash_sql(SEED + 1, "rep", "cell_id")} AS h2 FROM pc CROSS JOIN (SELECT unnest(range(1, {REPS + 1})) AS rep)),
dr AS (SELECT *, CASE WHEN se > 0 THEN auroc + se * sqrt(-2.0::DOUBLE * ln((h1 + 1) / {float(MODULUS + 1)}::DOUBLE)) * cos(2.0::DOUBLE * pi() * (h2 / {float(MODULUS)}::DOUBLE)) ELSE auroc END AS draw FROM pr),
sp AS (SELECT domain, method, rep, stddev_samp(draw) AS spread FROM dr GROUP BY ALL), ms AS (SELECT method, rep, avg(spread) AS mean_spread FROM sp GROUP BY ALL)"""


def _parametric(spark, sf):
    d = F.when(F.col("domain") == "F", 0).otherwise(1)
    order = F.create_map(*[F.lit(x) for i, m in enumerate(v.ZOO_METHODS) for x in (m, i)])
    cell_id = d * 1000 + order[F.col("method")] * 100 + F.substring("backbone", 2, 9).cast("bigint")
    half = F.when(F.col("method") != "logit_norm", F.lit(0.02))
    c = cells(spark, sf).withColumns(
        {"cell_id": cell_id.cast("bigint"), "ci_low": F.lit(0.0) - half, "ci_high": F.lit(0.0) + half}
    )
    return resample.parametric_spread_reps(c, REPS, SEED)


@query("parametric_spread", f"""WITH {_PARAM_SQL} SELECT method, {_ci("mean_spread")} FROM ms GROUP BY method""")
def parametric_spread(spark, sf):
    """Gaussian draws around interval-backed AUROCs; cells without an interval stay fixed."""
    return rounded(resample.percentile_ci(_parametric(spark, sf), ["method"], ["mean_spread"]), "mean_spread_ci_low", "mean_spread_ci_high")


@query(
    "spread_win_rate",
    f"""WITH {_PARAM_SQL}, c AS (SELECT rep, mean_spread AS c FROM ms WHERE method = 'mahalanobis')
SELECT method, {R("avg(CASE WHEN c < mean_spread THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")} AS p_champion_lower FROM ms JOIN c USING (rep) WHERE method <> 'mahalanobis' GROUP BY method""",
)
def spread_win_rate(spark, sf):
    return rounded(resample.spread_win_rate(_parametric(spark, sf), "mahalanobis"), "p_champion_lower")


# --- permutation nulls of W -------------------------------------------------------------

_ITEM_NO = "CASE method " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(v.ZOO_METHODS)) + " END"
_NUMBERED_SQL = f"""{CELLS_SQL}, nc AS (SELECT domain, backbone, method, auroc, CAST(substr(backbone, 2) AS BIGINT) AS rater_no, {_ITEM_NO} AS item_no FROM cells),
{v.ranks_sql("nc", "domain, backbone")}, {v.w_sql("rk", "domain", name="obs")}, reps AS (SELECT unnest(range(1, {PERMS + 1})) AS rep)"""
_PERM_H = keyed_hash_sql(SEED, "rep", "rater_no", "item_no")
_P_SQL = f"""SELECT n.domain, {R("max(o.kendall_w)")} AS kendall_w_observed, {R("(count(*) FILTER (n.kendall_w >= o.kendall_w - 1e-12::DOUBLE) + 1) / (count(*) + 1)")} AS p_greater,
{R("(count(*) FILTER (n.kendall_w <= o.kendall_w + 1e-12::DOUBLE) + 1) / (count(*) + 1)")} AS p_less FROM nul n JOIN obs o ON n.domain = o.domain GROUP BY n.domain"""


def _numbered(spark, sf):
    order = F.create_map(*[F.lit(x) for i, m in enumerate(v.ZOO_METHODS) for x in (m, i)])
    return cells(spark, sf).withColumns(
        {"rater_no": F.substring("backbone", 2, 9).cast("bigint"), "item_no": order[F.col("method")]}
    )


@query(
    "w_permutation_free",
    f"""WITH {_NUMBERED_SQL}, pm AS (SELECT domain, rep, backbone, method, CAST(row_number() OVER (PARTITION BY domain, rep, backbone ORDER BY {_PERM_H}, item_no) AS DOUBLE) AS rank, 1 AS tied
  FROM nc CROSS JOIN reps), {v.w_sql("pm", "domain, rep", name="nul")} {_P_SQL}""",
)
def w_permutation_free(spark, sf):
    """Every backbone ranks the methods at random."""
    out = resample.w_permutation_test(_numbered(spark, sf), ["domain"], "backbone", "method", "auroc", PERMS, seed=SEED)
    return rounded(out, "kendall_w_observed", "p_greater", "p_less")


@query(
    "w_permutation_locked",
    f"""WITH {_NUMBERED_SQL}, free AS (SELECT * FROM rk CROSS JOIN reps WHERE method NOT IN ('mahalanobis', 'knn')),
slot AS (SELECT domain, rep, backbone, method, row_number() OVER (PARTITION BY domain, rep, backbone ORDER BY item_no) AS p FROM free),
hand AS (SELECT domain, rep, backbone, rank, tied, row_number() OVER (PARTITION BY domain, rep, backbone ORDER BY {_PERM_H}, item_no) AS p FROM free),
pm AS (SELECT s.domain, s.rep, s.backbone, s.method, h.rank, h.tied FROM slot s JOIN hand h ON s.domain = h.domain AND s.rep = h.rep AND s.backbone = h.backbone AND s.p = h.p
  UNION ALL SELECT domain, rep, backbone, method, rank, tied FROM rk CROSS JOIN reps WHERE method IN ('mahalanobis', 'knn')), {v.w_sql("pm", "domain, rep", name="nul")} {_P_SQL}""",
)
def w_permutation_locked(spark, sf):
    """Feature methods keep their ranks; the other methods' ranks are dealt among themselves."""
    out = resample.w_permutation_test(
        _numbered(spark, sf), ["domain"], "backbone", "method", "auroc", PERMS, locked=ranks.FEATURE_METHODS, seed=SEED
    )
    return rounded(out, "kendall_w_observed", "p_greater", "p_less")


# --- silhouette -------------------------------------------------------------------------


def _eval_vectors(spark, sf):
    return v.by_domain(v.samples(spark, sf))


_EV_SQL = f"""{v.SAMPLES_SQL}, ev AS (SELECT d.domain, s.backbone, s.sample_id, s.split = 'id_val' AS is_id, list_transform(feats, lambda x: x / sqrt(list_dot_product(feats, feats))) AS u
  FROM samples s JOIN (VALUES ('near'), ('far')) d(domain) ON s.split = 'id_val' OR s.split = d.domain)"""
_PAIR_SQL = f"""{_EV_SQL},
pr AS (SELECT a.domain, a.backbone, a.sample_id AS a, b.sample_id AS b, 1.0::DOUBLE - list_dot_product(a.u, b.u) AS dist FROM ev a JOIN ev b ON a.domain = b.domain AND a.backbone = b.backbone AND a.sample_id <> b.sample_id)"""


@query(
    "cosine_silhouette",
    f"""WITH {_PAIR_SQL}, m AS (SELECT p.domain, p.backbone, p.a, avg(dist) FILTER (x.is_id = y.is_id) AS own, avg(dist) FILTER (x.is_id <> y.is_id) AS other FROM pr p
  JOIN ev x ON x.domain = p.domain AND x.backbone = p.backbone AND x.sample_id = p.a JOIN ev y ON y.domain = p.domain AND y.backbone = p.backbone AND y.sample_id = p.b GROUP BY p.domain, p.backbone, p.a)
SELECT domain, backbone, {R("avg((other - own) / greatest(other, own))")} AS feature_silhouette_cosine FROM m GROUP BY ALL""",
)
def cosine_silhouette(spark, sf):
    """Linear closed form; the SQL twin walks all pairs."""
    return rounded(silhouette.silhouette(_eval_vectors(spark, sf), ["domain", "backbone"]), "feature_silhouette_cosine")


_S_PERMS = resample.N_BOOTSTRAP


def _round_sql(r: int) -> str:
    k = f"({wide_hash_sql(SEED, 'rep', str(r))} % n)"
    mirror = f"(({k} + n - x) % n)"
    bit = f"(({keyed_hash_sql(SEED + 1, 'rep', str(r), 'top')} // 1024) % 2)"
    before = f"sw{r - 1}" if r else "sw_start"
    return f"""
sw{r}a AS (SELECT domain, backbone, sample_id, rep, n, n_id, x, {mirror} AS mir FROM {before}),
sw{r}b AS (SELECT *, greatest(x, mir) AS top FROM sw{r}a),
sw{r} AS (SELECT domain, backbone, sample_id, rep, n, n_id, CASE WHEN {bit} = 1 THEN mir ELSE x END AS x FROM sw{r}b)"""


@query(
    "silhouette_permutation",
    f"""WITH {_EV_SQL}, sw_1 AS (SELECT domain, backbone, sample_id, is_id, row_number() OVER (PARTITION BY domain, backbone ORDER BY sample_id) - 1 AS x, count(*) OVER (PARTITION BY domain, backbone) AS n,
   count(*) FILTER (is_id) OVER (PARTITION BY domain, backbone) AS n_id FROM ev),
sw_start AS (SELECT domain, backbone, sample_id, rep, n, n_id, x FROM sw_1 CROSS JOIN (SELECT unnest(range(1, {_S_PERMS + 1})) AS rep)),
{", ".join(_round_sql(r) for r in range(SHUFFLE_ROUNDS))},
lab AS (SELECT domain, backbone, sample_id, rep, x < n_id AS is_id FROM sw{SHUFFLE_ROUNDS - 1} UNION ALL SELECT domain, backbone, sample_id, 0 AS rep, is_id FROM ev),
lu AS (SELECT l.domain, l.backbone, l.rep, l.is_id, e.u FROM lab l JOIN ev e ON e.domain = l.domain AND e.backbone = l.backbone AND e.sample_id = l.sample_id),
dims AS (SELECT domain, backbone, rep, is_id, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM lu),
cs AS (SELECT domain, backbone, rep, list(si ORDER BY i) AS s_id, list(so ORDER BY i) AS s_ood
  FROM (SELECT domain, backbone, rep, i, sum(CASE WHEN is_id THEN x ELSE 0.0::DOUBLE END) AS si, sum(CASE WHEN is_id THEN 0.0::DOUBLE ELSE x END) AS so FROM dims GROUP BY ALL) GROUP BY domain, backbone, rep),
cn AS (SELECT domain, backbone, count(*) FILTER (is_id) AS n_id, count(*) FILTER (NOT is_id) AS n_ood FROM ev GROUP BY ALL),
m AS (SELECT lu.domain, lu.backbone, lu.rep,
   CASE WHEN is_id THEN (n_id - list_dot_product(u, s_id)) / (n_id - 1) ELSE (n_ood - list_dot_product(u, s_ood)) / (n_ood - 1) END AS own,
   CASE WHEN is_id THEN 1 - list_dot_product(u, s_ood) / n_ood ELSE 1 - list_dot_product(u, s_id) / n_id END AS other
  FROM lu JOIN cs ON cs.domain = lu.domain AND cs.backbone = lu.backbone AND cs.rep = lu.rep JOIN cn ON cn.domain = lu.domain AND cn.backbone = lu.backbone),
s AS (SELECT domain, backbone, rep, avg((other - own) / greatest(other, own)) AS s FROM m GROUP BY ALL), o AS (SELECT * FROM s WHERE rep = 0)
SELECT s.domain, s.backbone, {R("max(o.s)")} AS feature_silhouette_cosine, {R("(count(*) FILTER (s.s >= o.s) + 1) / (count(*) + 1)")} AS silhouette_perm_p_value,
  {R("avg(s.s)")} AS silhouette_perm_null_mean, {R("stddev_pop(s.s)")} AS silhouette_perm_null_std FROM s JOIN o ON s.domain = o.domain AND s.backbone = o.backbone WHERE s.rep > 0 GROUP BY s.domain, s.backbone""",
)
def silhouette_permutation(spark, sf):
    """Label-permutation null of the silhouette; the twin of ``cosine_silhouette`` walks all pairs, this one sums classes."""
    out = silhouette.silhouette_test(_eval_vectors(spark, sf), ["domain", "backbone"], _S_PERMS, seed=SEED)
    return rounded(out, "feature_silhouette_cosine", "silhouette_perm_p_value", "silhouette_perm_null_mean", "silhouette_perm_null_std")


_GAP_LIMITS = ["cvid_gap_ci_low", "cvid_gap_ci_high", "logit_gap_gap_ci_low", "logit_gap_gap_ci_high"]


@query(
    "dispersion_vs_separability",
    f"""SELECT d.*, s.* EXCLUDE (domain, backbone), {", ".join(f"CASE WHEN side = 'OOD' THEN g.{c} END AS {c}" for c in _GAP_LIMITS)}
FROM ({ORACLES["dispersion_table"]}) d JOIN ({ORACLES["silhouette_permutation"]}) s USING (domain, backbone) JOIN ({ORACLES["bootstrap_dispersion_gap"]}) g USING (domain, backbone)""",
)
def dispersion_vs_separability(spark, sf):
    """ID and OOD rows: dispersion, gaps, silhouette with its null, and gap limits."""
    keys = ["domain", "backbone"]
    return dispersion.dispersion_vs_separability(
        dispersion_table(spark, sf), silhouette_permutation(spark, sf), bootstrap_dispersion_gap(spark, sf), keys
    )


# --- severity sweep ---------------------------------------------------------------------

_SWEEP_SQL = f"""li AS (SELECT 'm' || CAST(l_suppkey % 8 AS VARCHAR) AS backbone, l_returnflag AS corruption, 1 + l_linenumber % 5 AS severity, l_returnflag = 'N' AS is_id,
   l_extendedprice AS msp, l_discount + 0.01::DOUBLE * (CASE WHEN l_returnflag = 'N' THEN 2 ELSE 0 END) - 0.004::DOUBLE * (CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_linenumber % 5 END) AS mahalanobis, l_extendedprice / 1000.0::DOUBLE * (CASE WHEN l_returnflag = 'N' THEN 1.0::DOUBLE ELSE 1.0::DOUBLE + 0.01::DOUBLE * (l_linenumber % 5) END) AS gap FROM lineitem),
cellk AS (SELECT DISTINCT backbone, corruption, severity FROM li WHERE NOT is_id),
pairs AS (SELECT k.backbone, k.corruption, k.severity, true AS is_id, msp, mahalanobis FROM li JOIN cellk k ON k.backbone = li.backbone WHERE li.is_id
  UNION ALL SELECT backbone, corruption, severity, false, msp, mahalanobis FROM li WHERE NOT is_id),
pl AS (SELECT * FROM pairs UNPIVOT (score FOR method IN (msp, mahalanobis))), {v.auroc_sql("pl", "backbone, corruption, severity, method")},
gr AS (SELECT backbone, CASE WHEN is_id THEN 'ID' ELSE corruption END AS corruption, CASE WHEN is_id THEN 0 ELSE severity END AS severity, gap FROM li),
go AS (SELECT *, row_number() OVER (PARTITION BY backbone, corruption, severity ORDER BY gap) AS rn, count(*) OVER (PARTITION BY backbone, corruption, severity) AS n FROM gr),
gt AS (SELECT backbone, corruption, severity, avg(gap) AS t FROM go WHERE {_TRIM_W} GROUP BY ALL),
sweep AS (SELECT a.backbone, a.corruption, a.severity, max(CASE WHEN method = 'mahalanobis' THEN auroc END) AS mahalanobis_auroc, max(CASE WHEN method = 'msp' THEN auroc END) AS msp_auroc,
   max(CASE WHEN method = 'mahalanobis' THEN auroc END) - max(CASE WHEN method = 'msp' THEN auroc END) AS delta_auroc, max(o.t) - max(i.t) AS logit_gap_trim1
   FROM au a JOIN gt o ON o.backbone = a.backbone AND o.corruption = a.corruption AND o.severity = a.severity JOIN gt i ON i.backbone = a.backbone AND i.corruption = 'ID' GROUP BY a.backbone, a.corruption, a.severity)"""


def _sweep(spark, sf):
    li = v.table(spark, sf, "lineitem", "l_suppkey", "l_linenumber", "l_returnflag", "l_extendedprice", "l_discount")
    is_id = F.col("l_returnflag") == "N"
    step = F.col("l_linenumber") % 5
    rows = li.select(
        F.concat(F.lit("m"), (F.col("l_suppkey") % 8).cast("string")).alias("backbone"),
        F.col("l_returnflag").alias("corruption"),
        (F.lit(1) + step).alias("severity"),
        is_id.alias("is_id"),
        F.col("l_extendedprice").alias("msp"),
        (
            F.col("l_discount") + F.lit(0.01) * F.when(is_id, 2).otherwise(0) - F.lit(0.004) * F.when(is_id, 0).otherwise(step)
        ).alias("mahalanobis"),
        (F.col("l_extendedprice") / F.lit(1000.0) * F.when(is_id, F.lit(1.0)).otherwise(F.lit(1.0) + F.lit(0.01) * step)).alias("gap"),
    )
    keys, cell = ["backbone"], ["corruption", "severity"]
    measures = ["msp", "mahalanobis"]
    long = rows.unpivot([*keys, *cell, "is_id"], measures, "method", "score")
    a = sweeps.auroc_against_shared_id(long.where("is_id"), long.where("not is_id"), [*keys, "method"], cell)
    pick = lambda m: F.max(F.when(F.col("method") == m, F.col("auroc")))
    points = a.groupBy(*keys, *cell).agg(
        pick("mahalanobis").alias("mahalanobis_auroc"), pick("msp").alias("msp_auroc"),
        (pick("mahalanobis") - pick("msp")).alias("delta_auroc"),
    )
    gaps = dispersion.trimmed_stats(
        rows.select(
            "backbone", F.when(F.col("is_id"), "ID").otherwise(F.col("corruption")).alias("corruption"),
            F.when(F.col("is_id"), 0).otherwise(F.col("severity")).alias("severity"), "gap",
        ),
        [*keys, *cell], "gap",
    )
    ref = gaps.where("corruption = 'ID'").select("backbone", F.col("trim_mean").alias("__id"))
    shifted = gaps.join(ref, "backbone").select(*keys, *cell, (F.col("trim_mean") - F.col("__id")).alias("logit_gap_trim1"))
    return cut_lineage(points.join(shifted, [*keys, *cell]))


@query(
    "severity_sweep",
    f"""WITH {_SWEEP_SQL} SELECT backbone, corruption, severity, {R("mahalanobis_auroc")} AS mahalanobis_auroc, {R("msp_auroc")} AS msp_auroc, {R("delta_auroc")} AS delta_auroc, {R("logit_gap_trim1")} AS logit_gap_trim1 FROM sweep""",
)
def severity_sweep(spark, sf):
    """Every (corruption, severity) cell against the same ID rows."""
    return rounded(_sweep(spark, sf), "mahalanobis_auroc", "msp_auroc", "delta_auroc", "logit_gap_trim1")


@query(
    "severity_correlations",
    f"""WITH {_SWEEP_SQL}, sc AS (SELECT backbone, 'ALL' AS scope, severity, abs(logit_gap_trim1) AS abs_logit_gap, delta_auroc FROM sweep UNION ALL SELECT backbone, corruption, severity, abs(logit_gap_trim1), delta_auroc FROM sweep),
l AS (SELECT * FROM sc UNPIVOT (value FOR measure IN (abs_logit_gap, delta_auroc))),
k AS (SELECT backbone, scope, measure, rank() OVER (PARTITION BY backbone, scope, measure ORDER BY severity) + (count(*) OVER (PARTITION BY backbone, scope, measure, severity) - 1) / 2.0::DOUBLE AS a,
   rank() OVER (PARTITION BY backbone, scope, measure ORDER BY value) + (count(*) OVER (PARTITION BY backbone, scope, measure, value) - 1) / 2.0::DOUBLE AS b FROM l)
SELECT backbone, scope, measure, {R("corr(a, b)")} AS rho, count(*) AS n FROM k GROUP BY ALL""",
)
def severity_correlations(spark, sf):
    """Spearman of severity with each measure, pooled and per corruption."""
    sweep = _sweep(spark, sf).withColumn("abs_logit_gap", F.abs("logit_gap_trim1"))
    out = sweeps.severity_correlations(sweep, "backbone", "corruption", "severity", ["abs_logit_gap", "delta_auroc"])
    return rounded(out, "rho")
