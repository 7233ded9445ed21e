"""Rank concordance, spreads and the decision tables built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftgauge.functions.labels import LEGACY_BACKBONES
from driftgauge.operators import decisions, dispersion, ranks, separability, tables
from driftgauge.operators.correlation import pearson
from driftgauge.operators.decisions import ID_FLOOR, JUMP_DELTA
from driftgauge.plans import views as v
from driftgauge.plans.registry import query
from driftgauge.plans.views import R, rounded
from driftgauge.session import cut_lineage

CELLS_SQL = f"""{v.ZOO_SQL}, {v.auroc_sql("zoo", "domain, backbone, method", "cells")}"""
SEED_CELLS_SQL = f"""{v.ZOO_SQL}, {v.auroc_sql("zoo", "domain, backbone, seed, method", "cells")}"""


def cells(spark, sf, *extra):
    """AUROC per (domain, backbone, method): one pass over the rows, then a small written table."""
    return cut_lineage(separability.auroc(v.zoo_scores(spark, sf), ["domain", "backbone", *extra, "method"]))


@query(
    "method_ranks",
    f"""WITH {CELLS_SQL}, {v.ranks_sql("cells", "domain, backbone")}
SELECT domain, backbone, method, {R("auroc")} AS auroc, rank FROM rk""",
)
def method_ranks(spark, sf):
    out = ranks.item_ranks(cells(spark, sf), ["domain", "backbone"], "auroc")
    return rounded(out, "auroc").select("domain", "backbone", "method", "auroc", "rank")


_W_COLS = f"n_raters, n_items, {R('kendall_w')} AS kendall_w, {R('k_ * (n_ - 1) * kendall_w')} AS friedman_chi2"


@query(
    "kendall_w",
    f"""WITH {CELLS_SQL}, {v.ranks_sql("cells", "domain, backbone")}, {v.w_sql("rk", "domain")}
SELECT domain, {_W_COLS} FROM kw""",
)
def kendall_w(spark, sf):
    return rounded(ranks.kendall_w(cells(spark, sf), ["domain"], ["backbone"], "method", "auroc"), "kendall_w", "friedman_chi2")


@query(
    "kendall_w_cross_seed",
    f"""WITH {SEED_CELLS_SQL}, {v.ranks_sql("cells", "domain, backbone, seed")}, {v.w_sql("rk", "domain, backbone")}
SELECT domain, backbone, {_W_COLS} FROM kw""",
)
def kendall_w_cross_seed(spark, sf):
    """Raters are seeds of one backbone."""
    out = ranks.kendall_w(cells(spark, sf, "seed"), ["domain", "backbone"], ["seed"], "method", "auroc")
    return rounded(out, "kendall_w", "friedman_chi2")


@query(
    "kendall_w_per_seed",
    f"""WITH {SEED_CELLS_SQL}, {v.ranks_sql("cells", "domain, backbone, seed")}, {v.w_sql("rk", "domain, seed")}
SELECT domain, seed, {_W_COLS} FROM kw""",
)
def kendall_w_per_seed(spark, sf):
    """Raters are backbones, at each fixed seed."""
    out = ranks.kendall_w(cells(spark, sf, "seed"), ["domain", "seed"], ["backbone"], "method", "auroc")
    return rounded(out, "kendall_w", "friedman_chi2")


_SUBSETS = {"feature": ranks.FEATURE_METHODS, "logit": ranks.LOGIT_METHODS, "common": ranks.COMMON_METHODS}


@query(
    "kendall_w_method_subsets",
    f"""WITH {CELLS_SQL}, subsets(subset, method) AS (VALUES {", ".join(f"('{s}', '{m}')" for s, ms in _SUBSETS.items() for m in ms)}),
sc AS (SELECT subset, domain, backbone, method, auroc FROM cells JOIN subsets USING (method)),
{v.ranks_sql("sc", "subset, domain, backbone")}, {v.w_sql("rk", "subset, domain")}
SELECT subset, domain, {_W_COLS} FROM kw""",
)
def kendall_w_method_subsets(spark, sf):
    """Feature-only, logit-only and common methods in one pass (subset is a group key)."""
    pairs = spark.createDataFrame([(s, m) for s, ms in _SUBSETS.items() for m in ms], "subset string, method string")
    sub = cells(spark, sf).join(F.broadcast(pairs), "method")
    return rounded(ranks.kendall_w(sub, ["subset", "domain"], ["backbone"], "method", "auroc"), "kendall_w", "friedman_chi2")


@query(
    "kendall_w_incomplete_raters",
    f"""WITH {CELLS_SQL}, holes AS (SELECT * FROM cells WHERE NOT (backbone = 'm3' AND method = 'knn' AND domain = 'F')),
full_r AS (SELECT h.* FROM holes h JOIN (SELECT domain, backbone FROM holes GROUP BY ALL HAVING count(*) = 5) f USING (domain, backbone)),
{v.ranks_sql("full_r", "domain, backbone")}, {v.w_sql("rk", "domain")}
SELECT domain, {_W_COLS} FROM kw""",
)
def kendall_w_incomplete_raters(spark, sf):
    """A rater without every method does not vote."""
    holes = cells(spark, sf).where("not (backbone = 'm3' and method = 'knn' and domain = 'F')")
    return rounded(ranks.kendall_w(holes, ["domain"], ["backbone"], "method", "auroc"), "kendall_w", "friedman_chi2")


@query(
    "kendall_w_null_cells",
    f"""WITH {CELLS_SQL}, votes AS (SELECT * FROM cells WHERE NOT (backbone = 'm3' AND method = 'knn' AND domain = 'F') AND NOT (backbone = 'm1' AND method = 'msp')),
full_r AS (SELECT h.* FROM votes h JOIN (SELECT domain, backbone FROM votes GROUP BY ALL HAVING count(*) = 5) f USING (domain, backbone)),
{v.ranks_sql("full_r", "domain, backbone")}, {v.w_sql("rk", "domain")}
SELECT domain, {_W_COLS} FROM kw""",
)
def kendall_w_null_cells(spark, sf):
    """A rater with a NULL or NaN score does not vote."""
    score = (
        F.when((F.col("backbone") == "m3") & (F.col("method") == "knn") & (F.col("domain") == "F"), F.lit(None).cast("double"))
        .when((F.col("backbone") == "m1") & (F.col("method") == "msp"), F.lit(float("nan")))
        .otherwise(F.col("auroc"))
    )
    holes = cells(spark, sf).withColumn("auroc", score)
    return rounded(ranks.kendall_w(holes, ["domain"], ["backbone"], "method", "auroc"), "kendall_w", "friedman_chi2")


@query(
    "kendall_w_jackknife",
    f"""WITH {CELLS_SQL}, {v.ranks_sql("cells", "domain, backbone")}, {v.w_sql("rk", "domain")},
loo AS (SELECT r.*, h.held_out FROM rk r JOIN (SELECT DISTINCT domain, backbone AS held_out FROM cells) h
        ON r.domain = h.domain AND r.backbone <> h.held_out), {v.w_sql("loo", "domain, held_out", name="lw")}
SELECT l.domain, held_out, l.n_raters, {R("l.kendall_w")} AS kendall_w, {R("l.kendall_w - k.kendall_w")} AS delta_vs_full
FROM lw l JOIN kw k ON l.domain = k.domain""",
)
def kendall_w_jackknife(spark, sf):
    out = ranks.jackknife_w(cells(spark, sf), ["domain"], "backbone", "method", "auroc")
    return rounded(out, "kendall_w", "delta_vs_full")


_SPREAD_SQL = f"""{CELLS_SQL}, sp AS (SELECT domain, method, count(*) AS n_backbones, avg(auroc) AS mean_auroc, stddev_samp(auroc) AS spread FROM cells GROUP BY ALL)"""


@query(
    "spread_wide",
    f"""WITH {_SPREAD_SQL}
SELECT s.domain, s.method, n_backbones, {R("mean_auroc")} AS mean_auroc, {R("spread")} AS spread,
       {", ".join(f"{R(f'max(CASE WHEN backbone = {chr(39)}{b}{chr(39)} THEN auroc END)')} AS auroc_{b}" for b in v.MODELS)}
FROM sp s JOIN cells c ON s.domain = c.domain AND s.method = c.method GROUP BY s.domain, s.method, n_backbones, mean_auroc, spread""",
)
def spread_wide(spark, sf):
    out = ranks.spread_wide(cells(spark, sf), v.MODELS)
    return rounded(out, "mean_auroc", "spread", *[f"auroc_{b}" for b in v.MODELS])


@query(
    "method_summary",
    f"""WITH {_SPREAD_SQL} SELECT method, {R("avg(mean_auroc)")} AS mean_auroc, {R("avg(spread)")} AS mean_spread,
    {R("avg(mean_auroc) - avg(spread)")} AS mean_minus_spread FROM sp GROUP BY method""",
)
def method_summary(spark, sf):
    out = ranks.method_summary(ranks.spread(cells(spark, sf), ["domain", "method"]))
    return rounded(out, "mean_auroc", "mean_spread", "mean_minus_spread")


@query(
    "leave_one_domain_spread",
    f"""WITH {_SPREAD_SQL}, ok AS (SELECT * FROM sp WHERE n_backbones >= 2)
SELECT method, '(none)' AS held_out, {R("avg(spread)")} AS mean_spread, count(*) AS n_domains FROM ok GROUP BY method
UNION ALL
SELECT method, h.held_out, {R("avg(spread)")} AS mean_spread, count(*) AS n_domains
FROM ok JOIN (SELECT DISTINCT domain AS held_out FROM cells) h ON ok.domain <> h.held_out GROUP BY method, h.held_out""",
)
def leave_one_domain_spread(spark, sf):
    return rounded(ranks.leave_one_domain_spread(cells(spark, sf)), "mean_spread").select(
        "method", "held_out", "mean_spread", "n_domains"
    )


@query(
    "rank_pivot",
    f"""WITH {CELLS_SQL}, {v.ranks_sql("cells", "domain, backbone")}
SELECT domain, method, {", ".join(f"max(CASE WHEN backbone = '{b}' THEN rank END) AS {b}" for b in v.MODELS)} FROM rk GROUP BY domain, method""",
)
def rank_pivot(spark, sf):
    ranked = ranks.item_ranks(cells(spark, sf), ["domain", "backbone"], "auroc")
    return ranks.rank_pivot(ranked, ["domain", "method"], "backbone", v.MODELS)


@query(
    "complete_matrix",
    f"""WITH {CELLS_SQL}, holes AS (SELECT * FROM cells WHERE NOT (backbone IN ('m1', 'm6') AND method = 'energy'))
SELECT domain, backbone, {", ".join(f"{R(f'max(CASE WHEN method = {chr(39)}{m}{chr(39)} THEN auroc END)')} AS {m}" for m in v.ZOO_METHODS)}
FROM holes GROUP BY ALL HAVING count(*) = 5""",
)
def complete_matrix(spark, sf):
    """Long table to matrix, complete rows only."""
    holes = cells(spark, sf).where("not (backbone in ('m1', 'm6') and method = 'energy')")
    full = ranks.complete_raters(holes, ["domain"], ["backbone"], "method", "auroc")
    wide = full.groupBy("domain", "backbone").pivot("method", list(v.ZOO_METHODS)).agg(F.first("auroc"))
    return rounded(wide, *v.ZOO_METHODS)


@query(
    "wide_table_unpivot",
    f"""WITH {CELLS_SQL} SELECT domain, method, CASE backbone WHEN 'm0' THEN 'resnet18' WHEN 'm1' THEN 'resnet50' ELSE backbone END AS backbone,
    {R("auroc")} AS auroc FROM cells WHERE NOT (backbone = 'm5' AND domain = 'O')""",
)
def wide_table_unpivot(spark, sf):
    """Wide AUROC columns back to rows; legacy short names mapped, NULLs dropped."""
    long = cells(spark, sf).where("not (backbone = 'm5' and domain = 'O')")
    names = ["r18", "r50", *v.MODELS[2:]]
    wide = ranks.spread_wide(
        long.replace({"m0": "r18", "m1": "r50"}, subset=["backbone"]), names
    )
    out = tables.unpivot_prefixed(wide, ["domain", "method"], "auroc_", "backbone", "auroc", LEGACY_BACKBONES)
    return rounded(out, "auroc").select("domain", "method", "backbone", "auroc")


@query(
    "family_view",
    f"""WITH {CELLS_SQL}, fam(backbone, family) AS (VALUES ('m0', 'resnet_like'), ('m1', 'resnet_like'), ('m2', 'efficientnet_like'), ('m3', 'efficientnet_like'), ('m4', 'dense_connection'))
SELECT domain, backbone, coalesce(family, 'unknown') AS family, {R("auroc")} AS msp_auroc FROM cells LEFT JOIN fam USING (backbone) WHERE method = 'msp'""",
)
def family_view(spark, sf):
    names = {"m0": "resnet_like", "m1": "resnet_like", "m2": "efficientnet_like", "m3": "efficientnet_like", "m4": "dense_connection"}
    msp = cells(spark, sf).where("method = 'msp'").withColumnRenamed("auroc", "msp_auroc")
    out = tables.with_registry(msp, names, "backbone", "family")
    return rounded(out, "msp_auroc").select("domain", "backbone", "family", "msp_auroc")


# --- jumps and verdicts ----------------------------------------------------------------


def _jump_sql(src: str, keys: str, name: str = "jp") -> str:
    k = [x.strip() for x in keys.split(",")]
    on = " AND ".join(f"a.{x} = b.{x}" for x in k)
    return f"""
{name}_b AS (SELECT {keys}, avg(auroc) AS baseline_mean FROM {src} WHERE backbone IN {v.in_list(v.BASELINE)} GROUP BY {keys}),
{name} AS (SELECT a.*, b.baseline_mean, a.auroc - b.baseline_mean AS jump FROM {src} a LEFT JOIN {name}_b b ON {on})"""


@query(
    "baseline_jump",
    f"""WITH {CELLS_SQL}, {_jump_sql("cells", "domain, method")}
SELECT domain, backbone, method, {R("auroc")} AS auroc, {R("baseline_mean")} AS baseline_mean, {R("jump")} AS jump FROM jp""",
)
def baseline_jump(spark, sf):
    out = tables.baseline_jump(cells(spark, sf), ["domain", "method"], "backbone", v.BASELINE, "auroc")
    return rounded(out, "auroc", "baseline_mean", "jump").select("domain", "backbone", "method", "auroc", "baseline_mean", "jump")


@query(
    "scenario_classifier",
    f"""WITH {CELLS_SQL}, msp AS (SELECT * FROM cells WHERE method = 'msp'), {_jump_sql("msp", "domain")},
j AS (SELECT domain, count(*) AS n_backbones, count(*) FILTER (backbone IN {v.in_list(v.BASELINE)}) AS n_baseline,
             count(*) FILTER (jump >= {JUMP_DELTA} AND backbone IN {v.in_list(v.FAMILY)}) AS n_jump_family,
             count(*) FILTER (jump >= {JUMP_DELTA} AND backbone NOT IN {v.in_list(v.FAMILY + v.BASELINE)}) AS n_jump_other FROM jp GROUP BY domain),
med AS (SELECT domain, method, quantile_cont(auroc, 0.5) AS med FROM cells WHERE method IN ('mahalanobis', 'knn') AND backbone IN {v.in_list(v.ORIGINALS)}
        GROUP BY ALL HAVING count(*) = 3),
drag AS (SELECT c.domain, count(*) FILTER (auroc < med - 0.10::DOUBLE) AS n_dragged FROM cells c JOIN med m ON c.domain = m.domain AND c.method = m.method
         WHERE backbone NOT IN {v.in_list(v.ORIGINALS)} GROUP BY c.domain)
SELECT domain, n_backbones, n_baseline, n_jump_family, n_jump_other, coalesce(n_dragged, 0) AS n_dragged,
       CASE WHEN n_backbones < 8 THEN 'pending_n' WHEN n_baseline < 2 THEN 'pending_baseline' WHEN coalesce(n_dragged, 0) > 0 THEN 'C'
            WHEN n_jump_other > 0 THEN 'A' WHEN n_jump_family > 0 THEN 'B' ELSE 'no_jump' END AS scenario FROM j LEFT JOIN drag USING (domain)""",
)
def scenario_classifier(spark, sf):
    return decisions.scenario(cells(spark, sf), ["domain"], v.BASELINE, v.FAMILY, v.ORIGINALS, 8)


@query(
    "seed_verdict",
    f"""WITH {SEED_CELLS_SQL}, msp AS (SELECT * FROM cells WHERE method = 'msp'), {_jump_sql("msp", "domain, seed")},
g AS (SELECT domain, backbone, avg(jump) AS mean_jump, stddev_samp(jump) AS sd_jump, count(*) FILTER (jump >= {JUMP_DELTA}) AS n_hit, count(*) AS n_seeds
      FROM jp GROUP BY ALL)
SELECT domain, backbone, {R("mean_jump")} AS mean_jump, {R("sd_jump")} AS sd_jump, n_hit, n_seeds,
       CASE WHEN mean_jump >= {JUMP_DELTA} AND n_hit >= 4 THEN 'robust' WHEN mean_jump >= {JUMP_DELTA} THEN 'high_variance' ELSE 'seed_fragile' END AS verdict FROM g""",
)
def seed_verdict(spark, sf):
    msp = cells(spark, sf, "seed").where("method = 'msp'")
    jumps = tables.baseline_jump(msp, ["domain", "seed"], "backbone", v.BASELINE, "auroc")
    return rounded(decisions.seed_verdict(jumps, ["domain", "backbone"]), "mean_jump", "sd_jump")


_ARM_SQL = f"""{CELLS_SQL}, {_jump_sql("cells", "domain, method")},
g AS (SELECT domain, method, quantile_cont(auroc, 0.5) AS median_msp, min(auroc) AS min_msp, count(*) FILTER (backbone NOT IN {v.in_list(v.BASELINE)}) AS n_other,
             count(*) FILTER (backbone NOT IN {v.in_list(v.BASELINE)} AND jump >= {JUMP_DELTA}) AS n_hit,
             avg(jump) FILTER (backbone NOT IN {v.in_list(v.BASELINE)}) AS mean_jump FROM jp GROUP BY ALL),
arms AS (SELECT *, CASE WHEN median_msp >= 0.95 OR min_msp >= 0.90 THEN 'sat' WHEN n_hit = n_other THEN 'all'
                 WHEN n_hit = 0 AND mean_jump < {JUMP_DELTA} THEN 'none' ELSE 'mixed' END AS bucket FROM g)"""


def _arms(spark, sf):
    """Every method of a domain is read as one arm."""
    c = cells(spark, sf)
    return decisions.arm_classes(c, ["domain", "method"], v.BASELINE, F.percentile("auroc", 0.5))


@query(
    "arm_classes",
    f"""WITH {_ARM_SQL} SELECT domain, method, {R("median_msp")} AS median_msp, {R("min_msp")} AS min_msp, n_other, n_hit, {R("mean_jump")} AS mean_jump, bucket FROM arms""",
)
def arm_classes(spark, sf):
    return rounded(_arms(spark, sf), "median_msp", "min_msp", "mean_jump")


_READING_SQL = ", ".join(f"('{a}', '{b}', '{c}')" for (a, b), c in decisions.JOINT_READING.items())


@query(
    "joint_reading",
    f"""WITH {_ARM_SQL}, reading(task, far, reading) AS (VALUES {_READING_SQL}),
pair AS (SELECT a.method, a.bucket AS task, b.bucket AS far FROM arms a JOIN arms b USING (method) WHERE a.domain = 'F' AND b.domain = 'O')
SELECT task, far, method, coalesce(reading, 'mixed') AS reading FROM pair LEFT JOIN reading USING (task, far)""",
)
def joint_reading(spark, sf):
    arms = _arms(spark, sf)
    return decisions.joint_reading(arms.where("domain = 'F'"), arms.where("domain = 'O'"), ["method"])


_ACC_SQL = f"""{CELLS_SQL}, acc AS (SELECT 'm' || CAST(l_suppkey % 8 AS VARCHAR) AS backbone, l_linestatus AS domain,
            avg(CASE WHEN l_quantity > 1 + l_suppkey % 8 * 0.25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS id_acc FROM lineitem GROUP BY ALL),
cell AS (SELECT c.domain, c.backbone, c.auroc, a.id_acc FROM cells c LEFT JOIN acc a ON c.domain = a.domain AND c.backbone = a.backbone AND a.backbone <> 'm7'
         WHERE method = 'msp')"""


def _cells_with_accuracy(spark, sf):
    """MSP cells with an ID accuracy side table (one backbone has none: left join)."""
    li = v.table(spark, sf, "lineitem", "l_suppkey", "l_linestatus", "l_quantity")
    m = F.col("l_suppkey") % 8
    acc = (
        li.groupBy(F.concat(F.lit("m"), m.cast("string")).alias("backbone"), F.col("l_linestatus").alias("domain"))
        .agg(F.avg((F.col("l_quantity") > 1 + m * F.lit(0.25)).cast("double")).alias("id_acc"))
        .where("backbone <> 'm7'")
    )
    return cells(spark, sf).where("method = 'msp'").drop("method").join(acc, ["domain", "backbone"], "left")


@query(
    "recipe_verdict",
    f"""WITH {_ACC_SQL}, g AS (SELECT domain, count(*) FILTER (id_acc IS NULL OR id_acc >= {ID_FLOOR}) AS n_clean,
   count(*) FILTER ((id_acc IS NULL OR id_acc >= {ID_FLOOR}) AND auroc - 0.5 >= {JUMP_DELTA}) AS n_hit,
   count(*) FILTER (NOT (id_acc IS NULL OR id_acc >= {ID_FLOOR})) AS n_dirty FROM cell WHERE backbone NOT IN {v.in_list(v.BASELINE)} GROUP BY domain)
SELECT *, CASE WHEN n_clean = 0 THEN 'all_dirty' WHEN n_hit = 0 THEN 'recipe_inflated' WHEN n_hit >= 3 THEN 'recipe_independent' ELSE 'mixed' END AS verdict FROM g""",
)
def recipe_verdict(spark, sf):
    c = _cells_with_accuracy(spark, sf).where(~F.col("backbone").isin(v.BASELINE))
    return decisions.recipe_verdict(c, ["domain"], 0.5)


@query(
    "recipe_survival",
    f"""WITH {_ACC_SQL}, g AS (SELECT domain, count(*) FILTER (id_acc IS NULL OR id_acc >= {ID_FLOOR}) AS n_clean,
   count(*) FILTER ((id_acc IS NULL OR id_acc >= {ID_FLOOR}) AND auroc >= 0.5 + {JUMP_DELTA}) AS n_hit FROM cell WHERE backbone IN {v.in_list(v.BASELINE)} GROUP BY domain)
SELECT *, CASE WHEN n_clean = 0 THEN 'all_dirty' WHEN n_hit > 0 THEN 'recipe_can_jump' ELSE 'no_jump_survives' END AS verdict FROM g""",
)
def recipe_survival(spark, sf):
    c = _cells_with_accuracy(spark, sf).where(F.col("backbone").isin(v.BASELINE))
    return decisions.survival_verdict(c, ["domain"], 0.5)


@query(
    "covariate_verdict",
    f"""WITH {SEED_CELLS_SQL}, w AS (SELECT seed, max(CASE WHEN domain = 'F' AND backbone = 'm7' THEN auroc END) AS dense_2,
   max(CASE WHEN domain = 'F' AND backbone = 'm4' THEN auroc END) AS small_2, max(CASE WHEN domain = 'F' AND backbone = 'm5' THEN auroc END) AS large_2,
   max(CASE WHEN domain = 'O' AND backbone = 'm7' THEN auroc END) AS dense_1, max(CASE WHEN domain = 'O' AND backbone = 'm4' THEN auroc END) AS small_1
   FROM cells WHERE method = 'msp' GROUP BY seed),
x AS (SELECT *, 0.98 + seed * 0.001 AS id_acc_min, 0.10 + seed * 0.02 AS small_coverage, 0.574 AS small_floor, 0.515 AS large_floor FROM w),
h AS (SELECT *, small_2 >= 0.62 OR (dense_2 - small_2 <= 0.12 AND small_2 >= small_floor) AS s2, large_2 >= 0.62 OR (dense_2 - large_2 <= 0.12 AND large_2 >= large_floor) AS l2,
      small_1 >= 0.62 OR (dense_1 - small_1 <= 0.12 AND small_1 >= small_floor) AS s1 FROM x)
SELECT seed, {R("dense_2")} AS dense_2, {R("small_2")} AS small_2, CASE WHEN id_acc_min < {ID_FLOOR} OR dense_2 < 0.55 THEN 'dirty' WHEN NOT s2 OR small_coverage < 0.135 THEN 'miss'
   WHEN NOT l2 THEN 'weak_one_model' WHEN NOT s1 THEN 'weak_one_target' ELSE 'strong' END AS verdict FROM h""",
)
def covariate_verdict(spark, sf):
    c = cells(spark, sf, "seed").where("method = 'msp'")
    who = lambda d, b: F.max(F.when((F.col("domain") == d) & (F.col("backbone") == b), F.col("auroc")))
    wide = c.groupBy("seed").agg(
        who("F", "m7").alias("dense_2"), who("F", "m4").alias("small_2"), who("F", "m5").alias("large_2"),
        who("O", "m7").alias("dense_1"), who("O", "m4").alias("small_1"),
    ).withColumns(
        {
            "id_acc_min": F.lit(0.98) + F.col("seed") * F.lit(0.001),
            "small_coverage": F.lit(0.10) + F.col("seed") * F.lit(0.02),
            "small_floor": F.lit(0.574),
            "large_floor": F.lit(0.515),
        }
    )
    out = decisions.covariate_verdict(wide, jump_line=0.62, gap_bar=0.12, dense_floor=0.55, coverage_floor=0.135)
    return rounded(out, "dense_2", "small_2").select("seed", "dense_2", "small_2", "verdict")


_PAIR_SQL = f"""{CELLS_SQL}, p AS (SELECT domain, backbone, max(CASE WHEN method = 'mahalanobis' THEN auroc END) AS maha, max(CASE WHEN method = 'msp' THEN auroc END) AS msp
   FROM cells GROUP BY ALL)"""


@query(
    "encoder_verdict",
    f"""WITH {_PAIR_SQL}, x AS (SELECT p.*, b.maha AS base_maha, b.msp AS base_msp FROM p LEFT JOIN (SELECT * FROM p WHERE backbone = 'm6' AND domain = 'F') b USING (domain))
SELECT domain, backbone, {R("maha")} AS maha, {R("msp")} AS msp, {R("base_maha")} AS base_maha, {R("base_msp")} AS base_msp,
   CASE WHEN base_maha IS NULL THEN 'no_baseline' WHEN (maha > msp) <> (base_maha > base_msp) THEN 'reverse' WHEN maha < 0.70 AND base_maha >= 0.85 THEN 'new_regime_collapse'
        WHEN maha >= 0.85 AND base_maha < 0.70 THEN 'new_regime_rescue' ELSE 'replicate' END AS verdict FROM x""",
)
def encoder_verdict(spark, sf):
    """Optional baseline: one domain has none."""
    wide = cells(spark, sf).groupBy("domain", "backbone").pivot("method", ["mahalanobis", "msp"]).agg(F.first("auroc"))
    wide = wide.withColumnRenamed("mahalanobis", "maha")
    base = wide.where("backbone = 'm6' and domain = 'F'").select("domain", F.col("maha").alias("base_maha"), F.col("msp").alias("base_msp"))
    out = decisions.encoder_verdict(wide.join(base, "domain", "left"))
    return rounded(out, "maha", "msp", "base_maha", "base_msp")


@query(
    "resolution_verdict",
    f"""WITH {CELLS_SQL}, b AS (SELECT domain, min(auroc) AS band_low, max(auroc) AS band_high FROM cells WHERE method = 'msp' AND backbone IN {v.in_list(v.BASELINE)} GROUP BY domain),
x AS (SELECT n.domain, n.backbone, n.auroc AS msp_native, m.auroc AS msp_matched, band_low, band_high FROM cells n
      LEFT JOIN cells m ON m.method = 'energy' AND m.domain = n.domain AND m.backbone = n.backbone AND m.backbone <> 'm7' JOIN b ON n.domain = b.domain WHERE n.method = 'msp'),
y AS (SELECT *, msp_matched >= msp_native - 0.08 AS still, msp_matched BETWEEN band_low - 0.05 AND band_high + 0.05 AS dropped FROM x)
SELECT domain, backbone, {R("msp_native")} AS msp_native, {R("msp_matched")} AS msp_matched,
   CASE WHEN msp_matched IS NULL THEN 'pending' WHEN still AND NOT dropped THEN 'architecture' WHEN dropped THEN 'resolution_artifact' ELSE 'mixed' END AS verdict FROM y""",
)
def resolution_verdict(spark, sf):
    c = cells(spark, sf)
    native = c.where("method = 'msp'").select("domain", "backbone", F.col("auroc").alias("msp_native"))
    matched = c.where("method = 'energy' and backbone <> 'm7'").select("domain", "backbone", F.col("auroc").alias("msp_matched"))
    band = native.where(F.col("backbone").isin(v.BASELINE)).groupBy("domain").agg(
        F.min("msp_native").alias("band_low"), F.max("msp_native").alias("band_high")
    )
    out = decisions.resolution_verdict(native.join(matched, ["domain", "backbone"], "left").join(band, "domain"))
    return rounded(out, "msp_native", "msp_matched").select("domain", "backbone", "msp_native", "msp_matched", "verdict")


def _profile_band(share: float) -> str:
    k = f"floor({share}::DOUBLE * n)"
    return f"avg(x) FILTER (n < 3 OR {k} <= 0 OR 2 * {k} >= n OR (rn > {k} AND rn <= n - {k}))"


@query(
    "estimator_verdict",
    f"""WITH s AS (SELECT 'm' || CAST(l_suppkey % 8 AS VARCHAR) AS backbone, l_returnflag = 'N' AS is_id, l_extendedprice * (1 + 0.01 * (l_suppkey % 8)) AS x FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY backbone, is_id ORDER BY x) AS rn, count(*) OVER (PARTITION BY backbone, is_id) AS n FROM s),
q AS (SELECT backbone, is_id, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM s GROUP BY ALL),
p AS (SELECT backbone, is_id, quantile_cont(x, 0.5) AS med, {_profile_band(0.01)} AS t01, {_profile_band(0.05)} AS t05, {_profile_band(0.10)} AS t10,
        avg(CASE WHEN x < q1 - 3 * (q3 - q1) OR x > q3 + 3 * (q3 - q1) THEN 1.0 ELSE 0.0 END) AS beyond FROM r JOIN q USING (backbone, is_id) GROUP BY ALL),
g AS (SELECT o.backbone, o.t01 - i.t01 AS gap_trim_01, o.t05 - i.t05 AS gap_trim_05, o.t10 - i.t10 AS gap_trim_10, o.med - i.med AS gap_median, o.beyond AS frac_beyond_3iqr
      FROM p o JOIN p i USING (backbone) WHERE NOT o.is_id AND i.is_id),
x AS (SELECT g.*, (SELECT gap_trim_01 FROM g WHERE backbone = 'm1') AS reference_gap FROM g),
y AS (SELECT *, sign(gap_trim_01) = sign(gap_trim_05) AND sign(gap_trim_05) = sign(gap_trim_10) AND sign(gap_trim_10) = sign(gap_median) AS stable,
        sign(gap_trim_01) = sign(reference_gap) AS matches FROM x)
SELECT backbone, {R("gap_trim_01")} AS gap_trim_01, {R("gap_median")} AS gap_median, {R("frac_beyond_3iqr")} AS frac_beyond_3iqr,
   CASE WHEN stable AND NOT matches AND frac_beyond_3iqr < 0.02 THEN 'real' WHEN NOT matches AND sign(gap_trim_05) = sign(reference_gap) THEN 'tail_artifact' ELSE 'mixed' END AS verdict FROM y""",
)
def estimator_verdict(spark, sf):
    li = v.table(spark, sf, "lineitem", "l_suppkey", "l_returnflag", "l_extendedprice")
    m = F.col("l_suppkey") % 8
    rows = li.select(
        F.concat(F.lit("m"), m.cast("string")).alias("backbone"),
        (F.col("l_returnflag") == "N").alias("is_id"),
        (F.col("l_extendedprice") * (F.lit(1) + F.lit(0.01) * m)).alias("x"),
    )
    p = dispersion.robust_profile(rows, ["backbone", "is_id"], "x")
    diff = lambda c: (F.max(F.when(~F.col("is_id"), F.col(c))) - F.max(F.when(F.col("is_id"), F.col(c))))
    gaps = p.groupBy("backbone").agg(
        diff("trim_01").alias("gap_trim_01"), diff("trim_05").alias("gap_trim_05"), diff("trim_10").alias("gap_trim_10"),
        diff("median").alias("gap_median"), F.max(F.when(~F.col("is_id"), F.col("frac_beyond_3iqr"))).alias("frac_beyond_3iqr"),
    )
    gaps = cut_lineage(gaps)
    ref = gaps.where("backbone = 'm1'").select("gap_trim_01").scalar()
    out = decisions.estimator_verdict(gaps.withColumn("reference_gap", ref))
    return rounded(out, "gap_trim_01", "gap_median", "frac_beyond_3iqr").select(
        "backbone", "gap_trim_01", "gap_median", "frac_beyond_3iqr", "verdict"
    )


@query(
    "shrink_verdict",
    f"""WITH {CELLS_SQL}, x AS (SELECT domain, max(CASE WHEN method = 'msp' AND backbone = 'm7' THEN auroc END) - max(CASE WHEN method = 'msp' AND backbone = 'm0' THEN auroc END) AS old_gap,
   max(CASE WHEN method = 'energy' AND backbone = 'm5' THEN auroc END) - max(CASE WHEN method = 'energy' AND backbone = 'm0' THEN auroc END) AS new_gap FROM cells GROUP BY domain)
SELECT domain, {R("old_gap")} AS old_gap, {R("new_gap")} AS new_gap, {R("1 - new_gap / nullif(old_gap, 0)")} AS shrink, CASE WHEN new_gap <= 0.5 * old_gap THEN 'promising' ELSE 'dead' END AS verdict FROM x""",
)
def shrink_verdict(spark, sf):
    who = lambda m, b: F.max(F.when((F.col("method") == m) & (F.col("backbone") == b), F.col("auroc")))
    gaps = cells(spark, sf).groupBy("domain").agg(
        (who("msp", "m7") - who("msp", "m0")).alias("old_gap"), (who("energy", "m5") - who("energy", "m0")).alias("new_gap")
    )
    return rounded(decisions.shrink_verdict(gaps), "old_gap", "new_gap", "shrink")


@query(
    "correlation_verdict",
    f"""WITH {CELLS_SQL}, {_jump_sql("cells", "domain, method")}, t AS (SELECT domain, backbone, auroc AS t FROM cells WHERE method = 'energy'),
x AS (SELECT j.domain, corr(t.t, j.jump) AS r, count(*) AS n FROM jp j JOIN t ON j.domain = t.domain AND j.backbone = t.backbone WHERE j.method = 'msp' GROUP BY j.domain)
SELECT domain, {R("r")} AS r, n, abs(r) > 0.6 AS notable FROM x""",
)
def correlation_verdict(spark, sf):
    c = cells(spark, sf)
    jumps = tables.baseline_jump(c.where("method = 'msp'"), ["domain"], "backbone", v.BASELINE, "auroc")
    t = c.where("method = 'energy'").select("domain", "backbone", F.col("auroc").alias("t"))
    r = pearson(jumps.join(t, ["domain", "backbone"]), ["domain"], "t", "jump")
    return rounded(decisions.correlation_verdict(r, "r"), "r")


@query(
    "bound_verdict",
    f"""WITH {CELLS_SQL}, msp AS (SELECT * FROM cells WHERE method = 'msp'), {_jump_sql("msp", "domain")},
g AS (SELECT domain, max(baseline_mean) AS baseline_mean, max(CASE WHEN backbone = 'm4' THEN jump END) AS probe_jump,
        count(*) FILTER (backbone IN ('m2', 'm3', 'm5', 'm6', 'm7') AND jump >= {JUMP_DELTA}) AS n_extra_hit FROM jp GROUP BY domain)
SELECT domain, {R("baseline_mean")} AS baseline_mean, {R("probe_jump")} AS probe_jump, n_extra_hit, CASE WHEN probe_jump >= {JUMP_DELTA} THEN 'hit' ELSE 'miss' END AS verdict FROM g""",
)
def bound_verdict(spark, sf):
    msp = cells(spark, sf).where("method = 'msp'")
    out = decisions.bound_verdict(msp, ["domain"], v.BASELINE, "m4", ["m2", "m3", "m5", "m6", "m7"])
    return rounded(out, "baseline_mean", "probe_jump")


@query(
    "first_epoch_over_bar",
    f"""WITH {SEED_CELLS_SQL}, msp AS (SELECT * FROM cells WHERE method = 'msp'), {_jump_sql("msp", "domain, seed")}
SELECT domain, backbone, min(CASE WHEN jump >= {JUMP_DELTA} THEN seed END) AS first_epoch FROM jp GROUP BY ALL""",
)
def first_epoch_over_bar(spark, sf):
    """Epoch log: jump against the same epoch's baseline, first epoch over the bar."""
    log = cells(spark, sf, "seed").where("method = 'msp'").withColumnRenamed("seed", "epoch")
    jumps = tables.baseline_jump(log, ["domain", "epoch"], "backbone", v.BASELINE, "auroc")
    return tables.first_epoch_over(jumps, ["domain", "backbone"], "jump", JUMP_DELTA)
