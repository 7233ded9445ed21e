"""Reference-shaped inputs derived from the given tables, and the same views as SQL text.

``embeddings`` plays the feature table: centers 0, 3, 4 are in-distribution (90 % train,
10 % validation), center 1 is the near shift, center 2 the far shift (a fixed offset is
added). Four slices of the vector stand for four backbones; the head is ten times the
class centroid of the training rows. ``lineitem`` gives bulk scored rows, ``orders`` and
``events`` rows with a unique key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgauge.functions import scores as S
from driftgauge.operators.moments import vector_means
from driftgauge.operators.scorer import linear_logits

# backbone -> (first dimension, number of dimensions), 1-based
BACKBONES = {"b16": (1, 16), "b32": (1, 32), "b64": (1, 64), "t32": (33, 32)}
SHIFT = 0.05
HEAD_SCALE = 10.0
DOMAINS = ("near", "far")
NUDGE = 1e-10


def table(spark: SparkSession, sf: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.select(*cols) if cols else df


def r6(c: Column) -> Column:
    """Six decimals, no negative zero: the form results are compared in.

    The nudge keeps exact half steps (k/400 and the like) from rounding by engine.
    """
    return F.round(c.cast("double") + F.lit(NUDGE), 6) + F.lit(0.0)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in cols})


def samples(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    center = F.col("vec_id") % 5
    block = F.floor(F.col("vec_id") / 5)
    split = (
        F.when(center.isin(0, 3, 4), F.when(block % 10 == 0, "id_val").otherwise("train")).when(center == 1, "near").otherwise("far")
    )
    offset = F.when(center == 2, F.lit(SHIFT)).otherwise(F.lit(0.0))
    base = e.select(
        F.col("vec_id").alias("sample_id"),
        "label",
        center.alias("center"),
        (center * 100 + block % 9).alias("group_id"),
        split.alias("split"),
        F.transform("embedding", lambda x: x.cast("double") + offset).alias("e"),
    )
    variants = F.explode(
        F.array(
            *[
                F.struct(F.lit(b).alias("backbone"), F.slice("e", lo, n).alias("feats"))
                for b, (lo, n) in BACKBONES.items()
            ]
        )
    )
    return base.select("*", variants.alias("v")).select(
        "v.backbone", "sample_id", "label", "center", "group_id", "split", "v.feats"
    )


def heads(s: DataFrame) -> DataFrame:
    means = vector_means(s.where("split = 'train'"), ["backbone", "label"], "feats")
    weight = F.transform("mean", lambda x: x * F.lit(HEAD_SCALE))
    return means.select("backbone", F.col("label").alias("class"), weight.alias("weight"), F.lit(0.0).alias("bias"))


def with_logits(spark: SparkSession, sf: str) -> DataFrame:
    s = samples(spark, sf)
    return linear_logits(s, heads(s), ["backbone"])


def by_domain(df: DataFrame) -> DataFrame:
    """Evaluation rows per domain: validation rows serve both, each shift its own."""
    d = F.when(F.col("split") == "id_val", F.array(*[F.lit(x) for x in DOMAINS])).otherwise(F.array("split"))
    return (
        df.where("split <> 'train'")
        .withColumn("domain", F.explode(d))
        .withColumn("is_id", F.col("split") == "id_val")
    )


def logit_scores(df: DataFrame) -> DataFrame:
    """Long (…, method, score) rows for the three logit scores."""
    z = F.col("logits")
    wide = df.withColumns({"msp": S.msp(z), "energy": S.energy(z), "logit_norm": S.logit_norm(z)}).drop("logits", "feats")
    ids = [c for c in wide.columns if c not in ("msp", "energy", "logit_norm")]
    return wide.unpivot(ids, ["msp", "energy", "logit_norm"], "method", "score")


def bulk_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Bulk scored rows: price has few ties, discount is heavily tied. Order-insensitive use only."""
    li = table(spark, sf, "lineitem", "l_linestatus", "l_suppkey", "l_returnflag", "l_extendedprice", "l_discount")
    wide = li.select(
        F.col("l_linestatus").alias("domain"),
        F.concat(F.lit("m"), (F.col("l_suppkey") % 8).cast("string")).alias("backbone"),
        (F.col("l_returnflag") == "N").alias("is_id"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
    )
    return wide.unpivot(["domain", "backbone", "is_id"], ["price", "discount"], "method", "score")


def order_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with a unique id, a score and a correctness flag, by model."""
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    wrong = (F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 7 < 3)
    return o.select(
        F.concat(F.lit("m"), (F.col("o_custkey") % 8).cast("string")).alias("model"),
        F.when(F.col("o_orderstatus") == "F", "id_selective").otherwise("ood_triage").alias("protocol"),
        F.col("o_orderkey").alias("sample_id"),
        F.col("o_custkey").alias("group_id"),
        F.col("o_totalprice").alias("score"),
        F.col("o_orderpriority").alias("priority"),
        (~wrong).alias("correct"),
    )


def event_scores(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events", "event_id", "user_id", "event_type", "value")
    return e.select(
        F.col("event_id").alias("sample_id"), "user_id", F.col("event_type").alias("stratum"), F.col("value").alias("score")
    )


# --- the same views as SQL -------------------------------------------------------------

SAMPLES_SQL = f"""
base AS (
  SELECT vec_id AS sample_id, label, vec_id % 5 AS center, (vec_id % 5) * 100 + (vec_id // 5) % 9 AS group_id,
         CASE WHEN vec_id % 5 IN (0, 3, 4) THEN CASE WHEN (vec_id // 5) % 10 = 0 THEN 'id_val' ELSE 'train' END
              WHEN vec_id % 5 = 1 THEN 'near' ELSE 'far' END AS split,
         list_transform(embedding, lambda x: CAST(x AS DOUBLE) + CASE WHEN vec_id % 5 = 2 THEN {SHIFT}::DOUBLE ELSE 0.0::DOUBLE END) AS e
  FROM embeddings),
variants(backbone, lo, hi) AS (VALUES {", ".join(f"('{b}', {lo}, {lo + n - 1})" for b, (lo, n) in BACKBONES.items())}),
samples AS (
  SELECT backbone, sample_id, label, center, group_id, split, e[lo:hi] AS feats FROM base CROSS JOIN variants)"""

LOGITS_SQL = f"""{SAMPLES_SQL},
entries AS (SELECT backbone, label, split, sample_id, unnest(feats) AS x, generate_subscripts(feats, 1) AS i FROM samples),
heads AS (
  SELECT backbone, class, list(w ORDER BY i) AS weight
  FROM (SELECT backbone, label AS class, i, {HEAD_SCALE}::DOUBLE * avg(x) AS w FROM entries WHERE split = 'train' GROUP BY ALL)
  GROUP BY ALL),
zrows AS (
  SELECT s.backbone, s.sample_id, s.label, s.center, s.group_id, s.split, h.class, list_dot_product(s.feats, h.weight) AS z
  FROM samples s JOIN heads h ON s.backbone = h.backbone),
zmax AS (SELECT *, max(z) OVER (PARTITION BY backbone, sample_id) AS zm FROM zrows),
zstat AS (
  SELECT backbone, sample_id, any_value(label) AS label, any_value(center) AS center, any_value(group_id) AS group_id,
         any_value(split) AS split, 1.0 / sum(exp(z - zm)) AS msp, max(zm) + ln(sum(exp(z - zm))) AS energy,
         sqrt(sum(z * z)) AS logit_norm, max(zm) - (sum(z) - max(zm)) / (count(*) - 1) AS logit_gap,
         min(CASE WHEN z = zm THEN class END) AS pred
  FROM zmax GROUP BY backbone, sample_id),
dom AS (
  SELECT d.domain, z.*, z.split = 'id_val' AS is_id
  FROM zstat z JOIN (VALUES ('near'), ('far')) d(domain) ON z.split = 'id_val' OR z.split = d.domain)"""

SCORES_SQL = f"""{LOGITS_SQL},
scored AS (
  SELECT domain, backbone, sample_id, label, center, group_id, split, is_id, method, score
  FROM dom UNPIVOT (score FOR method IN (msp, energy, logit_norm)))"""

BULK_SQL = """
bulk AS (
  SELECT domain, backbone, is_id, method, score
  FROM (SELECT l_linestatus AS domain, 'm' || CAST(l_suppkey % 8 AS VARCHAR) AS backbone, l_returnflag = 'N' AS is_id,
               l_extendedprice AS price, l_discount AS discount FROM lineitem)
  UNPIVOT (score FOR method IN (price, discount)))"""

ORDERS_SQL = """
scored AS (
  SELECT 'm' || CAST(o_custkey % 8 AS VARCHAR) AS model,
         CASE WHEN o_orderstatus = 'F' THEN 'id_selective' ELSE 'ood_triage' END AS protocol,
         o_orderkey AS sample_id, o_custkey AS group_id, o_totalprice AS score, o_orderpriority AS priority,
         NOT (o_orderstatus = 'P' AND o_orderkey % 7 < 3) AS correct
  FROM orders)"""

EVENTS_SQL = """
scored AS (SELECT event_id AS sample_id, user_id, event_type AS stratum, value AS score FROM events)"""


def R(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE) + {NUDGE}::DOUBLE, 6) + 0.0::DOUBLE"


def auroc_sql(src: str, keys: str, name: str = "au", w: str = "1", score: str = "score") -> str:
    """CTEs ``name``(keys, auroc, n_id, n_ood) from rows with is_id."""
    return f"""
{name}_d AS (SELECT {keys}, {score} AS s, CAST(sum(CASE WHEN is_id THEN {w} ELSE 0 END) AS DOUBLE) AS n_id,
              CAST(sum(CASE WHEN is_id THEN 0 ELSE {w} END) AS DOUBLE) AS n_ood FROM {src} GROUP BY {keys}, {score}),
{name}_c AS (SELECT *, coalesce(sum(n_ood) OVER (PARTITION BY {keys} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
              FROM {name}_d),
{name} AS (SELECT {keys}, sum(n_id * (below + 0.5::DOUBLE * n_ood)) / nullif(sum(n_id) * sum(n_ood), 0) AS auroc,
                  CAST(sum(n_id) AS BIGINT) AS n_id, CAST(sum(n_ood) AS BIGINT) AS n_ood FROM {name}_c GROUP BY {keys})"""


def sep_sql(src: str, keys: str, name: str = "sep", score: str = "score") -> str:
    """CTEs ``name``(keys, auroc, fpr95, threshold, n_id, n_ood) for unweighted rows."""
    k = [x.strip() for x in keys.split(",")]
    on = " AND ".join(f"a.{x} = b.{x}" for x in k)
    ka = ", ".join(f"a.{x}" for x in k)
    return f"""{auroc_sql(src, keys, name + "_au", score=score)},
{name}_t AS (SELECT {keys}, quantile_cont({score}, 0.05) AS threshold FROM {src} WHERE is_id GROUP BY {keys}),
{name}_f AS (SELECT {ka}, avg(CASE WHEN a.{score} > b.threshold THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS fpr95
             FROM {src} a JOIN {name}_t b ON {on} WHERE NOT a.is_id GROUP BY {ka}),
{name} AS (SELECT {keys}, auroc, fpr95, threshold, n_id, n_ood
           FROM {name}_au JOIN {name}_t USING ({keys}) JOIN {name}_f USING ({keys}))"""


def curve_sql(src: str, keys: str, name: str = "curve") -> str:
    """CTE ``name``(keys, sample_id, accepted, coverage, risk, n) from rows with correct."""
    err = "CASE WHEN correct THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END"
    return f"""
{name} AS (SELECT {keys}, sample_id, score, row_number() OVER w AS accepted,
             row_number() OVER w / CAST(count(*) OVER (PARTITION BY {keys}) AS DOUBLE) AS coverage,
             sum({err}) OVER w / row_number() OVER w AS risk, count(*) OVER (PARTITION BY {keys}) AS n,
             sum({err}) OVER (PARTITION BY {keys}) AS errors
           FROM {src} WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC, sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def coverage_sql(keys: str, targets=(0.10, 0.15, 0.20), src: str = "curve", name: str = "cov", eps: str = "1e-12", none: str = "0") -> str:
    cols = ", ".join(
        f"coalesce(max(CASE WHEN risk <= {t}::DOUBLE + {eps}::DOUBLE THEN accepted END) / CAST(max(n) AS DOUBLE), {none}) AS coverage_at_risk{round(t * 100)}"
        for t in targets
    )
    return f"""
{name} AS (SELECT {keys}, {cols}, max(errors) / max(n) AS full_risk, max(n) AS n FROM {src} GROUP BY {keys})"""


def aurc_sql(keys: str, src: str = "curve", name: str = "ar") -> str:
    k = [x.strip() for x in keys.split(",")]
    on = " AND ".join(f"c.{x} = g.{x}" for x in k)
    kg = ", ".join(f"g.{x}" for x in k)
    return f"""
{name}_g AS (SELECT {keys}, p, 1.0::DOUBLE + p * (-0.01::DOUBLE) AS c,
        greatest(1, CAST(round_even((1.0::DOUBLE + p * (-0.01::DOUBLE)) * max(n), 0) AS BIGINT)) AS accepted
        FROM {src} CROSS JOIN range(0, 91) t(p) GROUP BY {keys}, p),
{name}_r AS (SELECT {kg}, g.p, g.c, g.accepted, c.risk FROM {name}_g g JOIN {src} c ON {on} AND c.accepted = g.accepted),
{name}_s AS (SELECT *, (c - lag(c) OVER w) * (risk + lag(risk) OVER w) / 2.0::DOUBLE AS area FROM {name}_r
             WINDOW w AS (PARTITION BY {keys} ORDER BY c)),
{name} AS (SELECT {keys}, sum(area) AS aurc FROM {name}_s GROUP BY {keys})"""


def ranks_sql(src: str, rater: str, name: str = "rk", value: str = "auroc") -> str:
    return f"""
{name} AS (SELECT *, rank() OVER (PARTITION BY {rater} ORDER BY {value} DESC)
             + (count(*) OVER (PARTITION BY {rater}, {value}) - 1) / 2.0::DOUBLE AS rank,
             count(*) OVER (PARTITION BY {rater}, {value}) AS tied FROM {src})"""


def w_sql(src: str, group: str, item: str = "method", name: str = "kw") -> str:
    """Kendall's W from ranked rows (columns rank, tied)."""
    g = f"{group}, " if group else ""
    tail = f"GROUP BY {group}" if group else ""
    return f"""
{name}_i AS (SELECT {g}{item}, sum(rank) AS r, count(*) AS k, sum(tied * tied - 1) AS t FROM {src} GROUP BY {g}{item}),
{name}_g AS (SELECT {g}CAST(max(k) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n, sum(r * r) - sum(r) * sum(r) / count(*) AS s,
             CAST(sum(t) AS DOUBLE) AS t FROM {name}_i {tail}),
{name} AS (SELECT {g}CAST(k AS BIGINT) AS n_raters, CAST(n AS BIGINT) AS n_items,
             CASE WHEN k >= 2 AND n >= 2 AND k * k * (n * n * n - n) - k * t > 0
                  THEN 12.0::DOUBLE * s / (k * k * (n * n * n - n) - k * t) END AS kendall_w, k AS k_, n AS n_ FROM {name}_g)"""


# --- a zoo of 8 models x 5 methods over all line items ----------------------------------

ZOO_METHODS = ("msp", "energy", "logit_norm", "mahalanobis", "knn")
MODELS = [f"m{i}" for i in range(8)]
BASELINE = ["m0", "m1"]
FAMILY = ["m2", "m3"]
ORIGINALS = ["m0", "m1", "m2"]


def zoo_scores(spark: SparkSession, sf: str) -> DataFrame:
    """(domain, backbone, seed, is_id, method, score): model-dependent separation, two domains."""
    li = table(
        spark, sf, "lineitem", "l_linestatus", "l_suppkey", "l_partkey", "l_linenumber", "l_returnflag", "l_extendedprice",
        "l_quantity", "l_tax", "l_discount",
    )
    m = F.col("l_suppkey") % 8
    is_id = F.col("l_returnflag") == "N"
    lift = F.when(is_id, F.when(F.col("l_linestatus") == "F", F.lit(1.0)).otherwise(F.lit(0.5))).otherwise(F.lit(0.0))
    wide = li.select(
        F.col("l_linestatus").alias("domain"),
        F.concat(F.lit("m"), m.cast("string")).alias("backbone"),
        (F.col("l_linenumber") % 5).alias("seed"),
        is_id.alias("is_id"),
        (F.col("l_extendedprice") * (F.lit(1.0) + F.lit(0.12) * m * lift)).alias("msp"),
        (F.col("l_quantity") * (F.lit(1.0) + F.lit(0.08) * ((m * 3) % 8) * lift)).alias("energy"),
        (F.col("l_tax") + F.lit(0.01) * ((m * 5) % 8) * lift).alias("logit_norm"),
        (F.col("l_discount") + F.lit(0.02) * (F.lit(7) - m) * lift).alias("mahalanobis"),
        ((F.col("l_partkey") % 97) + F.lit(4.0) * ((m * 2) % 8) * lift).alias("knn"),
    )
    return wide.unpivot(["domain", "backbone", "seed", "is_id"], list(ZOO_METHODS), "method", "score")


ZOO_SQL = """
zoo_l AS (SELECT *, l_suppkey % 8 AS m, l_returnflag = 'N' AS is_id,
            CASE WHEN l_returnflag = 'N' THEN CASE WHEN l_linestatus = 'F' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END ELSE 0.0::DOUBLE END AS lift FROM lineitem),
zoo_w AS (SELECT l_linestatus AS domain, 'm' || CAST(m AS VARCHAR) AS backbone, l_linenumber % 5 AS seed, is_id,
            l_extendedprice * (1.0::DOUBLE + 0.12::DOUBLE * m * lift) AS msp,
            l_quantity * (1.0::DOUBLE + 0.08::DOUBLE * ((m * 3) % 8) * lift) AS energy,
            l_tax + 0.01::DOUBLE * ((m * 5) % 8) * lift AS logit_norm,
            l_discount + 0.02::DOUBLE * (7 - m) * lift AS mahalanobis,
            CAST(l_partkey % 97 AS DOUBLE) + 4.0::DOUBLE * ((m * 2) % 8) * lift AS knn FROM zoo_l),
zoo AS (SELECT * FROM zoo_w UNPIVOT (score FOR method IN (msp, energy, logit_norm, mahalanobis, knn)))"""


def in_list(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"
