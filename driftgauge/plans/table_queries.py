"""Labels, joins, set operations, group tables and crop manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftgauge.functions import labels as L
from driftgauge.functions import scores as S
from driftgauge.operators import calibration, manifest, tables
from driftgauge.operators.correlation import spearman
from driftgauge.operators.ordered import union_all
from driftgauge.operators.ranks import spread_wide
from driftgauge.plans import views as v
from driftgauge.plans.rank_queries import CELLS_SQL, cells
from driftgauge.plans.registry import query
from driftgauge.plans.views import R, r6, rounded
from driftgauge.session import cut_lineage

# --- label and name mapping ----------------------------------------------------------------

_CODES = list(L.DIAGNOSIS_LABELS)


@query(
    "one_hot_to_binary",
    """SELECT p_partkey AS image, CASE WHEN (p_size % 5 = 0)::INT + (p_size % 7 = 0)::INT + (p_size % 11 = 0)::INT > 0 THEN 1 ELSE 0 END AS binary_label FROM part""",
)
def one_hot_to_binary(spark, sf):
    p = v.table(spark, sf, "part", "p_partkey", "p_size")
    hot = p.withColumns({c: (F.col("p_size") % m == 0).cast("double") for c, m in zip(L.MALIGNANT_ONE_HOT, (5, 7, 11))})
    return hot.select(F.col("p_partkey").alias("image"), L.any_positive(L.MALIGNANT_ONE_HOT).alias("binary_label"))


@query(
    "coded_label_counts",
    f"""WITH c AS (SELECT CASE p_size % 6 {" ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CODES))} END AS diagnostic FROM part)
SELECT diagnostic, CASE WHEN diagnostic IN {v.in_list([c for c, y in L.DIAGNOSIS_LABELS.items() if y])} THEN 1 ELSE 0 END AS label, count(*) AS n FROM c GROUP BY ALL""",
)
def coded_label_counts(spark, sf):
    """Codes with stray blanks and case map to labels; an unknown code stops the job."""
    p = v.table(spark, sf, "part", "p_size")
    code = F.element_at(F.array(*[F.lit(c) for c in _CODES]), (F.col("p_size") % 6 + 1).cast("int"))
    rows = p.select(code.alias("diagnostic"), L.code_label(F.concat(F.lit(" "), F.lower(code), F.lit(" "))).alias("label"))
    return tables.group_counts(rows, ["diagnostic", "label"])


@query(
    "image_names",
    """SELECT page_id, CASE WHEN regexp_matches(lower(url), '\\.(png|jpg|jpeg)$') THEN url ELSE url || '.png' END AS image FROM pages""",
)
def image_names(spark, sf):
    return v.table(spark, sf, "pages", "page_id", "url").select("page_id", L.with_extension(F.col("url")).alias("image"))


@query(
    "image_names_png_only",
    """SELECT page_id, CASE WHEN lower(name) LIKE '%.png' THEN name ELSE name || '.png' END AS image
FROM (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpg' ELSE '' END AS name FROM pages)""",
)
def image_names_png_only(spark, sf):
    """The coded table's rule: only PNG counts as an image name."""
    p = v.table(spark, sf, "pages", "page_id", "url")
    tail = F.when(F.col("page_id") % 3 == 0, ".PNG").when(F.col("page_id") % 3 == 1, ".jpg").otherwise("")
    return p.select("page_id", L.with_extension(F.concat("url", tail), known=(".png",)).alias("image"))


@query(
    "source_flags",
    """SELECT source, CASE WHEN regexp_matches(source, '(?i)PAD|UFES|ood') THEN 'OOD' ELSE 'ID' END AS flag, count(*) AS n
FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'Pad-' || source WHEN doc_id % 3 = 1 THEN source || '-OOD' ELSE source END AS source FROM documents) GROUP BY ALL""",
)
def source_flags(spark, sf):
    d = v.table(spark, sf, "documents", "doc_id", "source")
    name = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Pad-"), "source"))
        .when(F.col("doc_id") % 3 == 1, F.concat("source", F.lit("-OOD")))
        .otherwise(F.col("source"))
    )
    rows = d.select(name.alias("source"))
    return tables.group_counts(rows.withColumn("flag", L.source_flag(F.col("source"))), ["source", "flag"])


@query(
    "truth_labels",
    f"""SELECT doc_id, CASE WHEN lower(trim(CAST(quality AS VARCHAR))) IN {v.in_list(L.MALIGNANT_WORDS)} THEN 'malignant' ELSE 'benign' END AS gt_label FROM labels""",
)
def truth_labels(spark, sf):
    """Text label from whichever of the candidate columns the table has."""
    rows = v.table(spark, sf, "labels").withColumnRenamed("quality", "target")
    return rows.select("doc_id", L.truth_label(L.pick_column(rows, "gt_label", "label", "target")).alias("gt_label"))


@query(
    "display_names",
    f"""WITH {CELLS_SQL}, d(method, display) AS (VALUES {", ".join(f"('{k}', '{x}')" for k, x in L.METHOD_DISPLAY.items())})
SELECT domain, backbone, method, coalesce(display, 'unknown') AS display FROM cells LEFT JOIN d USING (method)""",
)
def display_names(spark, sf):
    out = tables.with_registry(cells(spark, sf).drop("auroc"), L.METHOD_DISPLAY, "method", "display")
    return out.select("domain", "backbone", "method", "display")


@query(
    "input_mismatch",
    """SELECT p_type AS domain, p_partkey, round(224 / CAST(p_size AS DOUBLE), 3) AS upsample_factor, CASE WHEN p_type IN ('SMALL') THEN 'severe' ELSE 'moderate' END AS mismatch_severity FROM part""",
)
def input_mismatch(spark, sf):
    p = v.table(spark, sf, "part", "p_partkey", "p_type", "p_size")
    return p.select(
        F.col("p_type").alias("domain"),
        "p_partkey",
        L.upsample_factor(F.lit(224), F.col("p_size")).alias("upsample_factor"),
        L.mismatch_severity(F.col("p_type"), ("SMALL",)).alias("mismatch_severity"),
    )


@query(
    "severity_slices",
    """WITH s AS (SELECT o_orderkey AS idx, o_orderpriority AS corruption, CAST(o_orderkey // 1000 + 1 AS INTEGER) AS severity FROM orders)
SELECT corruption, severity, count(*) AS n, min(corruption || '/s' || severity || '/' || lpad(CAST(idx AS VARCHAR), CAST(greatest(5, length(CAST(idx AS VARCHAR))) AS INTEGER), '0')) AS first_key FROM s GROUP BY ALL""",
)
def severity_slices(spark, sf):
    """Severity from the position in a stack of equal slices, with a path key per row."""
    o = v.table(spark, sf, "orders", "o_orderkey", "o_orderpriority").toDF("idx", "corruption")
    rows = o.withColumn("severity", L.slice_severity(F.col("idx"), 1000))
    keyed = rows.withColumn("key", L.sweep_key(F.col("corruption"), F.col("severity"), F.col("idx")))
    return keyed.groupBy("corruption", "severity").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key"))


@query(
    "predicted_confidence",
    f"""SELECT o_orderkey AS case_no, {R("CASE WHEN o_orderstatus = 'F' THEN p ELSE 1.0::DOUBLE - p END")} AS ai_prob_pred FROM (SELECT *, (o_orderkey % 101) / 100.0::DOUBLE AS p FROM orders)""",
)
def predicted_confidence(spark, sf):
    o = v.table(spark, sf, "orders", "o_orderkey", "o_orderstatus")
    p = (F.col("o_orderkey") % 101) / F.lit(100.0)
    return o.select(F.col("o_orderkey").alias("case_no"), r6(S.predicted_confidence(F.col("o_orderstatus"), p, "F")).alias("ai_prob_pred"))


# --- joins ---------------------------------------------------------------------------------


@query(
    "anti_join_external",
    """SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def anti_join_external(spark, sf):
    """External rows whose id is not in the training table."""
    d = v.table(spark, sf, "documents", "doc_id", "lang", "source")
    return d.join(v.table(spark, sf, "labels", "doc_id"), "doc_id", "left_anti")


@query(
    "aligned_join",
    """SELECT l.doc_id, quality, lang FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
)
def aligned_join(spark, sf):
    """Equi-join on the sample key; a missing partner or a shared column that disagrees stops the job."""
    lab = v.table(spark, sf, "labels", "doc_id", "quality").withColumn("parity", F.col("doc_id") % 2)
    doc = v.table(spark, sf, "documents", "doc_id", "lang").withColumn("parity", F.col("doc_id") % 2)
    doc = doc.join(lab.select("doc_id"), "doc_id", "left_semi")
    return tables.aligned_join(lab, doc, "doc_id", "parity").select("doc_id", "quality", "lang")


@query(
    "exactly_one_lookup",
    """SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def exactly_one_lookup(spark, sf):
    """Lookups that must match exactly one row, or the job stops."""
    nation = v.table(spark, sf, "nation").toDF("n_key", "n_name", "r_key")
    region = v.table(spark, sf, "region").toDF("r_key", "r_name")
    c = v.table(spark, sf, "customer", "c_custkey", F.col("c_nationkey").alias("n_key"))
    return tables.exactly_one(tables.exactly_one(c, nation, ["n_key"]), region, ["r_key"]).select("c_custkey", "n_name", "r_name")


@query(
    "domain_scalar_lookup",
    f"""WITH {CELLS_SQL}, f AS (SELECT l_linestatus AS domain, avg(l_tax) AS fid_score FROM lineitem GROUP BY 1)
SELECT c.domain, backbone, method, {R("auroc")} AS auroc, {R("fid_score")} AS fid_score FROM cells c JOIN f ON c.domain = f.domain""",
)
def domain_scalar_lookup(spark, sf):
    fid = v.table(spark, sf, "lineitem", "l_linestatus", "l_tax").groupBy(F.col("l_linestatus").alias("domain")).agg(F.avg("l_tax").alias("fid_score"))
    return rounded(cells(spark, sf).join(fid, "domain"), "auroc", "fid_score").select("domain", "backbone", "method", "auroc", "fid_score")


@query(
    "gap_correlation_table",
    f"""WITH {v.LOGITS_SQL}, b AS (SELECT domain, backbone, 1 + {" + ".join(f"CASE WHEN msp > {i * (1.0 / 15)!r}::DOUBLE THEN 1 ELSE 0 END" for i in range(1, 15))} AS bin, msp, pred = label AS hit, logit_gap FROM dom WHERE is_id),
e AS (SELECT domain, backbone, sum(abs(c - a) * n) / sum(n) AS ece FROM (SELECT domain, backbone, bin, count(*) AS n, avg(msp) AS c, avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS a FROM b GROUP BY ALL) GROUP BY ALL),
g AS (SELECT domain, backbone, avg(logit_gap) FILTER (NOT is_id) - avg(logit_gap) FILTER (is_id) AS gap FROM dom GROUP BY ALL),
j AS (SELECT e.domain, rank() OVER (PARTITION BY e.domain ORDER BY ece) + (count(*) OVER (PARTITION BY e.domain, ece) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY e.domain ORDER BY gap) + (count(*) OVER (PARTITION BY e.domain, gap) - 1) / 2.0::DOUBLE AS b FROM e JOIN g ON e.domain = g.domain AND e.backbone = g.backbone)
SELECT domain, {R("corr(a, b)")} AS rho, count(*) AS n FROM j GROUP BY domain""",
)
def gap_correlation_table(spark, sf):
    """Calibration error joined to the gap table, then rank correlation per domain."""
    z = F.col("logits")
    rows = cut_lineage(
        v.by_domain(v.with_logits(spark, sf)).select(
            "domain", "backbone", "is_id", S.msp(z).alias("conf"), S.correct(z, F.col("label")).alias("hit"), S.logit_gap(z).alias("gap")
        )
    )
    keys = ["domain", "backbone"]
    e = calibration.ece(rows.where("is_id"), keys, "conf", "hit").drop("n")
    g = rows.groupBy(*keys).agg((F.avg(F.when(~F.col("is_id"), F.col("gap"))) - F.avg(F.when(F.col("is_id"), F.col("gap")))).alias("gap"))
    return rounded(spearman(tables.exactly_one(e, g, keys), ["domain"], "ece", "gap"), "rho")


# --- set operations ------------------------------------------------------------------------


@query(
    "upsert_summary",
    """WITH old AS (SELECT n_nationkey AS backbone, CAST(n_regionkey AS BIGINT) AS value, NULL::VARCHAR AS arch FROM nation),
new AS (SELECT CAST(s_nationkey + 5 AS INTEGER) AS backbone, count(*) AS value, 'new' AS arch FROM supplier GROUP BY s_nationkey)
SELECT * FROM old WHERE backbone NOT IN (SELECT backbone FROM new) UNION ALL SELECT * FROM new""",
)
def upsert_summary(spark, sf):
    """Rows of the new batch replace old rows with the same key; old rows lack a column."""
    old = v.table(spark, sf, "nation").select(F.col("n_nationkey").alias("backbone"), F.col("n_regionkey").cast("bigint").alias("value"))
    new = (
        v.table(spark, sf, "supplier", "s_nationkey").groupBy((F.col("s_nationkey") + 5).alias("backbone"))
        .agg(F.count(F.lit(1)).alias("value")).withColumn("arch", F.lit("new"))
    )
    return tables.upsert(old, new, ["backbone"])


@query(
    "union_first_wins",
    """WITH u AS (SELECT o_custkey AS k, max(o_totalprice) AS x, 0 AS src FROM orders WHERE o_orderstatus = 'F' GROUP BY 1
 UNION ALL SELECT o_custkey, max(o_totalprice), 1 FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, c_acctbal, 2 FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY src) AS rn FROM u) SELECT k, x FROM r WHERE rn = 1""",
)
def union_first_wins(spark, sf):
    """Union of three sources, first source wins per key."""
    o = v.table(spark, sf, "orders", "o_custkey", "o_orderstatus", "o_totalprice")
    best = lambda d: d.groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("x"))
    c = v.table(spark, sf, "customer", F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"))
    return tables.first_wins([best(o.where("o_orderstatus = 'F'")), best(o), c], ["k"])


@query(
    "union_missing_columns",
    """SELECT 'events' AS src, event_type AS grp, count(*) AS n, NULL::DOUBLE AS mean_price FROM events GROUP BY event_type
UNION ALL SELECT 'orders', o_orderpriority, count(*), round(avg(o_totalprice) + 1e-10::DOUBLE, 6) + 0.0::DOUBLE FROM orders GROUP BY o_orderpriority""",
)
def union_missing_columns(spark, sf):
    e = v.table(spark, sf, "events", "event_type").groupBy(F.col("event_type").alias("grp")).agg(F.count(F.lit(1)).alias("n")).withColumn("src", F.lit("events"))
    o = v.table(spark, sf, "orders", "o_orderpriority", "o_totalprice").groupBy(F.col("o_orderpriority").alias("grp")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("o_totalprice")).alias("mean_price")
    ).withColumn("src", F.lit("orders"))
    return union_all([e, o]).select("src", "grp", "n", "mean_price")


@query(
    "precedence_merge",
    f"""WITH {CELLS_SQL} SELECT domain, backbone, method, {R("CASE WHEN backbone IN ('m0', 'm2') THEN auroc ELSE round(auroc, 2) END")} AS auroc FROM cells""",
)
def precedence_merge(spark, sf):
    """A wide seed table (rounded values) overridden by per-backbone tables."""
    c = cells(spark, sf)
    seed = spread_wide(c.withColumn("auroc", F.round("auroc", 2)), v.MODELS)
    long = tables.unpivot_prefixed(seed, ["domain", "method"], "auroc_", "backbone", "auroc", {})
    fresh = c.where("backbone in ('m0', 'm2')")
    out = tables.first_wins([fresh, long], ["domain", "backbone", "method"])
    return rounded(out, "auroc").select("domain", "backbone", "method", "auroc")


@query(
    "protocol_table",
    f"""WITH {CELLS_SQL}, f AS (SELECT l_linestatus AS domain, avg(l_tax) AS fid_score FROM lineitem GROUP BY 1),
w AS (SELECT domain, backbone, max(CASE WHEN method = 'mahalanobis' THEN auroc END) - max(CASE WHEN method = 'msp' THEN auroc END) AS delta FROM cells GROUP BY ALL)
SELECT w.domain, backbone, CASE WHEN w.domain = 'F' THEN 'full_train' WHEN backbone = 'm1' THEN 'frozen' ELSE 'trained' END AS train_protocol, {R("fid_score")} AS fid_score, {R("delta")} AS delta_auroc FROM w JOIN f ON w.domain = f.domain""",
)
def protocol_table(spark, sf):
    """Covariate table: guarded union of two domains with derived protocol labels."""
    c = cells(spark, sf)
    pick = lambda m: F.max(F.when(F.col("method") == m, F.col("auroc")))
    wide = cut_lineage(c.groupBy("domain", "backbone").agg((pick("mahalanobis") - pick("msp")).alias("delta_auroc")).withColumn("train_frac", F.lit(1.0)))
    full = tables.require_rows(wide.where("domain = 'F'"), "domain F", ("backbone", 3))
    full = tables.guard(full, F.abs(F.col("train_frac") - 1.0) <= 1e-9, "train fraction is not 1").withColumn("train_protocol", F.lit("full_train"))
    other = tables.require_rows(wide.where("domain = 'O'"), "domain O").withColumn(
        "train_protocol", F.when(F.col("backbone") == "m1", "frozen").otherwise("trained")
    )
    fid = v.table(spark, sf, "lineitem", "l_linestatus", "l_tax").groupBy(F.col("l_linestatus").alias("domain")).agg(F.avg("l_tax").alias("fid_score"))
    out = union_all([full, other]).join(fid, "domain")
    return rounded(out, "fid_score", "delta_auroc").select("domain", "backbone", "train_protocol", "fid_score", "delta_auroc")


# --- group tables --------------------------------------------------------------------------


@query(
    "group_counts",
    """SELECT o_orderstatus AS split, o_orderpriority AS center, count(*) AS n FROM orders GROUP BY ALL""",
)
def group_counts(spark, sf):
    o = v.table(spark, sf, "orders", F.col("o_orderstatus").alias("split"), F.col("o_orderpriority").alias("center"))
    return tables.group_counts(o, ["split", "center"])


@query(
    "split_summary",
    f"""WITH {v.SAMPLES_SQL} SELECT split, count(*) AS n, array_to_string(list_sort(list(DISTINCT center)), ',') AS centers FROM samples GROUP BY split""",
)
def split_summary(spark, sf):
    return tables.split_summary(v.samples(spark, sf), "split", "center")


@query(
    "group_profile",
    """SELECT user_id AS patient, array_to_string(list_sort(list(DISTINCT event_type)), ' ') AS items, count(*) AS n,
  round(avg(CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS label_frac FROM events GROUP BY user_id""",
)
def group_profile(spark, sf):
    e = v.table(spark, sf, "events", F.col("user_id").alias("patient"), F.col("event_type").alias("item"), (F.col("value") > 50).cast("int").alias("label"))
    return tables.group_profile(e, "patient", "item", "label")


@query(
    "min_max_mean",
    f"""WITH {CELLS_SQL} SELECT domain, {R("avg(auroc)")} AS mean, {R("min(auroc)")} AS min, {R("max(auroc)")} AS max FROM cells GROUP BY domain""",
)
def min_max_mean(spark, sf):
    out = cells(spark, sf).groupBy("domain").agg(F.avg("auroc").alias("mean"), F.min("auroc").alias("min"), F.max("auroc").alias("max"))
    return rounded(out, "mean", "min", "max")


@query(
    "channel_shift",
    f"""WITH {v.SAMPLES_SQL}, e AS (SELECT backbone, split, unnest(feats) AS x, generate_subscripts(feats, 1) - 1 AS i FROM samples WHERE split <> 'train'),
c AS (SELECT domain, backbone, i // 16 AS layer, i % 16 AS channel, avg(x) FILTER (split = 'id_val') AS a, avg(x) FILTER (split = domain) AS b FROM e CROSS JOIN (VALUES ('near'), ('far')) d(domain) GROUP BY ALL),
l AS (SELECT domain, backbone, layer, sqrt(avg((b - a) * (b - a))) / sqrt(avg(a * a) + 1e-12::DOUBLE) AS s FROM c GROUP BY ALL)
SELECT domain, backbone, {R("avg(s)")} AS bn_shift, count(*) AS n_bn_layers FROM l GROUP BY ALL""",
)
def channel_shift(spark, sf):
    """Partial sums per (split, layer, channel) to the layer-averaged standardised shift."""
    side = F.when(F.col("is_id"), "ID").otherwise("OOD")
    flat = v.by_domain(v.samples(spark, sf)).select("domain", "backbone", side.alias("split"), F.posexplode("feats").alias("i", "x"))
    sums = flat.groupBy("domain", "backbone", "split", F.floor(F.col("i") / 16).alias("layer"), (F.col("i") % 16).alias("channel")).agg(
        F.sum("x").alias("sum"), F.count(F.lit(1)).cast("double").alias("n")
    )
    return rounded(tables.channel_shift(sums, ["domain", "backbone"]), "bn_shift")


# --- crop manifest -------------------------------------------------------------------------

_BOX_SQL = """
ann AS (SELECT o_custkey AS image_id, o_orderkey AS ann_id, CAST(o_orderkey % 2 + 1 AS INTEGER) AS category_id, CAST(o_orderkey * 37 % 900 AS INTEGER) AS x0, CAST(o_orderkey * 53 % 300 AS INTEGER) AS y0,
   CAST(o_orderkey * 37 % 900 AS INTEGER) + s AS x1, CAST(o_orderkey * 53 % 300 AS INTEGER) + s AS y1 FROM (SELECT *, CASE WHEN o_orderkey % 10 = 0 THEN 60 ELSE 50 END AS s FROM orders)),
box AS (SELECT * FROM ann WHERE x1 - x0 = 50 AND y1 - y0 = 50),
cand AS (SELECT image_id, ann_id, x0 + 100 AS x0, y0, x1 + 100 AS x1, y1 FROM box WHERE x0 + 100 >= 0 AND y0 >= 0 AND x1 + 100 < 1000 AND y1 < 340),
back AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM ann a WHERE a.image_id = c.image_id AND ((a.x0 < c.x0 AND c.x0 < a.x1 AND a.y0 < c.y0 AND c.y0 < a.y1) OR (a.x0 < c.x1 AND c.x1 < a.x1 AND a.y0 < c.y1 AND c.y1 < a.y1)))),
man AS (SELECT image_id, ann_id, category_id, x0, y0, x1, y1 FROM box UNION ALL SELECT image_id, ann_id, 0, x0, y0, x1, y1 FROM back)"""


def annotations(spark, sf):
    o = v.table(spark, sf, "orders", "o_custkey", "o_orderkey")
    s = F.when(F.col("o_orderkey") % 10 == 0, 60).otherwise(50)
    x0, y0 = (F.col("o_orderkey") * 37 % 900).cast("int"), (F.col("o_orderkey") * 53 % 300).cast("int")
    ann = o.select(
        F.col("o_custkey").alias("image_id"), F.col("o_orderkey").alias("ann_id"), (F.col("o_orderkey") % 2 + 1).cast("int").alias("category_id"),
        x0.alias("x0"), y0.alias("y0"), (x0 + s).alias("x1"), (y0 + s).alias("y1"),
    )
    images = o.select(F.col("o_custkey").alias("image_id")).distinct().withColumns({"width": F.lit(1000), "height": F.lit(340)})
    return images, ann


@query(
    "crop_manifest",
    f"""WITH {_BOX_SQL} SELECT image_id, ann_id, category_id, x0, y0, x1, y1, lpad(CAST(image_id AS VARCHAR), CAST(greatest(3, length(CAST(image_id AS VARCHAR))) AS INTEGER), '0') || '_' || ann_id || '_' || category_id || '.tiff' AS path FROM man""",
)
def crop_manifest(spark, sf):
    """Foreground boxes and the background boxes that touch no annotation."""
    images, ann = annotations(spark, sf)
    return manifest.crop_manifest(images, ann)


@query(
    "background_rejections",
    f"""WITH {_BOX_SQL} SELECT (SELECT count(*) FROM box) AS n_boxes, (SELECT count(*) FROM cand) AS n_inside, (SELECT count(*) FROM back) AS n_kept""",
)
def background_rejections(spark, sf):
    images, ann = annotations(spark, sf)
    boxes = manifest.square_boxes(ann)
    cand = cut_lineage(manifest.background_candidates(boxes, images))
    kept = manifest.without_touching(cand, ann)
    inside, left = (d.agg(F.count(F.lit(1))).scalar() for d in (cand, kept))
    return boxes.agg(F.count(F.lit(1)).alias("n_boxes")).withColumns({"n_inside": inside, "n_kept": left})
