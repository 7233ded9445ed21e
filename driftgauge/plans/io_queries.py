"""Round trips through the sinks and scans, on tables Spark derives from the given ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftgauge import schemas
from driftgauge.operators import tables
from driftgauge.plans import views as v
from driftgauge.plans.rank_queries import CELLS_SQL, cells
from driftgauge.plans.registry import query
from driftgauge.plans.table_queries import _BOX_SQL, annotations
from driftgauge.plans.views import R, rounded
from driftgauge.session import scratch_path
from driftgauge.sources import readers, writers


def _bundle(spark, sf):
    return v.with_logits(spark, sf).select(
        F.lit("vectors").alias("domain"), "backbone", F.lit(42).alias("seed"), "split", "sample_id",
        F.col("group_id").cast("string").alias("group_id"), "label", "logits", "feats",
    )


@query(
    "feature_bundle_roundtrip",
    f"""WITH {v.SAMPLES_SQL} SELECT backbone, split, count(*) AS n, {R("sum(list_sum(feats))")} AS total FROM samples WHERE backbone = 'b32' AND split = 'far' GROUP BY ALL""",
)
def feature_bundle_roundtrip(spark, sf):
    """Write bundles by cell, read one cell back (partition pruning, two columns)."""
    path = scratch_path(spark, "bundle")
    writers.write_samples(_bundle(spark, sf), path)
    back = readers.read_samples(spark, path, ["backbone", "split", "feats"], backbone="b32", split="far")
    total = F.sum(F.aggregate("feats", F.lit(0.0), lambda a, x: a + x)).alias("total")
    return rounded(back.groupBy("backbone", "split").agg(F.count(F.lit(1)).alias("n"), total), "total")


@query(
    "score_table_glob",
    f"""WITH {CELLS_SQL} SELECT domain, CASE backbone WHEN 'm0' THEN 'resnet18' WHEN 'm1' THEN 'efficientnet_v2_s' WHEN 'm2' THEN 'densenet121' END AS backbone, method, {R("auroc")} AS auroc
FROM cells WHERE backbone IN ('m0', 'm1', 'm2')""",
)
def score_table_glob(spark, sf):
    """Per-backbone score CSVs, a folder per domain; keys come from the paths, variants are dropped."""
    path = scratch_path(spark, "scores")
    stems = {"m0": "resnet18", "m1": "efficientnet_v2_s_224", "m2": "densenet121", "m3": "resnet18_supcon", "m4": "vit_b_16", "m5": "effb3_224", "m6": "convnext_192", "m7": "efficientnet_v2_s"}
    stem = F.create_map(*[F.lit(x) for kv in stems.items() for x in kv])[F.col("backbone")]
    null = F.lit(None).cast("double")
    parts = cells(spark, sf).select(
        "domain", F.concat(stem, F.lit("_score_comparison.csv")).alias("file"), F.col("method").alias("Method"), F.col("auroc").alias("AUROC"),
        null.alias("FPR95"), null.alias("Threshold"), null.alias("AUROC_CI_low"), null.alias("AUROC_CI_high"),
        null.alias("FPR95_CI_low"), null.alias("FPR95_CI_high"),
    )
    writers.write_csv(parts, path, ["domain", "file"])
    scans = [readers.scan_score_tables(spark, f"{path}/domain={d}/file=*_score_comparison.csv", d) for d in ("F", "O")]
    return rounded(scans[0].unionByName(scans[1]).select("domain", "backbone", "method", "auroc"), "auroc")


@query(
    "csv_roundtrip",
    f"""SELECT l_linestatus AS backbone, CAST(l_linenumber AS INTEGER) AS epoch, {R("avg(l_tax)")} AS msp_auroc, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def csv_roundtrip(spark, sf):
    """Epoch log through the CSV sink and back under its declared schema."""
    li = v.table(spark, sf, "lineitem", "l_linestatus", "l_linenumber", "l_tax", "l_quantity")
    log = li.select(
        F.col("l_linestatus").alias("backbone"), F.lit(42).alias("seed"), F.col("l_linenumber").alias("epoch"),
        F.col("l_quantity").alias("id_val_acc"), F.col("l_tax").alias("msp_auroc"),
    )
    path = scratch_path(spark, "epochs")
    writers.write_csv(log, path)
    back = readers.read_csv(spark, path, schemas.EPOCH_LOG)
    return rounded(back.groupBy("backbone", "epoch").agg(F.avg("msp_auroc").alias("msp_auroc"), F.count(F.lit(1)).alias("n")), "msp_auroc")


@query(
    "center_metadata_scan",
    """SELECT lpad(CAST(o_custkey AS VARCHAR), CAST(greatest(5, length(CAST(o_custkey AS VARCHAR))) AS INTEGER), '0') AS patient, count(*) AS n, CAST(sum((o_orderstatus = 'F')::INT) AS BIGINT) AS tumors FROM orders WHERE o_custkey % 5 = 2 GROUP BY 1""",
)
def center_metadata_scan(spark, sf):
    """Metadata CSV with text patient ids, filtered to one center."""
    o = v.table(spark, sf, "orders", "o_custkey", "o_orderkey", "o_orderstatus")
    meta = o.select(
        F.format_string("%05d", "o_custkey").alias("patient"), (F.col("o_orderkey") % 50).cast("int").alias("slide"),
        (F.col("o_custkey") % 5).cast("int").alias("center"), (F.col("o_orderstatus") == "F").cast("int").alias("tumor"), F.lit(0).alias("split"),
    )
    path = scratch_path(spark, "metadata")
    writers.write_csv(meta, path)
    rows = readers.read_group_metadata(spark, path, 2)
    return rows.groupBy("patient").agg(F.count(F.lit(1)).alias("n"), F.sum("tumor").alias("tumors"))


@query(
    "image_list_scan",
    """SELECT doc_id % 3 AS label, count(*) AS n FROM documents GROUP BY ALL""",
)
def image_list_scan(spark, sf):
    """``relpath label`` lines, blank lines skipped."""
    d = v.table(spark, sf, "documents", "doc_id")
    line = F.concat(F.lit("img/"), F.col("doc_id").cast("string"), F.lit(".png "), (F.col("doc_id") % 3).cast("string"))
    lines = d.select(F.explode(F.array(line, F.lit(""))).alias("value"))
    path = scratch_path(spark, "imglist")
    lines.write.text(path)
    rows = readers.read_image_list(spark, path)
    return rows.groupBy(F.col("label").cast("bigint").alias("label")).agg(F.count_distinct("path").alias("n"))


@query(
    "annotation_json_scan",
    f"""WITH {_BOX_SQL} SELECT a.image_id, 'img' || a.image_id || '.tiff' AS file_name, count(*) AS n_boxes, CAST(sum(x1 - x0) AS BIGINT) AS total_width FROM ann a GROUP BY a.image_id""",
)
def annotation_json_scan(spark, sf):
    """Nested image / annotation JSON documents, exploded and joined on the image."""
    images, ann = annotations(spark, sf)
    box = F.struct(
        F.col("ann_id").alias("id"), "image_id", "category_id", F.array("x0", "y0", "x1", "y1").alias("bbox")
    )
    img = F.struct(
        F.col("image_id").alias("id"), F.concat(F.lit("img"), F.col("image_id").cast("string"), F.lit(".tiff")).alias("file_name"), "width", "height"
    )
    # one document per annotation: no document grows with a crowded image
    docs = ann.join(images, "image_id").select(
        F.to_json(F.struct(F.array(img).alias("images"), F.array(box).alias("annotations"))).alias("value")
    )
    path = scratch_path(spark, "annotations")
    docs.write.text(path)
    doc_images, boxes = readers.read_annotations(spark, path, multi_line=False)
    return boxes.join(doc_images.distinct(), "image_id").groupBy("image_id", "file_name").agg(
        F.count(F.lit(1)).alias("n_boxes"), F.sum(F.col("x1") - F.col("x0")).alias("total_width")
    )


@query(
    "train_meta_scan",
    f"""WITH a AS (SELECT 'm' || CAST(l_suppkey % 8 AS VARCHAR) AS backbone, avg(l_discount) AS acc FROM lineitem WHERE l_suppkey % 8 < 3 GROUP BY 1)
SELECT n.backbone, {R("acc")} AS id_acc FROM (SELECT DISTINCT 'm' || CAST(l_suppkey % 8 AS VARCHAR) AS backbone FROM lineitem) n LEFT JOIN a ON n.backbone = a.backbone""",
)
def train_meta_scan(spark, sf):
    """Small JSON side files per backbone; a missing file reads as NULL."""
    li = v.table(spark, sf, "lineitem", "l_suppkey", "l_discount")
    acc = li.groupBy(F.concat(F.lit("m"), (F.col("l_suppkey") % 8).cast("string")).alias("backbone")).agg(F.avg("l_discount").alias("best_id_val_acc"))
    path = scratch_path(spark, "meta")
    some = acc.where(F.col("backbone").isin("m0", "m1", "m2"))  # the other backbones have no side file
    named = some.select(F.concat("backbone", F.lit("_train_meta.json")).alias("file"), "best_id_val_acc")
    writers.write_verdict(named, path, ["file"])
    meta = readers.read_train_meta(spark, f"{path}/file=*_train_meta.json")
    return rounded(acc.select("backbone").join(meta, "backbone", "left"), "id_acc")


@query(
    "verdict_json_sink",
    """SELECT o_orderpriority AS cell, count(*) AS n, CASE WHEN avg(o_totalprice) > 250000 THEN 'high' ELSE 'low' END AS verdict FROM orders GROUP BY 1""",
)
def verdict_json_sink(spark, sf):
    """Verdict rows as JSON lines and back."""
    o = v.table(spark, sf, "orders", "o_orderpriority", "o_totalprice")
    rows = o.groupBy(F.col("o_orderpriority").alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.when(F.avg("o_totalprice") > 250000, "high").otherwise("low").alias("verdict")
    )
    path = scratch_path(spark, "verdict")
    writers.write_verdict(rows, path)
    return spark.read.schema("cell string, n bigint, verdict string").json(path)


@query(
    "write_once_artifact",
    """SELECT event_type AS stratum, count(*) AS n FROM events GROUP BY 1""",
)
def write_once_artifact(spark, sf):
    """The second build finds the artifact and does not run."""
    counts = tables.group_counts(v.event_scores(spark, sf), ["stratum"])
    path = scratch_path(spark, "once")
    writers.once(spark, path, lambda: counts)
    return writers.once(spark, path, lambda: counts.where("false"))


@query(
    "run_namespace",
    f"""WITH {CELLS_SQL} SELECT tag, input_size, count(*) AS n, {R("avg(auroc)")} AS mean_auroc FROM cells CROSS JOIN (VALUES ('official', 224), ('ablation', 300)) t(tag, input_size)
WHERE NOT (tag = 'official' AND method = 'knn') GROUP BY ALL""",
)
def run_namespace(spark, sf):
    """Results under (fraction, tag, seed, size); rewriting one run leaves the other alone."""
    c = cells(spark, sf)
    path = scratch_path(spark, "runs")
    writers.write_results(c, path, 1.0, "official", 42, 224)
    writers.write_results(c, path, 1.0, "ablation", 42, 300)
    writers.write_results(c.where("method <> 'knn'"), path, 1.0, "official", 42, 224)
    back = spark.read.parquet(path)
    return rounded(back.groupBy("tag", "input_size").agg(F.count(F.lit(1)).alias("n"), F.avg("auroc").alias("mean_auroc")), "mean_auroc")


@query(
    "missing_files",
    """SELECT 'crops/' || e || '.txt' AS path FROM (SELECT DISTINCT 'event_type=' || event_type AS e FROM events UNION ALL SELECT 'event_type=refund') WHERE e = 'event_type=refund'""",
)
def missing_files(spark, sf):
    """Expected names with no file present."""
    types = v.table(spark, sf, "events", "event_type").distinct()
    path = scratch_path(spark, "files")
    types.withColumn("x", F.lit(1)).write.partitionBy("event_type").parquet(path)
    names = types.select(F.concat(F.lit("event_type="), "event_type").alias("name")).unionByName(
        types.agg(F.lit("event_type=refund").alias("name"))
    )
    expected = names.select(F.concat(F.lit("crops/"), "name", F.lit(".txt")).alias("path"))
    return readers.missing_files(expected, spark, path, r"(event_type=[a-z]+)")
