"""Table scans: declared schemas, path-derived keys, nested JSON, text lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgauge import schemas
from driftgauge.functions.labels import official_backbone, slice_severity


def read_samples(spark: SparkSession, path: str, columns: list[str] | None = None, **cell) -> DataFrame:
    """Feature bundles, partitioned by cell; equality filters prune partitions."""
    df = spark.read.schema(schemas.SAMPLES).parquet(path)
    for key, value in cell.items():
        df = df.where(F.col(key) == value)
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a declared schema; a malformed line or a missing file stops the job."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def scan_score_tables(spark: SparkSession, glob: str, domain: str) -> DataFrame:
    """All per-backbone score tables under a glob, keyed by file name, held-out variants dropped."""
    raw = spark.read.schema(schemas.SCORE_COMPARISON).option("header", True).csv(glob)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/=]+)_score_comparison\.csv(?:/|$)", 1)
    keyed = raw.select(F.lit(domain).alias("domain"), official_backbone(stem).alias("backbone"), "*")
    return keyed.where(F.col("backbone").isNotNull()).select(
        "domain", "backbone", F.lower("Method").alias("method"), F.col("AUROC").alias("auroc"),
        F.col("FPR95").alias("fpr95"), F.col("AUROC_CI_low").alias("ci_low"), F.col("AUROC_CI_high").alias("ci_high"),
    )


def read_train_meta(spark: SparkSession, glob: str) -> DataFrame:
    """(backbone, id_acc) from small JSON side files named ``<backbone>_train_meta.json``."""
    raw = spark.read.schema(schemas.TRAIN_META).option("multiLine", True).json(glob)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/=]+)_train_meta\.json(?:/|$)", 1)
    return raw.select(stem.alias("backbone"), F.col("best_id_val_acc").alias("id_acc"))


def read_image_list(spark: SparkSession, path: str) -> DataFrame:
    """``relpath label`` lines; blank lines are skipped, the label follows the first blank."""
    line = F.trim("value")
    parts = F.split(line, " ", 2)
    return (
        spark.read.text(path)
        .where(F.length(line) > 0)
        .select(parts[0].alias("path"), parts[1].cast("int").alias("label"))
    )


def read_annotations(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(images, annotations) from nested JSON: one document per file, or per line."""
    doc = spark.read.schema(schemas.ANNOTATIONS).option("multiLine", multi_line).json(path)
    img = doc.select(F.explode("images").alias("i")).select(
        F.col("i.id").alias("image_id"), "i.file_name", "i.width", "i.height"
    )
    a = doc.select(F.explode("annotations").alias("a"))
    box = [F.col("a.bbox")[k].alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))]
    return img, a.select("a.image_id", F.col("a.id").alias("ann_id"), "a.category_id", *box)


def read_group_metadata(spark: SparkSession, path: str, center: int) -> DataFrame:
    """Metadata rows of one center; patient ids stay text (leading zeros matter)."""
    return read_csv(spark, path, schemas.GROUP_METADATA).where(F.col("center") == center)


def missing_files(expected: DataFrame, spark: SparkSession, root: str, name: str = r"([^/]+)$") -> DataFrame:
    """Expected paths with no file below the root; the pattern's group names a file on both sides.

    Only the listing is used, no content is read.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    present = listed.select(F.regexp_extract("path", name, 1).alias("__name")).distinct()
    return expected.withColumn("__name", F.regexp_extract("path", name, 1)).join(present, "__name", "left_anti").drop("__name")


def severity_slice(stack: DataFrame, idx: str, severity: int, per_slice: int = 10_000) -> DataFrame:
    """Rows of one severity of a stacked source; a short slice stops the job."""
    rows = stack.withColumn("severity", slice_severity(F.col(idx), per_slice)).where(F.col("severity") == severity)
    n = rows.count()
    if n != per_slice:
        raise ValueError(f"severity {severity}: expected {per_slice} rows, got {n}")
    return rows
