"""Sinks: partitioned tables, CSV, JSON verdicts, write-once artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELL = ["domain", "backbone", "seed", "split"]


def write_samples(df: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """Feature bundles as one directory per cell; rewriting a cell leaves the others alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*(keys or CELL)).parquet(path)


def write_results(df: DataFrame, path: str, frac: float, tag: str, seed: int, input_size: int) -> None:
    """Result rows under their run namespace (train fraction, tag, seed, input size)."""
    run = {"frac": F.lit(frac), "tag": F.lit(tag), "seed": F.lit(seed), "input_size": F.lit(input_size)}
    tagged = df.withColumns(run)
    tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*run).parquet(path)


def write_csv(df: DataFrame, path: str, folders: list[str] | None = None) -> None:
    """CSV with a header; ``folders`` names columns whose values become folders, all written by one job."""
    df.write.mode("overwrite").option("header", True).partitionBy(*(folders or [])).csv(path)


def write_verdict(df: DataFrame, path: str, folders: list[str] | None = None) -> None:
    """One JSON object per verdict row."""
    df.write.mode("overwrite").partitionBy(*(folders or [])).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished write is at the path: its folder holds Spark's success mark."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def once(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at the path, built and written only if no finished one is there yet.

    A folder without the success mark is what a crashed run left behind; it is written anew.
    """
    if not exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
