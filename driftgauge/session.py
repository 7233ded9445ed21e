"""Session helpers: local sessions for tests and benches, the shared folder, written tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(app: str = "driftgauge", cpus: str | int = "*", checkpoint_dir: str | None = None) -> SparkSession:
    parts = str(os.cpu_count() or 8) if cpus == "*" else str(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", parts)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if checkpoint_dir is not None:
        builder = builder.config(CHECKPOINT_DIR, checkpoint_dir)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, set as checkpoint folder if need be.

    Only where driver and tasks are one process on one machine (a plain ``local`` master) an unset folder is replaced,
    by one named after the application in the folder that Spark itself uses for local files.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get(CHECKPOINT_DIR)
        if shared is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
            shared = f"{sc.getConf().get('spark.local.dir', '/tmp')}/driftgauge-{sc.applicationId}"
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder; lost executors do not lose the rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a written table; its parent goes when the driver ends."""
    parent = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(parent)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return f"{parent}/table"


def written_by(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` written once, a folder for each value of the columns, and read back: later reads are pruned."""
    path = scratch_path(df.sparkSession, "rows")
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
