"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from driftgauge.session import scratch_path

BLOCK_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Batches between Spark and Python of a few megabytes, unless the session sets bounds of its own."""
    for name, usual, bound in (("maxRecordsPerBatch", "10000", "2000"), ("maxBytesPerBatch", "67108864b", "8388608b")):
        key = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(key) == usual:
            spark.conf.set(key, bound)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a table of its own, safe from lost executors."""
    bound_batches(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def blocks(batches: Iterable[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices whose ``column`` holds about ``limit`` bytes at most (a single longer value is a slice of its own)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The column with null as the empty text."""
    return pc.fill_null(batch.column(column), "")


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts as codes, each text's bounds in them, and the word of each code."""
    split = pc.ascii_split_whitespace(texts)
    bounds = split.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    coded = pc.dictionary_encode(split.flatten())
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.index(coded.dictionary, "").as_py()
    if empty >= 0:  # the splitter gives an empty word at either end of a text
        keep = codes != empty
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        codes = codes[keep]
    return codes, bounds, coded.dictionary


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between the bounds of each text."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]
