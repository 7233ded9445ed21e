"""Operator 5: token ids as Parquet list columns that can be read in part.

Layout of a token table: rows in ascending ``doc_id`` order (null first, equal ids by text), files in that order too.
``ids`` is a list column under dictionary encoding; ``doc_id``, ``shard_start`` and ``n_tokens`` are delta-encoded.
Row groups and pages are kept small and every file carries its page index, so a reader of some documents skips the
pages of the others and a reader of the metadata columns never touches the ids.

Nulls: a null text is an empty one (its row holds the end id only); a null ``doc_id`` keeps its row. Repeated rows are
kept. Only ``doc_id`` and ``text`` are read, so other columns of any name do not matter. An empty table gives an empty
table. Texts are encoded whole, a very long one too.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftgauge.llm.common import blocks, texts_of
from driftgauge.llm.tokens import END_ID, encoder

SCHEMA = "shard int, doc_id long, shard_start long, n_tokens long, ids array<int>"
ARROW = pa.schema(
    [
        ("shard", pa.int32()),
        ("doc_id", pa.int64()),
        ("shard_start", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids", pa.list_(pa.int32())),
    ]
)
METADATA = ["shard", "doc_id", "shard_start", "n_tokens"]
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10


def token_rows(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """``docs`` in ``doc_id`` order with their ids; ``shard_start`` counts the ids before a document in its shard."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, before, shard = encoder(tokenizer), 0, TaskContext.get().partitionId()
        for block in blocks(batches, "text"):
            ids, bounds = words.encode(texts_of(block, "text"), end_id)
            lengths = np.diff(bounds)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(lengths), shard, np.int32)),
                    block.column("doc_id"),
                    pa.array(before + bounds[:-1]),
                    pa.array(lengths),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.view(np.int32))),
                ],
                schema=ARROW,
            )
            before += int(bounds[-1])

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    return ordered.mapInArrow(encode, SCHEMA)


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
) -> None:
    """Write the token table of ``docs`` (``doc_id``, ``text``) to ``path``."""
    writer = token_rows(docs, tokenizer, end_id).write
    options = {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",  # delta encoding where the dictionary is off
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.enable.dictionary#doc_id": "false",
        "parquet.enable.dictionary#shard_start": "false",
        "parquet.enable.dictionary#n_tokens": "false",
    }
    writer.options(**options).parquet(path)


def shard_offsets(table: DataFrame) -> DataFrame:
    """The ids in all shards before each shard; a table of one row per written file."""
    totals = table.groupBy("shard").agg(F.sum("n_tokens").alias("shard_tokens"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("shard_tokens").over(earlier), F.lit(0)).alias("shard_offset"))


def read_tokens(
    spark: SparkSession, path: str, first: int | None = None, last: int | None = None, with_ids: bool = True
) -> DataFrame:
    """Rows of a token table, with ``start``: the ids of all documents before. ``first``/``last`` bound ``doc_id``."""
    table = spark.read.schema(SCHEMA).parquet(path)
    rows = table if with_ids else table.drop("ids")
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    started = rows.join(shard_offsets(table), "shard")
    return started.withColumn("start", F.col("shard_offset") + F.col("shard_start")).drop("shard_offset")


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            bounds = lists.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(lists.values.to_numpy(), dtype="<i4")).cast("B")
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in METADATA), pa.array(sums, pa.int64())], names=[*METADATA, "ids_crc32"]
            )

    table = spark.read.schema(SCHEMA).parquet(path)
    sums = table.mapInArrow(digest, f"{SCHEMA.rpartition(', ')[0]}, ids_crc32 long")
    return sums.join(shard_offsets(table), "shard").select(
        "doc_id", (F.col("shard_offset") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32"
    )
