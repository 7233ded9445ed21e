"""Held-out folds and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgauge.llm.common import written


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % n


def bounded_sample(rows: DataFrame, by: str, per_value: int, weight: str | None = None) -> DataFrame:
    """About ``per_value`` distinct rows of each value of ``by``, chosen by a hash of the whole row, or all if it has fewer.

    The counts per value stay in Spark. Rows without a value are left out. ``weight`` names one more column: how many
    rows of its value a row stands for.
    """
    names = rows.columns
    counts = written(rows.groupBy(F.col(by).alias("own_value")).agg(F.count("*").alias("own_n")), "sample-counts")
    draw = F.pmod(F.xxhash64(*names, F.lit("sample")), F.lit(1 << 40)) / (1 << 40)
    chosen = rows.join(counts, F.col(by) == F.col("own_value")).where(draw < F.lit(float(per_value)) / F.col("own_n"))
    more = [] if weight is None else [F.greatest(F.lit(1.0), F.col("own_n") / F.lit(float(per_value))).alias(weight)]
    return chosen.select(*names, *more).dropDuplicates(names)
