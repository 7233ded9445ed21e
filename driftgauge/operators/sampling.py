"""Top-n, seeded samples and group-disjoint splits. All draws are keyed hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgauge.functions.draws import keyed_hash
from driftgauge.operators.ordered import prefix_sums


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int | Column) -> DataFrame:
    """First n rows per group; a constant n lets Spark cut each partition before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def positions(df: DataFrame, group: list[str], sample_id: str, seed: int) -> DataFrame:
    """Random order inside each group: ``pos`` (1-based) and ``group_size``; no group in one task."""
    hashed = df.withColumn("__h", keyed_hash(seed, F.col(sample_id)))
    placed = prefix_sums(hashed, group, "__h", {"__one": F.lit(1).cast("bigint")}, tie=sample_id)
    return (
        placed.withColumn("pos", F.col("__one_before") + 1)
        .withColumnRenamed("__one_total", "group_size")
        .drop("__one", "__one_before", "__h")
    )


def sample_n(df: DataFrame, group: list[str], sample_id: str, n: int, seed: int) -> DataFrame:
    """n random rows per group without replacement: the n smallest keyed hashes, cut in every partition first."""
    return top_n(df, group, [keyed_hash(seed, F.col(sample_id)), F.col(sample_id)], n)


def stratified_fraction(df: DataFrame, strata: list[str], sample_id: str, frac: float, seed: int) -> DataFrame:
    """max(1, round-half-even(N * frac)) rows of every stratum, without replacement."""
    if frac >= 1.0:
        return df
    quota = F.greatest(F.lit(1), F.rint(F.col("group_size") * F.lit(frac)).cast("bigint"))
    return positions(df, strata, sample_id, seed).where(F.col("pos") <= quota).drop("pos", "group_size")


def half_split(df: DataFrame, group: list[str], sample_id: str, seed: int) -> DataFrame:
    """Adds ``half``: 'calib' for the first n div 2 rows in random order, else 'eval'."""
    placed = positions(df, group, sample_id, seed)
    first = F.col("pos") <= F.floor(F.col("group_size") / 2)
    return placed.withColumn("half", F.when(first, "calib").otherwise("eval")).drop("pos", "group_size")


def group_summary(df: DataFrame, group: str, label: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("label_frac"))


def group_split(df: DataFrame, group: str, label: str) -> DataFrame:
    """(group, n, label_frac, half): whole groups to 'val' or 'test', label rates balanced.

    Groups are ordered by label rate and dealt val, test, test, val, ..., so neighbours in
    rate land on both sides. The group id must be numeric (it breaks ties).
    """
    summary = group_summary(df, group, label)
    order = prefix_sums(
        summary.withColumn("__one", F.lit(1)), ["__one"], "label_frac", {"__c": F.lit(1).cast("bigint")}, tie=group
    )
    side = F.col("__c_before") % 4
    return order.select(group, "n", "label_frac", F.when(side.isin(0, 3), "val").otherwise("test").alias("half"))


def apply_split(df: DataFrame, split: DataFrame, group: str) -> DataFrame:
    """Attach the frozen half to every row of a known group."""
    return df.join(split.select(group, "half"), group)


def split_half(df: DataFrame, split: DataFrame, group: str, half: str) -> DataFrame:
    """Only rows whose group is in the named half (semi join)."""
    return df.join(split.where(F.col("half") == half).select(group), group, "left_semi")


def registry_order(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Add ``ord`` = place in a fixed registry; unknown values come last."""
    lookup = F.create_map(*[x for i, v in enumerate(order) for x in (F.lit(v), F.lit(i))])
    return df.withColumn("ord", F.coalesce(lookup[F.col(column)], F.lit(len(order))))
