"""Relational operators on result tables: joins with guards, upserts, precedence, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lookup_table(spark: SparkSession, mapping: dict[str, str], key: str, value: str) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in mapping.items()], f"{key} string, {value} string")


def with_registry(df: DataFrame, mapping: dict[str, str], column: str, out: str, default: str = "unknown") -> DataFrame:
    """Left lookup in a small fixed registry; unmatched values get the default."""
    table = lookup_table(df.sparkSession, mapping, column, out)
    return df.join(F.broadcast(table), column, "left").withColumn(out, F.coalesce(F.col(out), F.lit(default)))


def exactly_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join that stops the job when a left row finds zero or several right rows."""
    counted = right.withColumn("__one", F.lit(1))
    counts = counted.groupBy(*keys).agg(F.count("__one").alias("__m"))
    checked = left.join(counts, keys, "left").withColumn("__m", F.coalesce(F.col("__m"), F.lit(0)))
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    ok = F.when(F.col("__m") != 1, F.raise_error(F.concat(F.lit("expected one match for "), name))).otherwise(F.lit(True))
    return checked.where(ok).drop("__m").join(right, keys)


def aligned_join(left: DataFrame, right: DataFrame, key: str, same: str) -> DataFrame:
    """Join on the sample key that stops when a row has no partner or the shared column disagrees."""
    l, r = left.withColumn("__left", F.lit(True)), right.withColumnRenamed(same, "__other").withColumn("__right", F.lit(True))
    joined = l.join(r, key, "full")
    paired = F.col("__left").isNotNull() & F.col("__right").isNotNull() & F.col(same).eqNullSafe(F.col("__other"))
    name = F.coalesce(F.col(key).cast("string"), F.lit("NULL"))
    ok = F.when(~paired, F.raise_error(F.concat(F.lit("rows do not match for "), name))).otherwise(F.lit(True))
    return joined.where(ok).drop("__other", "__left", "__right")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old rows with the same key; missing columns become NULL."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def first_wins(sources: list[DataFrame], keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Union where an earlier source beats a later one on the same key."""
    frames = [s.withColumn("__src", F.lit(i)) for i, s in enumerate(sources)]
    both = frames[0]
    for f in frames[1:]:
        both = both.unionByName(f, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.col("__src"), *(order or []))
    return both.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__src")


def fill_missing(primary: DataFrame, computed: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer join; the primary value wins, the computed one fills the holes."""
    c = computed.select(*keys, F.col(value).alias("__computed"))
    return (
        primary.select(*keys, value)
        .join(c, keys, "full")
        .select(
            *keys,
            F.coalesce(F.col(value), F.col("__computed")).alias(value),
            F.when(F.col(value).isNotNull(), "table").otherwise("computed").alias("source"),
        )
    )


def difference(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """new - old per key for each value column (NULL where the key is new)."""
    o = old.select(*keys, *[F.col(v).alias(f"__{v}") for v in values])
    return new.join(o, keys, "left").select(
        *keys, *values, *[(F.col(v) - F.col(f"__{v}")).alias(f"delta_{v}") for v in values]
    )


def unpivot_prefixed(df: DataFrame, ids: list[str], prefix: str, names: str, value: str, aliases: dict[str, str]) -> DataFrame:
    """``<prefix><name>`` columns to rows, NULLs dropped, legacy short names mapped."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    long = df.unpivot(ids, cols, "__c", value).where(F.col(value).isNotNull())
    name = F.substr(F.col("__c"), F.lit(len(prefix) + 1))
    if aliases:
        fixed = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
        name = F.coalesce(fixed[name], name)
    return long.withColumn(names, name).drop("__c")


def group_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def split_summary(df: DataFrame, split: str, center: str) -> DataFrame:
    """Rows per split and its sorted distinct centers as text (centers are few)."""
    per = df.groupBy(split, center).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(split).agg(
        F.sum("n").alias("n"),
        F.array_join(F.sort_array(F.collect_set(center)).cast("array<string>"), ",").alias("centers"),
    )


def group_profile(df: DataFrame, group: str, item: str, label: str) -> DataFrame:
    """Per group: its items as text, row count and label rate (two steps: items collapse first)."""
    per = df.groupBy(group, item).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos"))
    return per.groupBy(group).agg(
        F.array_join(F.sort_array(F.collect_set(item)).cast("array<string>"), " ").alias("items"),
        F.sum("n").alias("n"),
        F.round(F.sum("pos") / F.sum("n"), 4).alias("label_frac"),
    )


def pick_best(df: DataFrame, keys: list[str], name: str, metric: str, lowest: bool = False) -> DataFrame:
    """Name and value of the best metric per group; equal metrics go to the smaller name.

    One mergeable aggregate: the extreme of (metric, name) structs.
    """
    m = F.col(metric) if lowest else -F.col(metric)
    best = F.min(F.struct(m.alias("m"), F.col(name).alias("name")))
    out = df.where(F.col(metric).isNotNull()).groupBy(*keys).agg(best.alias("b"))
    return out.select(*keys, F.col("b.name").alias(name), (F.col("b.m") if lowest else -F.col("b.m")).alias(metric))


def ordered_names(df: DataFrame, keys: list[str], name: str, metric: str, ordinal: str, lowest: bool = False) -> DataFrame:
    """'a>b>c' by metric, NULL metrics last, ties in input order (``ordinal``)."""
    m = F.col(metric) if lowest else -F.col(metric)
    entry = F.struct(F.col(metric).isNull().alias("z"), m.alias("m"), F.col(ordinal).alias("o"), F.col(name).alias("n"))
    ordered = F.sort_array(F.collect_list(entry))
    return df.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda e: e["n"]), ">").alias(f"rank_by_{metric}"))


def rank_disagreement(df: DataFrame, keys: list[str], name: str, ordinal: str) -> DataFrame:
    """Do AUROC, coverage and AURC order the models the same way?"""
    a = ordered_names(df, keys, name, "ood_auroc", ordinal)
    c = ordered_names(df, keys, name, "coverage_at_risk10", ordinal)
    r = ordered_names(df, keys, name, "aurc", ordinal, lowest=True)
    return (
        a.join(c, keys)
        .join(r, keys)
        .withColumn("auroc_vs_coverage10_disagree", F.col("rank_by_ood_auroc") != F.col("rank_by_coverage_at_risk10"))
        .withColumn("auroc_vs_aurc_disagree", F.col("rank_by_ood_auroc") != F.col("rank_by_aurc"))
    )


def baseline_jump(df: DataFrame, keys: list[str], name: str, baseline: list[str], metric: str, out: str = "jump") -> DataFrame:
    """metric minus the mean metric of the baseline rows of the same group.

    The baseline means are one row per group and join back, so no group is windowed whole.
    """
    base = df.where(F.col(name).isin(baseline)).groupBy(*keys).agg(F.avg(metric).alias("baseline_mean"))
    joined = df.join(base, keys, "left") if keys else df.withColumn("baseline_mean", base.scalar())
    return joined.withColumn(out, F.col(metric) - F.col("baseline_mean"))


def first_epoch_over(df: DataFrame, keys: list[str], jump: str, bar: float, epoch: str = "epoch") -> DataFrame:
    """First epoch whose jump reaches the bar (NULL if none)."""
    return df.groupBy(*keys).agg(F.min(F.when(F.col(jump) >= bar, F.col(epoch))).alias("first_epoch"))


def channel_shift(df: DataFrame, keys: list[str], eps: float = 1e-12) -> DataFrame:
    """Mean over layers of RMS channel-mean shift, scaled by the ID RMS of the layer.

    Input rows are partial sums (keys, split ID/OOD, layer, channel, sum, n); they merge
    like any partial aggregate. Layers missing on the OOD side are left out.
    """
    side = lambda s, c: F.sum(F.when(F.col("split") == s, F.col(c)))
    channel = df.groupBy(*keys, "layer", "channel").agg(
        F.try_divide(side("ID", "sum"), side("ID", "n")).alias("a"), F.try_divide(side("OOD", "sum"), side("OOD", "n")).alias("b")
    )
    both = channel.where("a is not null and b is not null")
    layer = both.groupBy(*keys, "layer").agg(
        (F.sqrt(F.avg((F.col("b") - F.col("a")) * (F.col("b") - F.col("a")))) / F.sqrt(F.avg(F.col("a") * F.col("a")) + F.lit(eps))).alias("s")
    )
    return layer.groupBy(*keys).agg(F.avg("s").alias("bn_shift"), F.count(F.lit(1)).alias("n_bn_layers"))


def require_rows(df: DataFrame, what: str, min_distinct: tuple[str, int] | None = None) -> DataFrame:
    """Stop early when a required input is empty or has too few distinct values."""
    if df.isEmpty():
        raise ValueError(f"required input is empty: {what}")
    if min_distinct:
        column, least = min_distinct
        found = df.select(column).distinct().limit(least).count()
        if found < least:
            raise ValueError(f"{what}: {found} distinct {column}, need {least}")
    return df


def guard(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """Rows pass while the condition holds; the first row that breaks it stops the job."""
    return df.where(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
