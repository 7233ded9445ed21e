"""Order statistics and prefix sums per group that hold when one group owns most rows.

A plain ``Window.partitionBy(cell).orderBy(score)`` puts a whole cell in one task.
Here the input is cut into value ranges (approximate quantiles only choose the cut
points, results stay exact), each (cell, range) is windowed on its own and shifted by
the totals of the ranges before it. The number of ranges follows the number of rows
without a bound; an input of one range needs no cut points and no shifting. NULL keys
and NULL values stop the job at every size: callers decide what a NULL means before.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from driftgauge.session import cut_lineage

# Rows that one task may sort or window comfortably.
ROWS_PER_RANGE = 4_000_000
_RANGE, _TIE = "__range", "__tie_range"


def _cut_points(df: DataFrame, col: str, n_ranges: int) -> list[float]:
    grid = [i / n_ranges for i in range(1, n_ranges)]
    cuts = df.agg(F.percentile_approx(F.col(col).cast("double"), grid, 8 * n_ranges + 1000).alias("c")).first()["c"]
    return sorted(set(cuts or []))


def _bucketize(df: DataFrame, col: str, out: str, cuts: list[float], isolate: bool) -> DataFrame:
    """Bucket number by cut points; ``isolate`` gives every cut value a bucket of its own."""
    edges = set(cuts) | ({math.nextafter(c, math.inf) for c in cuts} if isolate else set())
    splits = [-math.inf, *sorted(edges), math.inf]
    if len(splits) < 3:
        return df.withColumn(out, F.lit(0))
    tmp = f"{out}_d"
    bucketed = Bucketizer(splits=splits, inputCol=tmp, outputCol=out).transform(
        df.withColumn(tmp, F.col(col).cast("double"))
    )
    return bucketed.withColumn(out, F.col(out).cast("int")).drop(tmp)


def with_ranges(
    df: DataFrame, value: str, tie: str | None = None, source: DataFrame | None = None
) -> tuple[DataFrame, bool]:
    """Add range columns ordered like (value, tie). Returns (frame, ranged?).

    The row count of ``source`` (default: the frame itself) is the size check; a frame that
    was aggregated from it can only be smaller, and counting the source prunes all columns.

    Cut points come from the whole input, so a range never holds more than about
    ``ROWS_PER_RANGE`` rows of all groups together, whatever the largest group is. A
    value heavy enough to be a cut point gets its own range, which is cut by ``tie``.
    """
    limit = ROWS_PER_RANGE
    n = (df if source is None else source).count()
    if n > limit:
        df = cut_lineage(df)
        n = n if source is None else df.count()
    if n <= limit:
        return df.withColumns({_RANGE: F.lit(0), _TIE: F.lit(0)}), False
    return cut_into_ranges(df, value, tie, n), True


def cut_into_ranges(df: DataFrame, value: str, tie: str | None, n: int) -> DataFrame:
    """The range columns of ``with_ranges`` for a frame of ``n`` rows, which is read for its cut points and not kept."""
    n_ranges = max(2, math.ceil(n / ROWS_PER_RANGE) * 2)
    cuts = _cut_points(df, value, n_ranges)
    df = _bucketize(df, value, _RANGE, cuts, isolate=True)
    if tie is None:
        return df.withColumn(_TIE, F.lit(0))
    df = _bucketize(df, tie, _TIE, _cut_points(df, tie, n_ranges), isolate=False)
    heavy = F.col(value).cast("double").isin(cuts)
    return df.withColumn(_TIE, F.when(heavy, F.col(_TIE)).otherwise(F.lit(0)))


def prefix_sums_checked(
    df: DataFrame,
    keys: list[str],
    value: str,
    sums: dict[str, Column],
    tie: str | None = None,
    descending: bool = False,
    source: DataFrame | None = None,
) -> tuple[DataFrame, bool]:
    """Row-level prefix sums in (value, tie) order, and whether ranges were needed.

    For every entry ``name -> column`` adds ``name`` (the row's own amount),
    ``name_before`` (total of strictly earlier rows) and ``name_total`` (group total).
    Rows must be unique per (keys, value, tie); ``tie`` is always ascending.
    """
    blank = reduce(lambda a, c: a | c, [F.col(c).isNull() for c in [*keys, value]])
    stop = F.raise_error(F.lit(f"NULL in {', '.join([*keys, value])}")).cast("boolean")
    src = df.where(F.when(blank, stop).otherwise(F.lit(True))).withColumns(sums)
    src, ranged = with_ranges(src, value, tie, source)
    by_value = F.col(value).desc() if descending else F.col(value).asc()
    order = [by_value] + ([F.col(tie).asc()] if tie else [])
    if not ranged:
        src = src.drop(_RANGE, _TIE)
        part = keys or [F.lit(0)]
        w = Window.partitionBy(*part).orderBy(*order)
        run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        plain = src.select(
            "*",
            *[(F.sum(n).over(run) - F.col(n)).alias(f"{n}_before") for n in sums],
            *[F.sum(n).over(whole).alias(f"{n}_total") for n in sums],
        )
        return plain, False
    range_order = F.col(_RANGE).desc() if descending else F.col(_RANGE).asc()
    totals = src.groupBy(*keys, _RANGE, _TIE).agg(*[F.sum(n).alias(f"{n}__sum") for n in sums])
    part = keys or [F.lit(0)]
    # one row per (group, range)
    wr = Window.partitionBy(*part).orderBy(range_order, F.col(_TIE).asc())
    before = wr.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = wr.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        *keys,
        _RANGE,
        _TIE,
        *[(F.sum(f"{n}__sum").over(before) - F.col(f"{n}__sum")).alias(f"{n}__off") for n in sums],
        *[F.sum(f"{n}__sum").over(whole).alias(f"{n}_total") for n in sums],
    )
    joined = src.join(offsets, [*keys, _RANGE, _TIE])
    w = Window.partitionBy(*keys, _RANGE, _TIE).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shifted = joined.select(
        *src.drop(_RANGE, _TIE).columns,
        *[(F.sum(n).over(run) - F.col(n) + F.col(f"{n}__off")).alias(f"{n}_before") for n in sums],
        *[f"{n}_total" for n in sums],
    )
    return shifted, True


def prefix_sums(df: DataFrame, keys: list[str], value: str, sums: dict[str, Column], **kw) -> DataFrame:
    return prefix_sums_checked(df, keys, value, sums, **kw)[0]


def distribution_checked(
    df: DataFrame, keys: list[str], value: str, counts: dict[str, Column], descending: bool = False
) -> tuple[DataFrame, bool]:
    """One row per (keys, distinct value) with counts, earlier counts and totals; ranged?

    Ties collapse in the map-side partial aggregate, so a heavily tied score shrinks
    to a few rows before anything is sorted.
    """
    cells = df.groupBy(*keys, value).agg(*[F.sum(c).cast("bigint").alias(n) for n, c in counts.items()])
    cum, ranged = prefix_sums_checked(
        cells, keys, value, {n: F.col(n) for n in counts}, descending=descending, source=df
    )
    return cum.select(*keys, value, *[c for n in counts for c in (n, f"{n}_before", f"{n}_total")]), ranged


def distribution(df: DataFrame, keys: list[str], value: str, counts: dict[str, Column], descending: bool = False) -> DataFrame:
    return distribution_checked(df, keys, value, counts, descending)[0]


def percentile_from(value: str, count: str, p: float, over: WindowSpec | None = None) -> Column:
    """Linearly interpolated percentile p in [0, 1] of a ``distribution``.

    An aggregate by default; with ``over`` the same as a window column.
    """

    def largest(c: Column) -> Column:
        return F.max(c) if over is None else F.max(c).over(over)

    n, before, total = F.col(count), F.col(f"{count}_before"), F.col(f"{count}_total")
    h = F.lit(float(p)) * (total - 1).cast("double")
    lo, hi = F.floor(h), F.ceil(h)
    v = F.col(value).cast("double")
    v_lo = largest(F.when((n > 0) & (before <= lo) & (lo < before + n), v))
    v_hi = largest(F.when((n > 0) & (before <= hi) & (hi < before + n), v))
    frac = largest(h - lo)
    return v_lo + frac * (v_hi - v_lo)


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact percentiles without holding a group's values in one aggregation buffer."""
    dist = distribution(df, keys, value, {"n": F.lit(1)})
    return dist.groupBy(*keys).agg(*[percentile_from(value, "n", p).alias(a) for a, p in probs.items()])


def kept_after_trim(count: str, share: float) -> Column:
    """How many rows of a distinct value survive dropping floor(share*n) rows per tail.

    Groups under three rows, or where the cut is empty or would take everything, stay whole.
    """
    n, before, total = F.col(count), F.col(f"{count}_before"), F.col(f"{count}_total")
    k = F.floor(F.lit(float(share)) * total)
    whole = (total < 3) | (k <= 0) | (2 * k >= total)
    inside = F.least(before + n, total - k) - F.greatest(before, k)
    return F.when(whole, n).otherwise(F.greatest(F.lit(0), inside))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
