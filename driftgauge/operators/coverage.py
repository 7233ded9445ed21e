"""Selective prediction: risk-coverage curves, coverage at a risk target, AURC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgauge.operators.ordered import prefix_sums

# Fixed values of the published protocol.
RISK_EPS = 1e-12
GRID_TOP, GRID_STEP, GRID_POINTS = 1.0, -0.01, 91
TARGETS = (0.10, 0.15, 0.20)


def risk_curve(
    df: DataFrame, keys: list[str], score: str = "score", correct: str = "correct", tie: str = "sample_id",
    weight: Column | None = None,
) -> DataFrame:
    """Accepted count, coverage and risk of every prefix by descending score (ties by id)."""
    w = weight if weight is not None else F.lit(1).cast("bigint")
    slim = df.select(*keys, score, tie, F.col(correct).cast("double").alias("__ok"), w.alias("__w"))
    cum = prefix_sums(
        slim,
        keys,
        score,
        {"n": F.col("__w").cast("bigint"), "err": F.col("__w") * (1.0 - F.col("__ok"))},
        tie=tie,
        descending=True,
    )
    accepted = F.col("n_before") + F.col("n")
    return cum.where("n > 0").select(
        *keys,
        score,
        tie,
        accepted.alias("accepted"),
        (accepted.cast("double") / F.col("n_total")).alias("coverage"),
        ((F.col("err_before") + F.col("err")) / accepted).alias("risk"),
        F.col("n_total").alias("n"),
        F.col("err_total").alias("errors"),
        F.col("n").alias("__rep"),
        F.col("err_before").alias("__err_before"),
        F.col("n_before").alias("__n_before"),
        (F.col("err") / F.col("n")).alias("__err_each"),
    )


def _last_ok(target: float, eps: float) -> Column:
    """Largest prefix length within a row's copies whose risk meets the target.

    A row of weight w adds w equal copies, and every copy ends a prefix of its own. Wrong
    copies only raise the risk, right copies only lower it, so the best prefix inside a
    row is its last one, or (wrong row) the longest still under the target.
    """
    limit = F.lit(target + eps)
    full = F.when(F.col("risk") <= limit, F.col("accepted"))
    room = F.floor((limit * F.col("__n_before") - F.col("__err_before")) / (F.lit(1.0) - limit))
    partial = F.when(
        (F.col("__rep") > 1) & (F.col("__err_each") > 0) & (room >= 1),
        F.col("__n_before") + F.least(room.cast("bigint"), F.col("__rep")),
    )
    return F.coalesce(full, partial)


def coverage_at_risk(
    curve: DataFrame,
    keys: list[str],
    targets: tuple[float, ...] = TARGETS,
    eps: float = RISK_EPS,
    none_value: float | None = 0.0,
) -> DataFrame:
    """Largest coverage whose prefix risk meets each target (last prefix wins, not the first)."""
    return curve.groupBy(*keys).agg(
        *_coverage_aggregates(targets, eps, none_value), (F.max("errors") / F.max("n")).alias("full_risk"), F.max("n").alias("n")
    )


def _coverage_aggregates(targets: tuple[float, ...], eps: float, none_value: float | None) -> list[Column]:
    out = []
    for t in targets:
        share = F.max(_last_ok(t, eps)).cast("double") / F.max("n")
        out.append(F.coalesce(share, F.lit(none_value).cast("double")).alias(f"coverage_at_risk{round(t * 100)}"))
    return out


def _grid_hits(n_points: int, top: float, step: float, k_rule: str) -> Column:
    """Grid points whose prefix length is this row's, as ARRAY<STRUCT<grid_coverage, point>>.

    A prefix length only belongs to grid points near k/n, so a row tests a few of them; the
    shortest prefix also stands for all points that round to zero.
    """
    n, k = F.col("n"), F.col("accepted")
    near = (k / n - F.lit(top)) / F.lit(step)
    slack = F.lit(2) + F.ceil(F.lit(1.0) / (n * F.lit(abs(step))))
    low = F.greatest(F.lit(0), F.floor(near - slack)).cast("int")
    high = F.least(F.lit(n_points - 1), F.ceil(near + slack)).cast("int")
    every = F.sequence(F.lit(0), F.lit(n_points - 1))
    some = F.when(k == 1, every).when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    def mine(i: Column) -> Column:
        raw = (F.lit(top) + i * F.lit(step)) * n
        return F.greatest(F.lit(1), (F.rint(raw) if k_rule == "round" else F.floor(raw)).cast("bigint")) == k

    return F.transform(
        F.filter(some, mine), lambda i: F.struct((F.lit(top) + i * F.lit(step)).alias("grid_coverage"), i.alias("point"))
    )


def risk_at_grid(
    curve: DataFrame,
    keys: list[str],
    n_points: int = GRID_POINTS,
    top: float = GRID_TOP,
    step: float = GRID_STEP,
    k_rule: str = "round",
) -> DataFrame:
    """Risk at a fixed coverage grid; k is round-half-even(c*n) or truncated, at least 1.

    Every curve row knows its own grid points, so nothing is joined. For unit-weight curves.
    """
    hits = curve.select(*keys, "accepted", "risk", F.explode(_grid_hits(n_points, top, step, k_rule)).alias("g"))
    return hits.select(*keys, "g.point", "g.grid_coverage", "accepted", "risk")


def _trapezoid(points: Column) -> Column:
    """Area under (x, y) structs sorted by x."""
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(points) - 1))
    return F.aggregate(
        steps,
        F.lit(0.0),
        lambda acc, i: acc
        + F.coalesce(
            (F.get(points, i)["x"] - F.get(points, i - 1)["x"]) * (F.get(points, i)["y"] + F.get(points, i - 1)["y"]) / 2.0,
            F.lit(0.0),
        ),
    )


def aurc(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Trapezoid area under the risk over the ascending coverage grid (91 points per cell)."""
    points = F.sort_array(F.collect_list(F.struct(F.col("grid_coverage").alias("x"), F.col("risk").alias("y"))))
    return grid.groupBy(*keys).agg(points.alias("__p")).select(*keys, _trapezoid(F.col("__p")).alias("aurc"))


def selective_report(df: DataFrame, keys: list[str], targets: tuple[float, ...] = (0.10, 0.15), **kw) -> DataFrame:
    """AURC, coverage at the risk targets (NULL if never met), full risk and n per cell.

    One pass over the sorted curve: each row adds its grid points (91 per cell in all) and
    its prefix length to the same aggregate.
    """
    curve = risk_curve(df, keys, **kw)
    hits = _grid_hits(GRID_POINTS, GRID_TOP, GRID_STEP, "round")
    risk = F.col("risk")
    points = F.transform(hits, lambda g: F.struct(g["grid_coverage"].alias("x"), risk.alias("y")))
    marked = curve.withColumn("__g", points)
    mine = F.flatten(F.collect_list(F.when(F.size("__g") > 0, F.col("__g"))))
    agg = marked.groupBy(*keys).agg(
        mine.alias("__p"), *_coverage_aggregates(targets, 0.0, None), (F.max("errors") / F.max("n")).alias("full_risk"), F.max("n").alias("n")
    )
    return agg.select(*keys, _trapezoid(F.sort_array("__p")).alias("aurc"), *[c for c in agg.columns if c not in (*keys, "__p")])
