"""Refits on subsamples and metric sweeps: one more key per refit or per sweep cell."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from driftgauge.functions.draws import MODULUS, keyed_hash
from driftgauge.operators.correlation import spearman
from driftgauge.operators.kernels import key_fields, matrix, normalized
from driftgauge.operators.moments import ledoit_wolf
from driftgauge.operators.ordered import distribution
from driftgauge.operators.scorer import mahalanobis_score, parameter_chunks
from driftgauge.operators.separability import ID_TAIL, separability
from driftgauge.session import cut_lineage

# Fixed values of the published protocols.
FIT_SIZES = (100, 500, 1000, 2500, 5000)
N_DRAWS = 20
# Vector entries of one cell's evaluation rows that a task holds while it scores them with all fits (8 bytes each).
CELL_ENTRIES = 16_000_000


def _first(train: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """Place 1..n of the first rows per key, found on the ids alone: no vector is sorted."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return train.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)


def nested_subsets(train: DataFrame, keys: list[str], sizes: tuple[int, ...], sample_id: str = "sample_id", seed: int = 42) -> DataFrame:
    """Training rows once per fit size that includes them (key ``n_train``); subsets are nested.

    A size larger than the cell's table has no rows.
    """
    ids = train.select(*keys, sample_id)
    order = [keyed_hash(seed, F.col(sample_id)), F.col(sample_id)]
    placed = _first(ids, keys, order, max(sizes)).join(ids.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), keys)
    wanted = F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: (F.col("pos") <= s) & (F.col("__n") >= s))
    chosen = placed.select(*keys, sample_id, F.explode(wanted).alias("n_train"))
    return train.join(chosen, [*keys, sample_id])


def repeated_draws(train: DataFrame, keys: list[str], n_sub: int, n_draws: int, sample_id: str = "sample_id", seed: int = 42) -> DataFrame:
    """``n_draws`` independent samples of n_sub rows without replacement (key ``draw``)."""
    ids = train.select(*keys, sample_id)
    # only hashes that can be among the n_sub smallest leave their row: four times as many as are wanted on average, so a
    # draw without enough of them has a chance below e^-28 (and would stop the job)
    share = F.least(F.lit(1.0), (F.lit(4.0 * n_sub) + 100) / F.col("__n"))
    low = lambda d: keyed_hash(seed, d, F.col(sample_id)) <= share * F.lit(float(MODULUS))
    few = ids.join(ids.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), keys).select(
        *keys, sample_id, "__n", F.explode(F.filter(F.sequence(F.lit(0), F.lit(n_draws - 1)), low)).alias("draw")
    )
    order = [keyed_hash(seed, F.col("draw"), F.col(sample_id)), F.col(sample_id)]
    placed = _first(few, [*keys, "draw"], order, n_sub)
    found = F.count(F.lit(1)).over(Window.partitionBy(*keys, "draw"))
    missing = F.raise_error(F.lit("a draw has too few rows")).cast("boolean")
    chosen = placed.withColumn("__found", found).where(F.when(F.col("__found") < F.least(F.lit(n_sub), F.col("__n")), missing).otherwise(True))
    return train.join(chosen.drop("pos", "__found", "__n"), [*keys, sample_id])


def _evaluate(subsets: DataFrame, evaluation: DataFrame, keys: list[str], key: str, by: tuple[str, ...]) -> DataFrame:
    """Fit per (keys, key), score all evaluation rows with every fit, AUROC / FPR95 per fit and ``by``."""
    fit_keys = [*keys, key]
    fit = cut_lineage(ledoit_wolf(subsets, fit_keys))
    stats = fit.select(*fit_keys, "shrinkage", "condition", F.col("n").alias("n_fit"))
    rows = evaluation.select(*keys, *by, "is_id", "feats")
    shape = rows.groupBy(*keys, *by).agg((F.count(F.lit(1)) * F.max(F.size("feats"))).alias("n")).agg(F.max("n")).first()[0] or 0
    if shape <= CELL_ENTRIES and parameter_chunks(fit, fit_keys, ["mean", "factor"]) == [None]:
        return _separability_of_fits(rows, fit, keys, key, by).join(stats, fit_keys)
    scored = mahalanobis_score(rows.join(fit.select(*fit_keys), keys), fit, fit_keys).drop("feats")
    return separability(scored, [*fit_keys, *by]).join(stats, fit_keys)


def _separability_of_fits(rows: DataFrame, fit: DataFrame, keys: list[str], key: str, by: tuple[str, ...]) -> DataFrame:
    """What ``separability`` says of every fit's scores: a cell's vectors are sent once, its scores never leave the task."""
    versions = fit.select(*keys, F.col(key).alias("__version"), "mean", "factor").groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("__version", "mean", "factor"))).alias("__fits")
    )
    cell = [*keys, *by]
    schema = T.StructType(
        [
            *key_fields(rows, keys), T.StructField(key, fit.schema[key].dataType), *key_fields(rows, list(by)),
            *[T.StructField(c, T.DoubleType()) for c in ("auroc", "fpr95", "threshold")],
            *[T.StructField(c, T.LongType()) for c in ("n_id", "n_ood")],
        ]
    )
    renamed = {k: f"{k}__fit" for k in keys}

    def score(part: pa.Table, own: pa.Table) -> pa.Table:
        fits = own.column("__fits")[0].values if part.num_rows and own.num_rows else []
        if not len(fits):
            return pa.Table.from_arrays([pa.array([], f.type) for f in empty], schema=empty)
        x, one = normalized(matrix(part.column("feats").combine_chunks())), pc.fill_null(part.column("is_id"), False).combine_chunks().to_numpy(zero_copy_only=False)
        found = []
        for i in range(len(fits)):
            mean, factor = (np.asarray(fits[i][c].values, dtype=np.float64) for c in ("mean", "factor"))
            root = factor.reshape(len(mean), -1)
            scores = [-np.linalg.norm((x[lo : lo + 8192] - mean) @ root, axis=1) for lo in range(0, len(x), 8192)]
            found.append(_separation(np.concatenate(scores), one))
        heads = {k: part.column(k).combine_chunks().take(pa.array(np.zeros(len(fits), np.int64))) for k in cell}
        heads[key] = fits.field("__version")
        values = [pa.array([f[i] for f in found], t) for i, t in enumerate([pa.float64()] * 3 + [pa.int64()] * 2)]
        return pa.Table.from_arrays([*[heads[k] for k in (*keys, key, *by)], *values], schema=empty)

    empty = to_arrow_schema(schema)
    each = versions.join(rows.select(*cell).distinct(), keys).withColumnsRenamed(renamed)
    each = each.withColumnsRenamed({b: f"{b}__fit" for b in by})
    return rows.groupBy(*cell).cogroup(each.groupBy(*[f"{k}__fit" for k in cell])).applyInArrow(score, schema)


def _separation(s: np.ndarray, one: np.ndarray) -> tuple:
    """AUROC, FPR95, threshold and counts of one fit's scores; None where a side is missing."""
    if not np.isfinite(s).all():
        raise ValueError("non-finite score")
    inside, outside = np.sort(s[one]), np.sort(s[~one])
    n_id, n_ood = len(inside), len(outside)
    auroc = threshold = fpr = None
    if n_id:
        h = ID_TAIL * (n_id - 1)
        low, high = inside[int(np.floor(h))], inside[int(np.ceil(h))]
        threshold = float(low + (h - np.floor(h)) * (high - low))
    if n_ood:
        fpr = float((outside > threshold).sum() / n_ood) if n_id else 0.0
    if n_id and n_ood:
        under, upto = np.searchsorted(outside, inside, side="left"), np.searchsorted(outside, inside, side="right")
        auroc = float((under.sum() + 0.5 * (upto - under).sum()) / (float(n_id) * n_ood))
    return auroc, fpr, threshold, n_id, n_ood


def fit_size_ablation(
    train: DataFrame, evaluation: DataFrame, keys: list[str], sizes: tuple[int, ...] = FIT_SIZES, by: tuple[str, ...] = (), **kw
) -> DataFrame:
    """One fit per cell and size; ``by`` names columns of the evaluation rows (the shift) that share the fits."""
    return _evaluate(nested_subsets(train, keys, sizes, **kw), evaluation, keys, "n_train", by)


REFIT_COLUMNS = (
    "auroc_sub_mean", "auroc_sub_std", "auroc_sub_min", "auroc_sub_max",
    "cond_prec_sub_mean", "cond_prec_sub_std", "shrinkage_sub_mean",
)


def subsample_refits(
    train: DataFrame, evaluation: DataFrame, keys: list[str], n_sub: int, n_draws: int = N_DRAWS, by: tuple[str, ...] = (), **kw
) -> DataFrame:
    """The full fit, and mean and sd of AUROC, conditioning and shrinkage over repeated subsample fits.

    A cell of at most ``n_sub`` training rows is not subsampled: the full fit stands for all draws. ``by`` names columns
    of the evaluation rows (the shift) that share the fits.
    """
    cells = [*keys, *by]
    full = cut_lineage(_evaluate(train.withColumn("__all", F.lit(0)), evaluation, keys, "__all", by)).select(
        *cells,
        F.col("n_fit").alias("n_full"),
        F.col("auroc").alias("auroc_full"),
        F.col("condition").alias("cond_prec_full"),
        F.col("shrinkage").alias("shrinkage_full"),
    )
    large = full.where(F.col("n_full") > n_sub).select(*keys).distinct()
    draws = repeated_draws(train.join(large, keys, "left_semi"), keys, n_sub, n_draws, **kw)
    per = _evaluate(draws, evaluation.join(large, keys, "left_semi"), keys, "draw", by)
    drawn = per.groupBy(*cells).agg(
        F.count(F.lit(1)).alias("n_draws"),
        F.avg("auroc").alias("auroc_sub_mean"),
        F.stddev_samp("auroc").alias("auroc_sub_std"),
        F.min("auroc").alias("auroc_sub_min"),
        F.max("auroc").alias("auroc_sub_max"),
        F.avg("condition").alias("cond_prec_sub_mean"),
        F.stddev_samp("condition").alias("cond_prec_sub_std"),
        F.avg("shrinkage").alias("shrinkage_sub_mean"),
    )
    instead = {"auroc": "auroc_full", "cond_prec": "cond_prec_full", "shrinkage": "shrinkage_full"}
    subsampled = F.col("n_draws").isNotNull()

    def value(name: str) -> Column:
        full_value = F.lit(0.0) if name.endswith("_std") else F.col(instead[name.split("_sub_")[0]])
        return F.when(subsampled, F.col(name)).otherwise(full_value).alias(name)

    return full.join(drawn, cells, "left").select(
        *cells,
        "n_full",
        "auroc_full",
        "cond_prec_full",
        "shrinkage_full",
        subsampled.alias("subsampled"),
        F.when(subsampled, F.lit(n_sub)).otherwise(F.col("n_full")).cast("long").alias("n_sub"),
        F.coalesce("n_draws", F.lit(0)).cast("long").alias("n_draws"),
        *[value(c) for c in REFIT_COLUMNS],
    )


def auroc_against_shared_id(id_rows: DataFrame, ood_rows: DataFrame, keys: list[str], cell: list[str], score: str = "score") -> DataFrame:
    """AUROC of every sweep cell against the one ID sample of its key, without copying ID rows.

    All scores of a key are placed once on the ID distribution; each cell then averages the
    share of ID rows above its own rows (ties one half).
    """
    marks = id_rows.select(*keys, score, F.lit(1).alias("__w")).unionByName(ood_rows.select(*keys, score, F.lit(0).alias("__w")))
    placed = distribution(marks, keys, score, {"n_id": F.col("__w")})
    mine = ood_rows.groupBy(*keys, *cell, score).agg(F.count(F.lit(1)).alias("n_ood"))
    wins = F.col("n_id_total") - F.col("n_id_before") - F.lit(0.5) * F.col("n_id")
    return (
        mine.join(placed, [*keys, score])
        .groupBy(*keys, *cell)
        .agg(
            (F.sum(F.col("n_ood") * wins) / (F.max("n_id_total").cast("double") * F.sum("n_ood"))).alias("auroc"),
            F.max("n_id_total").alias("n_id"),
            F.sum("n_ood").alias("n_ood"),
        )
    )


def severity_correlations(sweep: DataFrame, backbone: str, corruption: str, severity: str, measures: list[str]) -> DataFrame:
    """Spearman of severity with each measure: pooled ('ALL') and per corruption in one pass."""
    both = sweep.withColumn("scope", F.explode(F.array(F.lit("ALL"), F.col(corruption))))
    long = both.unpivot([backbone, "scope", severity], measures, "measure", "value")
    return spearman(long, [backbone, "scope", "measure"], severity, "value")
