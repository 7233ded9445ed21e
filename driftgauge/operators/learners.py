"""Keyed logistic regression: linear probes and the domain classifier, all cells and folds at once.

Newton's method on the L2-penalised loss. A round reduces each cell's rows to the gradient and the rows of the Hessian
next to the data, merges them by row and solves each cell in its own task; only the coefficients, whose size is
checked, pass through the driver. A cell's rows are never gathered. Two classes have one coefficient vector, more have
one each; intercepts are not penalised.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.functions.vectors import l2_normalize
from driftgauge.operators import kernels
from driftgauge.operators.kernels import cell_key, list_array, matrix, row_groups
from driftgauge.operators.moments import collect_vectors, vector_means
from driftgauge.operators.sampling import positions
from driftgauge.operators.separability import auroc
from driftgauge.session import cut_lineage

MAX_ROUNDS = 50
TOLERANCE = 1e-8
INTERCEPT_RIDGE = 1e-9

# (group, rows x features with a last column of ones, class numbers, weights)
View = tuple[str, np.ndarray, np.ndarray, np.ndarray]


def with_ones(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def margins(x: np.ndarray, theta: np.ndarray) -> np.ndarray:
    return x @ theta.T


def derivatives(x: np.ndarray, y: np.ndarray, c: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the weighted loss at ``theta`` (blocks, features), flattened block by block."""
    blocks, width = theta.shape
    z = margins(x, theta)
    if blocks == 1:
        p = 1.0 / (1.0 + np.exp(-z[:, 0]))
        return x.T @ (c * (p - y)), x.T @ (x * (c * p * (1.0 - p))[:, None])
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    gradient = ((p - np.eye(blocks)[y]) * c[:, None]).T @ x
    hessian = np.empty((blocks, width, blocks, width))
    for a in range(blocks):
        for b in range(a + 1):
            weight = c * p[:, a] * ((a == b) - p[:, b])
            hessian[a, :, b, :] = x.T @ (x * weight[:, None])
            hessian[b, :, a, :] = hessian[a, :, b, :].T
    return gradient.ravel(), hessian.reshape(blocks * width, blocks * width)


def newton(data: DataFrame, views: Callable[[pa.RecordBatch], Iterator[View]], classes: dict[str, int], ridge: float) -> dict[str, np.ndarray]:
    """Coefficients (blocks, features + 1) of every group that ``views`` makes of the batches."""
    theta: dict[str, np.ndarray] = {}
    sizes: dict[str, float] = {}
    active = {g for g, n in classes.items() if n >= 2}
    for _ in range(MAX_ROUNDS):
        if not active:
            break
        for r in _newton_round(data, views, classes, ridge, theta, sizes, frozenset(active)).collect():
            theta[r["name"]] = np.asarray(r["theta"]).reshape(1 if classes[r["name"]] == 2 else classes[r["name"]], -1)
            sizes[r["name"]] = r["size"]
        if sum(t.size for t in theta.values()) * 8 > kernels.BROADCAST_BYTES:
            raise ValueError("the coefficients of all cells exceed the broadcast limit; fit fewer cells at once")
        active = {g for g in active if sizes.get(g, 0.0) > TOLERANCE}
    return theta


def _newton_round(data, views, classes, ridge, theta, sizes, active) -> DataFrame:
    """(name, size of the step, theta) of every active group after one step; a growing step is halved."""
    shared = data.sparkSession.sparkContext.broadcast((dict(theta), dict(sizes)))

    def start(name: str, width: int) -> np.ndarray:
        found = shared.value[0].get(name)
        return np.zeros((1 if classes[name] == 2 else classes[name], width)) if found is None else found

    def partials(batches):
        acc: dict[str, tuple] = {}
        for batch in batches:
            for name, x, y, c in views(batch):
                if name in active and len(x):
                    g, h = derivatives(x, y, c, start(name, x.shape[1]))
                    old = acc.get(name)
                    acc[name] = (g, h, x.shape[1]) if old is None else (old[0] + g, old[1] + h, x.shape[1])
        for name, (g, h, width) in acc.items():
            n = len(g)
            numbers = [pa.array(np.arange(n, dtype=np.int32)), pa.array([width] * n, pa.int32()), pa.array(g), list_array(h)]
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), *numbers], names=["name", "i", "width", "g", "h"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        head = {c: [pdf[c].iloc[0]] for c in ("name", "i", "width")}
        return pd.DataFrame({**head, "g": [pdf["g"].sum()], "h": [np.sum(np.stack(pdf["h"].to_list()), axis=0)]})

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        name, width = pdf["name"].iloc[0], int(pdf["width"].iloc[0])
        now = start(name, width).ravel()
        penalty = np.where(np.arange(len(now)) % width == width - 1, INTERCEPT_RIDGE, ridge)
        step = np.linalg.solve(np.stack(pdf["h"].to_list()) + np.diag(penalty), pdf["g"].to_numpy() + penalty * now)
        if len(step) > width:  # a shift common to all intercepts changes nothing: they sum to zero
            step[width - 1 :: width] -= step[width - 1 :: width].mean()
        size = float(np.abs(step).max())
        share = 0.5 if size > shared.value[1].get(name, np.inf) else 1.0
        return pd.DataFrame({"name": [name], "size": [size], "theta": [now - share * step]})

    row = "name string, i int, width int, g double, h array<double>"
    rows = data.mapInArrow(partials, row).groupBy("name", "i").applyInPandas(merge, row)
    return rows.groupBy("name").applyInPandas(solve, "name string, size double, theta array<double>")


def fit_probe(train: DataFrame, keys: list[str], feats: str = "feats", label: str = "label", c: float = 1.0) -> DataFrame:
    """Heads (keys, class, weight, bias) of an L2 logistic probe per cell: the sum of losses plus |w|^2 / (2 c).

    Two classes give one head, that of the larger label (``linear_logits`` makes [-z, z] of it).
    """
    data = train.select(*keys, cell_key(keys).alias("__cell"), F.col(feats).alias("x"), F.col(label).cast("double").alias("y"))
    named = cut_lineage(data.groupBy(*keys, "__cell").agg(F.sort_array(F.collect_set("y")).alias("labels")))
    labels = {cell: found for cell, (found,) in collect_vectors(named, keys, ["labels"]).items()}

    def views(batch: pa.RecordBatch) -> Iterator[View]:
        y = batch.column("y").to_numpy(zero_copy_only=False)
        for cell, rows in row_groups(batch.column("__cell")):
            x = with_ones(matrix(batch.column("x").take(pa.array(rows))))
            yield cell, x, np.searchsorted(labels[cell], y[rows]), np.ones(len(rows))

    found = newton(data.select("__cell", "x", "y"), views, {k: len(v) for k, v in labels.items()}, 1.0 / c)
    heads = [
        (cell, int(labels[cell][-1] if len(theta) == 1 else labels[cell][i]), row[:-1].tolist(), float(row[-1]))
        for cell, theta in found.items()
        for i, row in enumerate(theta)
    ]
    table = train.sparkSession.createDataFrame(heads, "__cell string, class int, weight array<double>, bias double")
    return named.join(table, "__cell").select(*keys, "class", "weight", "bias")


def domain_classifier(
    df: DataFrame,
    keys: list[str],
    feats: str = "feats",
    is_id: str = "is_id",
    sample_id: str = "sample_id",
    folds: int = 5,
    seed: int = 42,
) -> DataFrame:
    """Cross-validated AUROC of telling OOD from ID by logistic regression: one row per cell and fold.

    Folds are dealt inside each class in keyed random order, so they are stratified; each fold standardises on its own
    training rows and balances the classes by weight. All cells and folds are fitted in the same rounds.
    """
    dealt = positions(df.select(*keys, is_id, sample_id), [*keys, is_id], sample_id, seed)
    fold = dealt.select(*keys, is_id, sample_id, (F.col("pos") % folds).cast("int").alias("fold"))
    data = cut_lineage(
        df.select(*keys, is_id, sample_id, l2_normalize(F.col(feats)).alias("x"))
        .join(fold, [*keys, is_id, sample_id])
        .select(*keys, cell_key(keys).alias("__cell"), "fold", (~F.col(is_id)).cast("int").alias("y"), "x")
    )
    squares = data.withColumn("x", F.transform("x", lambda v: v * v))
    part = [*keys, "fold"]
    sums, square_sums = (collect_vectors(vector_means(d, part, "x").withColumn("n", F.array("n")), part, ["n", "mean"]) for d in (data, squares))
    counts = data.groupBy("__cell", "fold", "y").count().collect()  # cells x folds x 2
    by_class: dict[str, dict[int, np.ndarray]] = {}  # rows of both classes by cell and fold
    for r in counts:
        by_class.setdefault(r["__cell"], {}).setdefault(r["fold"], np.zeros(2))[r["y"]] = r["count"]
    part_name = {(r["__cell"], r["fold"]): r["part"] for r in data.select("__cell", "fold", cell_key(part).alias("part")).distinct().collect()}
    scale: dict[tuple[str, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for cell, of_fold in by_class.items():
        for f in range(folds):
            others = [part_name[cell, g] for g in range(folds) if g != f and (cell, g) in part_name]
            n = sum(sums[o][0][0] for o in others)
            mean = sum(sums[o][0][0] * sums[o][1] for o in others) / n
            spread = np.sqrt(np.maximum(sum(square_sums[o][0][0] * square_sums[o][1] for o in others) / n - mean * mean, 0.0))
            own = sum(n for g, n in of_fold.items() if g != f)
            scale[cell, f] = mean, np.where(spread > 0, spread, 1.0), own.sum() / (2.0 * np.maximum(own, 1))

    def standardised(batch: pa.RecordBatch, wanted: Callable[[np.ndarray, int], np.ndarray]):
        folds_of, y = batch.column("fold").to_numpy(), batch.column("y").to_numpy()
        for cell, rows in row_groups(batch.column("__cell")):
            x = matrix(batch.column("x").take(pa.array(rows)))
            for f in range(folds):
                own = wanted(folds_of[rows], f)
                mean, spread, weight = scale[cell, f]
                yield cell, f, rows[own], with_ones((x[own] - mean) / spread), y[rows[own]], weight

    def views(batch: pa.RecordBatch) -> Iterator[View]:
        for cell, f, _, x, y, weight in standardised(batch, lambda fold, f: fold != f):
            yield f"{cell}\x1e{f}", x, y, weight[y]

    found = newton(data.select("__cell", "fold", "x", "y"), views, {f"{c}\x1e{f}": 2 for c, f in scale}, 1.0)

    def score(batches):
        for batch in batches:
            out = np.full(batch.num_rows, np.nan)
            for cell, f, rows, x, _, _ in standardised(batch, lambda fold, f: fold == f):
                if f"{cell}\x1e{f}" in found:
                    out[rows] = margins(x, found[f"{cell}\x1e{f}"])[:, 0]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, "fold", "y")), pa.array(out)], names=[*keys, "fold", "y", "score"])

    types = ", ".join(f"{k} {data.schema[k].dataType.simpleString()}" for k in keys)
    scored = data.select(*keys, "__cell", "fold", "x", "y").mapInArrow(score, f"{types + ', ' if keys else ''}fold int, y int, score double")
    return auroc(scored.withColumn("is_id", F.col("y") == 1), [*keys, "fold"])


def classifier_summary(folds: DataFrame, keys: list[str]) -> DataFrame:
    return folds.groupBy(*keys).agg(
        F.avg("auroc").alias("mean_auroc"), F.stddev_pop("auroc").alias("std_auroc"), F.count(F.lit(1)).alias("n_folds")
    )
