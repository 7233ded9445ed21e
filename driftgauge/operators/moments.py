"""Vector sums, centred Gram matrices and the estimators solved from them.

Rows are reduced to d and d x d partials next to the data, partials are merged by
matrix row (so the merge is spread over d tasks per cell), and each cell's d x d
problem is solved in its own task. Nothing here depends on the number of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgauge.operators.kernels import (
    cell_key,
    key_fields,
    key_values,
    list_array,
    matrix,
    merge_fan,
    normalized,
    row_groups,
    typed,
)
from driftgauge.operators import kernels

_DOUBLES = T.ArrayType(T.DoubleType())
FLUSH_BYTES = 256 * 1024 * 1024


def _sum_rows(values: pd.Series) -> np.ndarray:
    return np.sum(np.stack([np.asarray(v, dtype=np.float64) for v in values]), axis=0)


def vector_means(df: DataFrame, keys: list[str], vec: str, normalize: bool = False) -> DataFrame:
    """(keys, n, mean ARRAY<DOUBLE>) per cell."""
    slim = df.select(*keys, cell_key(keys).alias("__cell"), F.col(vec).alias("__v"))
    partial = T.StructType([*key_fields(df, keys), T.StructField("n", T.LongType()), T.StructField("s", _DOUBLES)])
    names = list(keys)

    def partials(batches):
        acc: dict = {}
        for b in batches:
            for cell, rows in row_groups(b.column(b.schema.get_field_index("__cell"))):
                x = matrix(b.column(b.schema.get_field_index("__v")).take(pa.array(rows)))
                x = normalized(x) if normalize else x
                if cell not in acc:
                    acc[cell] = [key_values(b, names, rows[0]), 0, 0.0]
                acc[cell][1] += len(rows)
                acc[cell][2] = acc[cell][2] + x.sum(axis=0)
        if acc:
            vals = list(acc.values())
            cols = [typed([v[0][i] for v in vals]) for i in range(len(names))]
            cols += [pa.array([v[1] for v in vals], pa.int64()), pa.array([v[2] for v in vals], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "n", "s"])

    out = T.StructType([*key_fields(df, keys), T.StructField("n", T.LongType()), T.StructField("mean", _DOUBLES)])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].sum())
        row = {**{k: [pdf[k].iloc[0]] for k in names}, "n": [n], "mean": [_sum_rows(pdf["s"]) / n]}
        return pd.DataFrame(row)

    return slim.mapInArrow(partials, partial).groupBy(*keys).applyInPandas(merge, out)


def collect_vectors(df: DataFrame, keys: list[str], cols: list[str]) -> dict[str, tuple]:
    """Fitted parameters (one row per cell) as a dict for the tasks, size-checked."""
    size = df.agg(F.sum(sum((F.size(c) for c in cols), F.lit(0))).alias("v")).first()["v"] or 0
    limit = kernels.BROADCAST_BYTES
    if size * 8 > limit:
        raise ValueError(f"{size * 8} bytes of fitted vectors exceed the broadcast limit {limit}; fit fewer cells at once")
    table = df.select(cell_key(keys).alias("__cell"), *cols).toArrow()
    cells, found = table.column("__cell").to_pylist(), [table.column(c).combine_chunks() for c in cols]
    return {cell: tuple(c[i].values.to_numpy(zero_copy_only=False).astype(np.float64) for c in found) for i, cell in enumerate(cells)}


def gram_rows(df: DataFrame, keys: list[str], vec: str, centers: dict[str, tuple], normalize: bool = False) -> DataFrame:
    """(keys, n, q4, i, g): row i of sum (x-c)(x-c)^T per cell, with n and sum ||x-c||^4."""
    slim = df.select(*keys, cell_key(keys).alias("__cell"), F.col(vec).alias("__v"))
    names = list(keys)
    shared = df.sparkSession.sparkContext.broadcast(centers)
    schema = T.StructType(
        [
            *key_fields(df, keys),
            T.StructField("i", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("q4", T.DoubleType()),
            T.StructField("g", _DOUBLES),
        ]
    )

    def emit(acc):
        for key, n, q4, g in acc.values():
            cols = [typed([v], len(g)) for v in key]
            cols += [
                pa.array(np.arange(len(g), dtype=np.int32)),
                pa.array([n] * len(g), pa.int64()),
                pa.array([float(q4)] * len(g)),
                list_array(g),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "i", "n", "q4", "g"])

    def partials(batches):
        acc: dict = {}
        held = 0
        for b in batches:
            for cell, rows in row_groups(b.column(b.schema.get_field_index("__cell"))):
                x = matrix(b.column(b.schema.get_field_index("__v")).take(pa.array(rows)))
                x = (normalized(x) if normalize else x) - shared.value[cell][0]
                if cell not in acc:
                    acc[cell] = [key_values(b, names, rows[0]), 0, 0.0, 0.0]
                    held += x.shape[1] ** 2 * 8
                acc[cell][1] += len(rows)
                acc[cell][2] += float(np.sum(np.sum(x * x, axis=1) ** 2))
                acc[cell][3] = acc[cell][3] + x.T @ x
            if held > FLUSH_BYTES:
                yield from emit(acc)
                acc, held = {}, 0
        yield from emit(acc)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {k: [pdf[k].iloc[0]] for k in [*names, "i"]}
        return pd.DataFrame(
            {**row, "n": [int(pdf["n"].sum())], "q4": [float(pdf["q4"].sum())], "g": [_sum_rows(pdf["g"])]}
        )

    found, fan = slim.mapInArrow(partials, schema), merge_fan(df.sparkSession)
    if fan > 1:  # many tasks: their partials meet in two steps, so none gathers one from every task
        dealt = found.withColumn("__part", F.spark_partition_id() % fan)
        found = dealt.groupBy(*keys, "i", "__part").applyInPandas(merge, schema)
    return found.groupBy(*keys, "i").applyInPandas(merge, schema)


def _assemble(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf.sort_values("i")["g"].to_list())


LW_FIELDS = [
    T.StructField("n", T.LongType()),
    T.StructField("dim", T.IntegerType()),
    T.StructField("shrinkage", T.DoubleType()),
    T.StructField("condition", T.DoubleType()),
    T.StructField("eigenvalues", _DOUBLES),
    T.StructField("factor", _DOUBLES),
]


def shrinkage_weight(s: np.ndarray, n: int, q4: float) -> tuple[float, float]:
    """Ledoit-Wolf (2004) weight towards mu*I from the empirical covariance and sum ||x||^4."""
    p = len(s)
    mu = float(np.trace(s)) / p
    sq = float(np.sum(s * s))
    beta = (q4 / n - sq) / (p * n)
    delta = sq / p - mu * mu
    beta = min(beta, delta)
    return (0.0 if beta <= 0 or delta <= 0 else beta / delta), mu


def ledoit_wolf(df: DataFrame, keys: list[str], vec: str = "feats", normalize: bool = True) -> DataFrame:
    """Shrunk covariance per cell: mean, eigenvalues and factor L with precision = L L^T.

    ``factor`` is the d x d matrix V / sqrt(lambda), row-major; column j belongs to
    eigenvalue j (ascending). Two passes: means first, then centred second moments.
    """
    means = vector_means(df, keys, vec, normalize)
    grams = gram_rows(df, keys, vec, collect_vectors(means, keys, ["mean"]), normalize)
    names = list(keys)
    out = T.StructType([*key_fields(df, keys), *LW_FIELDS])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n, q4 = int(pdf["n"].iloc[0]), float(pdf["q4"].iloc[0])
        s = _assemble(pdf) / n
        w, mu = shrinkage_weight(s, n, q4)
        vals, vecs = np.linalg.eigh((1.0 - w) * s + w * mu * np.eye(len(s)))
        ok = vals > np.max(np.abs(vals)) * len(s) * np.finfo(float).eps
        factor = np.where(ok, vecs / np.sqrt(np.where(ok, vals, 1.0)), 0.0)
        return pd.DataFrame(
            {
                **{k: [pdf[k].iloc[0]] for k in names},
                "n": [n],
                "dim": [len(s)],
                "shrinkage": [w],
                "condition": [float(vals[-1] / vals[0]) if vals[0] > 0 else float("inf")],
                "eigenvalues": [vals],
                "factor": [factor.ravel()],
            }
        )

    fit = grams.groupBy(*keys).applyInPandas(solve, out)
    return fit.join(means.select(*keys, "mean"), keys)


def mean_and_covariance(df: DataFrame, keys: list[str], vec: str = "feats") -> DataFrame:
    """(keys, n, mean, cov row-major with ddof 1) per cell."""
    means = vector_means(df, keys, vec)
    grams = gram_rows(df, keys, vec, collect_vectors(means, keys, ["mean"]))
    names = list(keys)
    out = T.StructType([*key_fields(df, keys), T.StructField("n", T.LongType()), T.StructField("cov", _DOUBLES)])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        cov = _assemble(pdf) / max(n - 1, 1)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in names}, "n": [n], "cov": [cov.ravel()]})

    return grams.groupBy(*keys).applyInPandas(solve, out).join(means.select(*keys, "mean"), keys)


def _root(s: np.ndarray) -> np.ndarray:
    vals, vecs = np.linalg.eigh(s)
    return (vecs * np.sqrt(np.clip(vals, 0.0, None))) @ vecs.T


def frechet_distance(df: DataFrame, keys: list[str], side: str = "side", vec: str = "feats") -> DataFrame:
    """Frechet distance between the ID and OOD feature clouds of each cell.

    tr sqrt(S1 S2) equals tr sqrt(S1^1/2 S2 S1^1/2), which is symmetric.
    """
    stats = mean_and_covariance(df, [*keys, side], vec)
    names = list(keys)
    out = T.StructType([*key_fields(df, keys), T.StructField("fid", T.DoubleType())])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.set_index(side)
        a, b = pdf.loc["ID"], pdf.loc["OOD"]
        m1, m2 = np.asarray(a["mean"]), np.asarray(b["mean"])
        d = len(m1)
        s1, s2 = np.asarray(a["cov"]).reshape(d, d), np.asarray(b["cov"]).reshape(d, d)
        r = _root(s1)
        cross = np.sqrt(np.clip(np.linalg.eigvalsh(r @ s2 @ r), 0.0, None)).sum()
        fid = float((m1 - m2) @ (m1 - m2) + np.trace(s1) + np.trace(s2) - 2.0 * cross)
        return pd.DataFrame({**{k: [a[k]] for k in names}, "fid": [fid]})

    return stats.groupBy(*keys).applyInPandas(solve, out)


TOP_EIGEN = 5


def geometry_readout(train: DataFrame, ood: DataFrame, keys: list[str], vec: str = "feats", by: tuple[str, ...] = ()) -> DataFrame:
    """Mean shift, its Mahalanobis length and the share of it in the top-5 eigenspace, for every ``by`` of the shifted rows."""
    fit = ledoit_wolf(train, keys, vec)
    names = [*by, *keys]
    target = vector_means(ood, names, vec, normalize=True).select(
        *names, F.col("n").alias("n_ood"), F.col("mean").alias("mean_ood")
    )
    out = T.StructType(
        [
            *key_fields(ood, names),
            T.StructField("mean_shift", T.DoubleType()),
            T.StructField("maha_mean_shift", T.DoubleType()),
            T.StructField("pct_shift_in_top5_eigenspace", T.DoubleType()),
            T.StructField("n_train", T.LongType()),
            T.StructField("n_ood", T.LongType()),
            T.StructField("feat_dim", T.IntegerType()),
        ]
    )

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        d = int(r["dim"])
        delta = np.asarray(r["mean_ood"]) - np.asarray(r["mean"])
        factor = np.asarray(r["factor"]).reshape(d, d)
        top = (factor * np.sqrt(np.asarray(r["eigenvalues"])))[:, -min(TOP_EIGEN, d) :]
        inside = float(np.sum((delta @ top) ** 2))
        return pd.DataFrame(
            {
                **{k: [r[k]] for k in names},
                "mean_shift": [float(np.linalg.norm(delta))],
                "maha_mean_shift": [float(np.linalg.norm(delta @ factor))],
                "pct_shift_in_top5_eigenspace": [100.0 * inside / (float(delta @ delta) + 1e-12)],
                "n_train": [int(r["n"])],
                "n_ood": [int(r["n_ood"])],
                "feat_dim": [d],
            }
        )

    return fit.join(target, keys).groupBy(*names).applyInPandas(solve, out)
