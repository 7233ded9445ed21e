"""Fit per-cell score parameters and score rows with all methods.

``samples(keys..., split, sample_id, label, feats, logits)`` and
``heads(keys..., class, weight, bias)`` in, one row per (sample, method) out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgauge.functions import scores as S
from driftgauge.operators.kernels import (
    cell_key,
    key_fields,
    list_array,
    matrix,
    normalized,
    row_groups,
)
from driftgauge.operators.knn import knn_distance
from driftgauge.operators.moments import collect_vectors, gram_rows, ledoit_wolf, _assemble
from driftgauge.operators.ordered import distribution, union_all
from driftgauge.operators import kernels
from driftgauge.session import cut_lineage

REACT_PERCENTILE = 0.90
VIM_CLIP = 100.0
METHODS = ("msp", "energy", "logit_norm", "react_energy", "vim", "mahalanobis", "knn")
FEATURE_ONLY = ("mahalanobis", "knn")
_DOUBLES = T.ArrayType(T.DoubleType())


def head_arrays(heads: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, weight row-major, bias): one row per cell, classes in order."""
    rows = F.sort_array(F.collect_list(F.struct("class", "weight", F.col("bias").cast("double").alias("bias"))))
    return (
        heads.groupBy(*keys)
        .agg(rows.alias("__h"))
        .select(*keys, F.flatten(F.transform("__h", lambda h: h["weight"])).alias("weight"), F.col("__h.bias").alias("bias"))
    )


def linear_logits(df: DataFrame, heads: DataFrame, keys: list[str], feats: str = "feats", out: str = "logits") -> DataFrame:
    """Logits W x + b by Arrow batches; a one-class head yields [-z, z]. Heads are C x d per cell."""
    params = df.sparkSession.sparkContext.broadcast(collect_vectors(head_arrays(heads, keys), keys, ["weight", "bias"]))

    @F.arrow_udf(_DOUBLES)
    def apply(vecs: pa.Array, cells: pa.Array) -> pa.Array:
        result: list = [None] * len(vecs)
        for cell, rows in row_groups(cells):
            w, b = params.value[cell]
            x = matrix(vecs.take(pa.array(rows)))
            z = x @ w.reshape(len(b), -1).T + b
            z = np.hstack([-z, z]) if z.shape[1] == 1 else z
            if len(rows) == len(vecs):
                return list_array(z)
            for r, line in zip(rows, z):
                result[r] = line
        return pa.array(result, pa.list_(pa.float64()))

    return df.withColumn(out, apply(F.col(feats), cell_key(keys)))


def react_threshold(train: DataFrame, keys: list[str], feats: str = "feats", p: float = REACT_PERCENTILE) -> DataFrame:
    """Percentile over all feature entries of a cell, exact, without sorting them all.

    A mergeable sketch brackets the percentile; a second pass counts the entries below the
    bracket and sorts only those inside. Should the sketch have missed, the bracket opens up.
    """
    entries = train.select(*keys, F.explode(feats).alias("v"))
    margin = 0.005
    while True:
        grid = [max(0.0, p - margin), min(1.0, p + margin)]
        bracket = entries.groupBy(*keys).agg(
            F.percentile_approx("v", grid, 20_000).alias("b"),
            F.min("v").alias("lo"),
            F.max("v").alias("hi"),
            F.count(F.lit(1)).alias("entries"),
        )
        open_low, open_high = grid[0] <= 0.0, grid[1] >= 1.0
        bracket = bracket.select(
            *keys,
            F.col("lo") if open_low else F.col("b")[0].alias("lo"),
            F.col("hi") if open_high else F.col("b")[1].alias("hi"),
            "entries",
        )
        bracket = cut_lineage(bracket)
        # one bracket a cell, as large as other fitted parameters: no entry is exchanged or sorted to meet it
        limits = F.broadcast(bracket)
        tagged = train.select(*keys, F.col(feats).alias("__x")).join(limits, keys)
        under = F.size(F.filter("__x", lambda x: x < F.col("lo")))
        below = tagged.groupBy(*keys).agg(F.sum(under.cast("bigint")).alias("below"), F.max("entries").alias("entries"))
        within = F.filter("__x", lambda x: (x >= F.col("lo")) & (x <= F.col("hi")))
        inside = distribution(tagged.select(*keys, F.explode(within).alias("v")), keys, "v", {"n": F.lit(1)})
        placed = inside.join(below, keys)
        start = F.col("below") + F.col("n_before")
        h = F.lit(float(p)) * (F.col("entries") - 1)
        at = lambda pos: F.max(F.when((start <= pos) & (pos < start + F.col("n")), F.col("v")))
        out = placed.groupBy(*keys).agg(
            at(F.floor(h)).alias("v_lo"), at(F.ceil(h)).alias("v_hi"), F.max(h - F.floor(h)).alias("frac")
        )
        out = cut_lineage(out)
        if out.where("v_lo is null or v_hi is null").isEmpty() or (open_low and open_high):
            return out.select(*keys, (F.col("v_lo") + F.col("frac") * (F.col("v_hi") - F.col("v_lo"))).alias("tau"))
        margin *= 8


def fit_vim(train: DataFrame, heads: DataFrame, keys: list[str], dim: int | None = None) -> DataFrame:
    """Virtual-logit parameters per cell: origin u, residual basis R (row-major), alpha.

    u = -pinv(W) b; R spans the directions after the ``dim`` largest eigenvalues of the
    second moment around u (default: feature width minus classes, at least 1);
    alpha = mean max logit / mean residual norm, over all training rows.
    """
    spark = train.sparkSession
    names = list(keys)
    heads_one = head_arrays(heads, keys)
    origin_schema = T.StructType([*key_fields(heads_one, keys), T.StructField("u", _DOUBLES), T.StructField("classes", T.IntegerType())])

    def origin(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        b = np.asarray(r["bias"])
        w = np.asarray(r["weight"]).reshape(len(b), -1)
        return pd.DataFrame({**{k: [r[k]] for k in names}, "u": [-np.linalg.pinv(w) @ b], "classes": [len(b)]})

    origins = heads_one.groupBy(*keys).applyInPandas(origin, origin_schema)
    grams = gram_rows(train, keys, "feats", collect_vectors(origins, keys, ["u"]))
    basis_schema = T.StructType(
        [*key_fields(train, keys), T.StructField("u", _DOUBLES), T.StructField("basis", _DOUBLES), T.StructField("dim", T.IntegerType())]
    )

    def basis(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        s = _assemble(pdf) / int(r["n"])
        width = len(s)
        keep = width - int(r["classes"]) if dim is None else dim
        keep = max(1, min(keep, width - 1))
        vecs = np.linalg.eigh(s)[1][:, ::-1]
        return pd.DataFrame(
            {**{k: [r[k]] for k in names}, "u": [np.asarray(r["u"])], "basis": [vecs[:, keep:].ravel()], "dim": [keep]}
        )

    fitted = grams.join(origins, keys).groupBy(*keys).applyInPandas(basis, basis_schema)
    params = spark.sparkContext.broadcast(collect_vectors(fitted, keys, ["u", "basis"]))

    @F.arrow_udf("double")
    def residual(vecs: pa.Array, cells: pa.Array) -> pa.Array:
        out = np.empty(len(vecs))
        for cell, rows in row_groups(cells):
            u, r = params.value[cell]
            out[rows] = np.linalg.norm((matrix(vecs.take(pa.array(rows))) - u) @ r.reshape(len(u), -1), axis=1)
        return pa.array(out)

    alpha = (
        train.select(*keys, F.array_max("logits").alias("__top"), residual(F.col("feats"), cell_key(keys)).alias("__res"))
        .groupBy(*keys)
        .agg((F.avg("__top") / (F.avg("__res") + F.lit(1e-12))).alias("alpha"))
    )
    return fitted.join(alpha, keys)


def mahalanobis_score(df: DataFrame, fit: DataFrame, keys: list[str], feats: str = "feats", out: str = "score") -> DataFrame:
    """-||(x/|x| - mean) L|| with the cell's whitening factor; cells go in broadcast-sized chunks."""
    parts = []
    for own in parameter_chunks(fit, keys, ["mean", "factor"]):
        rows, params = (df, fit) if own is None else (df.where(own), fit.where(own))
        shared = df.sparkSession.sparkContext.broadcast(collect_vectors(params, keys, ["mean", "factor"]))

        def kernel(vecs: pa.Array, cell_names: pa.Array, shared=shared) -> pa.Array:
            res = np.empty(len(vecs))
            for cell, at in row_groups(cell_names):
                mean, factor = shared.value[cell]
                white = (normalized(matrix(vecs.take(pa.array(at)))) - mean) @ factor.reshape(len(mean), -1)
                res[at] = -np.linalg.norm(white, axis=1)
            return pa.array(res)

        parts.append(rows.withColumn(out, _distance_udf(kernel)(F.col(feats), cell_key(keys))))
    return union_all([*parts, *([without_fit(df, fit, keys, out)] if len(parts) > 1 else [])])


def without_fit(df: DataFrame, fit: DataFrame, keys: list[str], out: str) -> DataFrame:
    """No rows; stops the job if a row's cell has no parameters (chunks are picked by key, which would lose it)."""
    lost = df.join(fit.select(*keys).distinct(), keys, "left_anti")
    name = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys])
    return lost.withColumn(out, F.raise_error(F.concat(F.lit("no fit for cell "), name)).cast("double"))


def _distance_udf(kernel):
    @F.arrow_udf("double")
    def distance(vecs: pa.Array, cells: pa.Array) -> pa.Array:
        return kernel(vecs, cells)

    return distance


def parameter_chunks(params: DataFrame, keys: list[str], cols: list[str]) -> list[Column | None]:
    """Filters that select groups of cells whose parameters together fit the broadcast limit.

    Plain equality on the keys, so a source partitioned by cell reads each cell once. A
    single ``None`` when everything fits.
    """
    limit = kernels.BROADCAST_BYTES
    size = sum((F.size(c) for c in cols), F.lit(0))
    rows = params.select(*keys, (size * 8).alias("__bytes")).collect()
    chunks: list[list] = [[]]
    used = 0
    for r in rows:
        if chunks[-1] and used + r["__bytes"] > limit:
            chunks.append([])
            used = 0
        chunks[-1].append(r)
        used += r["__bytes"]
    if len(chunks) == 1:
        return [None]
    cell = lambda r: reduce(and_, [F.col(k) == F.lit(r[k]) for k in keys])
    return [reduce(or_, [cell(r) for r in c]) for c in chunks]


# What each score over features needs from the fit, in the order its kernel takes it.
_PARAMETERS = {
    "react_energy": ("weight", "bias", "tau"),
    "vim": ("u", "basis", "weight", "bias", "alpha"),
    "mahalanobis": ("mean", "factor"),
}
_LOGIT_SCORES = {"msp": S.msp, "energy": S.energy, "logit_norm": S.logit_norm}


def _react(x: np.ndarray, weight, bias, tau) -> np.ndarray:
    return _logsumexp(np.minimum(x, tau[0]) @ weight.reshape(len(bias), -1).T + bias)


def _vim(x: np.ndarray, u, basis, weight, bias, alpha) -> np.ndarray:
    residual = np.linalg.norm((x - u) @ basis.reshape(len(u), -1), axis=1)
    return _logsumexp(np.clip(x @ weight.reshape(len(bias), -1).T + bias, -VIM_CLIP, VIM_CLIP)) - alpha[0] * residual


def _mahalanobis(x: np.ndarray, mean, factor) -> np.ndarray:
    return -np.linalg.norm((normalized(x) - mean) @ factor.reshape(len(mean), -1), axis=1)


_KERNELS = {"react_energy": _react, "vim": _vim, "mahalanobis": _mahalanobis}


@dataclass
class ShiftScorerModel:
    """Fitted parameters as DataFrames (one row per cell) plus the training vectors for kNN."""

    keys: list[str]
    k_nearest: int
    methods: tuple[str, ...]
    params: DataFrame | None
    train: DataFrame

    @property
    def _feature_methods(self) -> list[str]:
        return [m for m in _PARAMETERS if m in self.methods]

    def _columns(self) -> list[str]:
        return list(dict.fromkeys(c for m in self._feature_methods for c in _PARAMETERS[m]))

    def _feature_scores(self, samples: DataFrame, params: DataFrame) -> DataFrame:
        cols, methods = self._columns(), self._feature_methods
        table = params.withColumns({c: F.array(c) for c in ("tau", "alpha") if c in cols})
        shared = samples.sparkSession.sparkContext.broadcast(collect_vectors(table, self.keys, cols))

        @F.arrow_udf(f"struct<{','.join(f'{m}:double' for m in methods)}>")
        def score(vecs: pa.Array, cells: pa.Array) -> pa.Array:
            out = np.empty((len(methods), len(vecs)))
            for cell, rows in row_groups(cells):
                own = dict(zip(cols, shared.value[cell]))
                x = matrix(vecs.take(pa.array(rows)))
                for i, m in enumerate(methods):
                    out[i, rows] = _KERNELS[m](x, *[own[c] for c in _PARAMETERS[m]])
            return pa.StructArray.from_arrays([pa.array(o) for o in out], names=methods)

        return samples.withColumn("__f", score(F.col("feats"), cell_key(self.keys)))

    def wide(self, samples: DataFrame, with_knn: bool = True) -> DataFrame:
        """One column per method next to the input columns (feats and logits dropped)."""
        scored, found = samples, self._feature_methods
        if found:
            parts, cols = [], [c for c in self._columns() if c not in ("tau", "alpha")]
            for own in parameter_chunks(self.params, self.keys, cols):
                some, params = (samples, self.params) if own is None else (samples.where(own), self.params.where(own))
                parts.append(self._feature_scores(some, params))
            if len(parts) > 1:
                nothing = without_fit(samples, self.params, self.keys, "__stop")
                kind = parts[0].schema["__f"].dataType
                parts.append(nothing.withColumn("__f", F.when(F.col("__stop").isNotNull(), F.lit(None)).cast(kind)).drop("__stop"))
            scored = union_all(parts)
        logit_scores = [_LOGIT_SCORES[m](F.col("logits")).alias(m) for m in METHODS if m in _LOGIT_SCORES and m in self.methods]
        out = scored.select(
            *[c for c in samples.columns if c not in ("feats", "logits")],
            *logit_scores,
            *[F.col(f"__f.{m}").alias(m) for m in found],
        )
        if not with_knn or "knn" not in self.methods:
            return out
        near = knn_distance(self.train, samples, self.keys, self.k_nearest).select(
            *self.keys, "sample_id", (-F.col("mean_distance")).alias("knn")
        )
        return out.join(near, [*self.keys, "sample_id"], "left")

    def transform(self, samples: DataFrame, with_knn: bool = True) -> DataFrame:
        """Long scores: one row per sample and method."""
        wide = self.wide(samples, with_knn)
        methods = [m for m in METHODS if m in wide.columns]
        ids = [c for c in wide.columns if c not in methods]
        return wide.unpivot(ids, methods, "method", "score")


def _logsumexp(z: np.ndarray) -> np.ndarray:
    top = z.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(z - top).sum(axis=1, keepdims=True)))[:, 0]


class ShiftScorer:
    """Fits what the asked scores need: covariance, clip level, residual space, neighbours.

    ``methods`` defaults to all seven. Without heads (a fit on features alone) the scores over logits and heads are
    left out; asking for one of them by name is an error then.
    """

    def __init__(
        self,
        k_nearest: int = 50,
        react_percentile: float = REACT_PERCENTILE,
        vim_dim: int | None = None,
        methods: tuple[str, ...] | None = None,
    ):
        unknown = set(methods or ()) - set(METHODS)
        if unknown:
            raise ValueError(f"unknown methods {sorted(unknown)}")
        self.k_nearest = k_nearest
        self.react_percentile = react_percentile
        self.vim_dim = vim_dim
        self.methods = methods

    def fit(self, train: DataFrame, heads: DataFrame | None, keys: list[str]) -> ShiftScorerModel:
        methods = self.methods or (METHODS if heads is not None else FEATURE_ONLY)
        if heads is None and set(methods) - set(FEATURE_ONLY):
            raise ValueError(f"{sorted(set(methods) - set(FEATURE_ONLY))} need heads")
        parts = []
        if "mahalanobis" in methods:
            parts.append(ledoit_wolf(train, keys).select(*keys, "mean", "factor", "shrinkage", "condition"))
        if "react_energy" in methods:
            parts.append(react_threshold(train, keys, p=self.react_percentile))
        if "vim" in methods:
            parts.append(fit_vim(train, heads, keys, self.vim_dim).select(*keys, "u", "basis", "alpha"))
        if {"react_energy", "vim"} & set(methods):
            parts.append(head_arrays(heads, keys))
        params = cut_lineage(reduce(lambda x, y: x.join(y, keys), parts)) if parts else None
        return ShiftScorerModel(keys, self.k_nearest, tuple(methods), params, train)
