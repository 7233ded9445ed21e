"""Cosine silhouette of ID versus OOD features, and its label-permutation null.

The mean cosine distance of a row to a class is 1 - x.S/n with S the class's vector sum,
so the silhouette is linear in the rows: no distance matrix, no cap per class.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgauge.functions.draws import keyed_hash_np, wide_hash_np
from driftgauge.operators.kernels import cell_key, key_fields, key_values, list_array, matrix, row_groups, typed, unit
from driftgauge.operators.ordered import prefix_sums, union_all
from driftgauge.operators import kernels
from driftgauge.session import cut_lineage

SHUFFLE_ROUNDS = 16
LABEL_BLOCK = 2_000_000
# Labels shuffled at once: their intermediate numbers stay in a core's cache.
SHUFFLED_AT_ONCE = 64_000
_DOUBLES = T.ArrayType(T.DoubleType())


def _score(x, is_id, n_id, n_ood, s_id, s_ood) -> np.ndarray:
    """Silhouettes (rows, replicates) of unit rows for class sums (replicates, d)."""
    own_n = np.where(is_id, n_id, n_ood)
    to_id, to_ood = x @ s_id.T, x @ s_ood.T
    own, other = np.where(is_id, to_id, to_ood), np.where(is_id, to_ood, to_id)
    a = (own_n - own) / np.maximum(own_n - 1, 1)
    b = 1.0 - other / np.maximum(np.where(is_id, n_ood, n_id), 1)
    top = np.maximum(a, b)
    s = np.where(top > 0, (b - a) / np.where(top > 0, top, 1.0), 0.0)
    return np.where(own_n > 1, s, 0.0)


def shuffled_labels(idx: np.ndarray, n: int, n_id: int, reps: np.ndarray, seed: int) -> np.ndarray:
    """(rows, reps) booleans: is the row ID after shuffling labels in replicate b?

    A swap-or-not shuffle (Hoang, Morris, Rogaway 2012): a keyed bijection of 0..n-1, so
    every replicate has exactly n_id ID rows and rows are labelled independently of each
    other, without sorting or exchanging anything.
    """
    x = np.repeat(np.asarray(idx, dtype=np.int64)[:, None], len(reps), axis=1)
    for r in range(SHUFFLE_ROUNDS):
        k = wide_hash_np(seed, reps, r) % n
        mirror = k[None, :] + n - x
        mirror -= n * (mirror >= n)
        bit = (keyed_hash_np(seed + 1, reps[None, :], r, np.maximum(x, mirror)) >> 10) & 1
        x = np.where(bit == 1, mirror, x)
    return x < n_id


def _packed_labels(df: DataFrame, reps: np.ndarray, seed: int) -> DataFrame:
    """``df`` with the ID labels of all replicates as one bit each (``__bits``), drawn once for both passes."""
    schema = T.StructType([*df.schema.fields, T.StructField("__bits", T.BinaryType())])
    width = max(1, SHUFFLED_AT_ONCE // max(1, len(reps)))

    def draw(batches):
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c))  # noqa: E731, B023
            idx, n, n_id = (col(c).to_numpy(zero_copy_only=False) for c in ("__idx", "n_total", "n_id"))
            bits: list = [None] * b.num_rows
            for _, rows in row_groups(col("__cell")):
                for lo in range(0, len(rows), width):
                    some = rows[lo : lo + width]
                    labels = np.packbits(shuffled_labels(idx[some], int(n[some[0]]), int(n_id[some[0]]), reps, seed), axis=1)
                    for i, own in zip(some, labels, strict=True):
                        bits[i] = own.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bits, pa.binary())], names=[*b.schema.names, "__bits"])

    return df.mapInArrow(draw, schema)


def _labels(bits: pa.Array, reps: np.ndarray) -> np.ndarray:
    """(rows, reps) labels of consecutive replicates (numbered from 1) out of packed bits."""
    first = int(reps[0]) - 1
    packed = np.stack([np.frombuffer(x, np.uint8) for x in bits.to_pylist()])
    own = np.unpackbits(packed[:, first // 8 : (first + len(reps) + 7) // 8], axis=1)
    return own[:, first % 8 : first % 8 + len(reps)].astype(bool)


def _pieces(cells: pa.Array, n_reps: int):
    """Rows by cell, few enough at once that rows x replicates stays small."""
    width = max(1, LABEL_BLOCK // (n_reps + 2))
    for cell, rows in row_groups(cells):
        for lo in range(0, len(rows), width):
            yield cell, rows[lo : lo + width]


def _sum_parts(pdf: pd.DataFrame, col: str) -> np.ndarray:
    return np.sum(np.stack([np.asarray(v) for v in pdf[col]]), axis=0)


def _class_sums(df: DataFrame, keys: list[str], reps: np.ndarray) -> DataFrame:
    """(keys, rep, s): ID vector sum per replicate; rep 0 is the observed labelling, -1 all rows."""
    names = list(keys)
    schema = T.StructType([*key_fields(df, keys), T.StructField("rep", T.IntegerType()), T.StructField("s", _DOUBLES)])
    n_reps = len(reps)
    numbers = np.r_[-1, 0, reps].astype(np.int32)

    def partials(batches):
        acc: dict = {}
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c))  # noqa: E731, B023
            for cell, rows in _pieces(col("__cell"), n_reps):
                take = pa.array(rows)
                x = unit(matrix(col("__v").take(take)))
                labels = np.ones((len(rows), n_reps + 2))
                labels[:, 1] = np.asarray(col("__id").take(pa.array(rows)).to_pylist(), dtype=bool)
                if n_reps:
                    labels[:, 2:] = _labels(col("__bits").take(pa.array(rows)), reps)
                if cell not in acc:
                    acc[cell] = [key_values(b, names, rows[0]), 0.0]
                acc[cell][1] = acc[cell][1] + labels.T @ x
        for key, s in acc.values():
            cols = [typed([v], len(s)) for v in key]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(numbers), list_array(s)], names=[*names, "rep", "s"]
            )

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in [*names, "rep"]}, "s": [_sum_parts(pdf, "s")]})

    return df.mapInArrow(partials, schema).groupBy(*keys, "rep").applyInPandas(merge, schema)


def silhouette_null(
    df: DataFrame, keys: list[str], n_perm: int, vec: str = "feats", is_id: str = "is_id",
    sample_id: str = "sample_id", seed: int = 42,
) -> DataFrame:
    """(keys, rep, silhouette): rep 0 observed, reps 1..n_perm with shuffled labels."""
    base = df.select(*keys, F.col(sample_id), F.col(is_id).alias("__id"), F.col(vec).alias("__v"))
    if n_perm:  # shuffles need each row's position in its cell
        flagged = prefix_sums(base, keys, sample_id, {"n": F.lit(1).cast("bigint"), "m": F.col("__id").cast("bigint")})
    else:
        sizes = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_total"), F.count_if("__id").alias("m_total"))
        flagged = base.join(sizes, keys).withColumn("n_before", F.lit(0).cast("bigint"))
    ready = flagged.select(
        *keys,
        cell_key(keys).alias("__cell"),
        F.col("n_before").alias("__idx"),
        "n_total",
        F.col("m_total").alias("n_id"),
        "__id",
        "__v",
    )
    # class sums of one block of replicates are broadcast: cells x replicates x d, size-checked
    shape = df.groupBy(*keys).agg(F.max(F.size(vec)).alias("d")).agg(F.count(F.lit(1)).alias("cells"), F.max("d").alias("d")).first()
    per_rep = 8 * max(1, shape["cells"]) * max(1, shape["d"] or 1)
    width = max(1, kernels.BROADCAST_BYTES // per_rep - 2)
    if n_perm:
        ready = cut_lineage(_packed_labels(ready, np.arange(1, n_perm + 1, dtype=np.int64), seed))
    blocks = [np.arange(lo, min(lo + width, n_perm + 1), dtype=np.int64) for lo in range(1, n_perm + 1, width)] or [np.arange(0)]
    parts = [_null_block(ready, keys, reps) for reps in blocks]
    return union_all([parts[0], *[p.where("rep > 0") for p in parts[1:]]])


def _null_block(ready: DataFrame, keys: list[str], reps: np.ndarray) -> DataFrame:
    """Silhouettes of rep 0 and of one block of replicates: class sums, then row scores."""
    df, names, n_perm = ready, list(keys), len(reps)
    sums = _class_sums(ready, keys, reps)
    by_cell: dict[str, dict[int, np.ndarray]] = {}
    for r in sums.select(cell_key(keys).alias("__cell"), "rep", "s").collect():
        by_cell.setdefault(r["__cell"], {})[r["rep"]] = np.asarray(r["s"])
    stacked = {c: (v[-1], np.stack([v[int(i)] for i in (0, *reps)])) for c, v in by_cell.items()}
    shared = df.sparkSession.sparkContext.broadcast(stacked)
    schema = T.StructType([*key_fields(df, keys), T.StructField("n", T.LongType()), T.StructField("s", _DOUBLES)])
    numbers = np.r_[0, reps].astype(np.int32)

    def partials(batches):
        acc: dict = {}
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c))  # noqa: E731, B023
            for cell, rows in _pieces(col("__cell"), n_perm):
                whole, s_id = shared.value[cell]
                x = unit(matrix(col("__v").take(pa.array(rows))))
                n, n_id = col("n_total")[int(rows[0])].as_py(), col("n_id")[int(rows[0])].as_py()
                labels = np.empty((len(rows), n_perm + 1), dtype=bool)
                labels[:, 0] = np.asarray(col("__id").take(pa.array(rows)).to_pylist(), dtype=bool)
                if n_perm:
                    labels[:, 1:] = _labels(col("__bits").take(pa.array(rows)), reps)
                s = _score(x, labels, n_id, n - n_id, s_id, whole[None, :] - s_id).sum(axis=0)
                if cell not in acc:
                    acc[cell] = [key_values(b, names, rows[0]), 0, 0.0]
                acc[cell][1] += len(rows)
                acc[cell][2] = acc[cell][2] + s
        for key, n, s in acc.values():
            yield pa.RecordBatch.from_arrays(
                [*[typed([v]) for v in key], pa.array([n], pa.int64()), list_array(s[None, :])], names=[*names, "n", "s"]
            )

    out = T.StructType(
        [*key_fields(df, keys), T.StructField("rep", T.IntegerType()), T.StructField("silhouette", T.DoubleType())]
    )

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        mean = _sum_parts(pdf, "s") / int(pdf["n"].sum())
        return pd.DataFrame(
            {
                **{k: [pdf[k].iloc[0]] * len(mean) for k in names},
                "rep": numbers,
                "silhouette": mean,
            }
        )

    return ready.mapInArrow(partials, schema).groupBy(*keys).applyInPandas(merge, out)


def silhouette(df: DataFrame, keys: list[str], **kw) -> DataFrame:
    return silhouette_null(df, keys, 0, **kw).select(*keys, F.col("silhouette").alias("feature_silhouette_cosine"))


def silhouette_test(df: DataFrame, keys: list[str], n_perm: int = 1000, **kw) -> DataFrame:
    """Observed silhouette with null mean, null sd and p = (hits + 1) / (n_perm + 1)."""
    null = silhouette_null(df, keys, n_perm, **kw)
    obs = null.where("rep = 0").select(*keys, F.col("silhouette").alias("feature_silhouette_cosine"))
    return (
        null.where("rep > 0")
        .join(obs, keys)
        .groupBy(*keys)
        .agg(
            F.max("feature_silhouette_cosine").alias("feature_silhouette_cosine"),
            ((F.count_if(F.col("silhouette") >= F.col("feature_silhouette_cosine")) + 1) / (F.count(F.lit(1)) + 1)).alias(
                "silhouette_perm_p_value"
            ),
            F.avg("silhouette").alias("silhouette_perm_null_mean"),
            F.stddev_pop("silhouette").alias("silhouette_perm_null_std"),
        )
    )
