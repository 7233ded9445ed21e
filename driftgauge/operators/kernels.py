"""Arrow batch helpers: vectors in, small numeric results out.

Only dense linear algebra lives here; Spark partitions the rows and merges the results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NORM_EPS = 1e-8
# Upper bound for anything that is broadcast by hand (fitted parameters).
BROADCAST_BYTES = 512 * 1024 * 1024
_SEP = "\x1f"


def cell_key(keys: list[str]) -> Column:
    """One string that names a cell, for looking up its parameters inside a task; a NULL key stops the job."""

    def part(k: str) -> Column:
        stop = F.raise_error(F.lit(f"NULL in the grouping key {k}"))
        return F.coalesce(F.replace(F.col(k).cast("string"), F.lit(_SEP), F.lit(_SEP + _SEP)), stop.cast("string"))

    return F.concat_ws(_SEP + "/", *[part(k) for k in keys]) if keys else F.lit("")


def matrix(vectors: pa.Array) -> np.ndarray:
    """(rows, dim) float64 view of a list array whose rows share one length."""
    if len(vectors) == 0:
        return np.empty((0, 0))
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float64).reshape(len(vectors), -1)


def normalized(x: np.ndarray, eps: float = NORM_EPS) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + eps)


def unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1.0)


def row_groups(cells: pa.Array):
    """Yield (cell name, row positions) for the cells present in a batch."""
    enc = cells.dictionary_encode() if not pa.types.is_dictionary(cells.type) else cells
    codes = enc.indices.to_numpy(zero_copy_only=False)
    for code, name in enumerate(enc.dictionary.to_pylist()):
        yield name, np.flatnonzero(codes == code)


def list_array(x: np.ndarray) -> pa.Array:
    rows, width = x.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(0, (rows + 1) * width, width, dtype=np.int32)), pa.array(np.ascontiguousarray(x).ravel())
    )


def key_values(batch: pa.RecordBatch, names: list[str], row: int) -> list[pa.Scalar]:
    """The key columns of one row as typed scalars (they go back out with the same types)."""
    return [batch.column(batch.schema.get_field_index(n))[int(row)] for n in names]


def typed(scalars: list[pa.Scalar], repeat: int = 1) -> pa.Array:
    """One column from typed scalars, each repeated."""
    out = pa.array([s.as_py() for s in scalars], type=scalars[0].type)
    return out if repeat == 1 else out.take(pa.array(np.repeat(np.arange(len(scalars)), repeat)))


def key_fields(df: DataFrame, keys: list[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def merge_fan(spark) -> int:
    """How many groups partial results meet in before they meet in one: 1 on a small cluster."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16)
