"""Poisson bootstraps that sort the rows once for all replicates.

Replicates are weight columns computed next to the sorted rows, never copies of them.
While all rows fit a task's bound, each cell is one group. Beyond that the value axis is
cut into ranges (a heavy value gets a range of its own, cut further by id): every part
reports a few sums per replicate, parts are chained by prefix sums, and only the parts that
decide a replicate are opened again: those with its percentile (AUROC, FPR95), its last
prefix that meets the target (coverage) or its trim positions (dispersion). Rank correlation
needs both ranks of a row at one place: packed rows go to the task of their cell, or to those
of all pairs of their cell's blocks, which make the weights and both ranks from them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from driftgauge.functions.draws import POISSON_STEPS, PoissonDraws, keyed_hash_np, wide_hash_np
from driftgauge.functions.scores import finite_or_error
from driftgauge.operators.coverage import RISK_EPS
from driftgauge.operators.dispersion import CVID_EPS, TRIM_SHARE
from driftgauge.operators.kernels import key_fields
from driftgauge.operators import ordered
from driftgauge.operators.ordered import prefix_sums, with_ranges
from driftgauge.operators.separability import ID_TAIL
from driftgauge.session import cut_lineage

# Weights held at once by one task; a dozen arrays of that size are alive at a time.
REPLICATE_BLOCK = 500_000
# Draws made at once, of which a task holds a few arrays more.
DRAW_BLOCK = 65_536
# Work for the cores when there are fewer cells than that: replicates are dealt in so many tasks a core, rows copied for each.
TASKS_PER_CORE = 3
# Replicates of a rank correlation that a task takes at least where cells are dealt to several: rows are copied no oftener.
RANK_BLOCK = 125
# Rows that are packed at once, and the id that stands for a missing one.
PACKED_ROWS, NO_ID = 262_144, -(2**63)


def _weights(ids: np.ndarray, reps: np.ndarray, seed: int) -> np.ndarray:
    """(rows, reps) Poisson(1) counts, the same draws as the column expression."""
    out = np.empty((len(ids), len(reps)), np.int64)
    step = max(1, DRAW_BLOCK // max(1, len(reps)))
    for lo in range(0, len(ids), step):
        drawn = keyed_hash_np(seed, reps[None, :], ids[lo : lo + step, None])
        out[lo : lo + step] = np.searchsorted(POISSON_STEPS, drawn, side="right")
    return out


def _sorted_rows(rows: pa.Table):
    s = rows.column("s").to_numpy()
    order = np.argsort(s, kind="stable")
    is_id = np.asarray(rows.column("one").to_pylist(), dtype=bool)[order]
    return s[order], rows.column("sid").to_numpy()[order].astype(np.int64), is_id


def _blocks(n_rows: int, reps: np.ndarray):
    width = max(1, REPLICATE_BLOCK // max(n_rows, 1))
    for lo in range(0, len(reps), width):
        yield reps[lo : lo + width]


def _tie_starts(s: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, s[1:] != s[:-1]])


def _wins(s, one, w):
    """Weighted pair wins (ties one half) and the per-tie-group weights, per replicate."""
    first = _tie_starts(s)
    w_id, w_ood = np.add.reduceat(w * one[:, None], first), np.add.reduceat(w * ~one[:, None], first)
    below = np.cumsum(w_ood, axis=0) - w_ood
    return (w_id * (below + 0.5 * w_ood)).sum(axis=0), w_id, w_ood, s[first]


def _at(values, upto, k):
    """Value at weighted position k (0-based) of each replicate."""
    return values[np.minimum((upto <= k).sum(axis=0), len(values) - 1)]


def _whole_cell(s, one, w):
    wins, w_id, w_ood, values = _wins(s, one, w)
    n_id, n_ood = w_id.sum(axis=0), w_ood.sum(axis=0)
    h = ID_TAIL * (n_id - 1)
    upto = np.cumsum(w_id, axis=0)
    low, high = _at(values, upto, np.floor(h)), _at(values, upto, np.ceil(h))
    thr = low + (h - np.floor(h)) * (high - low)
    with np.errstate(invalid="ignore", divide="ignore"):
        auc = wins / (n_id.astype(float) * n_ood)
        fpr = (w_ood * (values[:, None] > thr[None, :])).sum(axis=0) / n_ood
    ok = (n_id > 0) & (n_ood > 0)
    return np.where(ok, auc, np.nan), np.where(ok, fpr, np.nan)


def bootstrap_separability(
    df: DataFrame, keys: list[str], sample_id: str, n_reps: int = 1000, seed: int = 42, score: str = "score", is_id: str = "is_id"
) -> DataFrame:
    """(keys, rep, auroc, fpr95) for replicates 1..n_reps; NULL where a side drew nothing."""
    slim = df.select(
        *keys, finite_or_error(F.col(score).cast("double"), score).alias("s"), F.col(sample_id).alias("sid"), F.col(is_id).alias("one")
    )
    ranged, needed = with_ranges(slim, "s", "sid")
    if needed:
        return _ranged(ranged, keys, n_reps, seed)

    def kernel(c: dict, w: np.ndarray) -> list[np.ndarray]:
        return list(_whole_cell(c["s"], c["one"], w))

    return _replicates(slim, keys, ["auroc", "fpr95"], kernel, n_reps, seed, order="s")


def _replicates(
    slim: DataFrame, keys: list[str], outputs: list[str], kernel, n_reps: int, seed: int, order: str | None = None
) -> DataFrame:
    """(keys, rep, outputs): a kernel over each cell's columns (sorted by ``order``) and a block of weight columns."""
    schema = T.StructType(
        [*key_fields(slim, keys), T.StructField("rep", T.IntegerType()), *[T.StructField(o, T.DoubleType()) for o in outputs]]
    )
    columns = [c for c in slim.columns if c not in keys]
    all_reps = np.arange(1, n_reps + 1, dtype=np.int64)

    def run(cell: pa.Table) -> pa.Table:
        data = {}
        for c in columns:
            col = cell.column(c)
            data[c] = _numbers(col)
        if order is not None:
            by = np.argsort(data[order], kind="stable")
            data = {c: v[by] for c, v in data.items()}
        ids = data["sid"].astype(np.int64)
        parts = [kernel(data, _weights(ids, reps, seed)) for reps in _blocks(len(ids), all_reps)]
        found = [pa.array(np.concatenate([p[i] for p in parts]), from_pandas=True) for i in range(len(outputs))]
        heads = [cell.column(k).combine_chunks().take(pa.array(np.zeros(n_reps, dtype=np.int64))) for k in keys]
        return pa.Table.from_arrays([*heads, pa.array(all_reps.astype(np.int32)), *found], names=[*keys, "rep", *outputs])

    return slim.groupBy(*keys).applyInArrow(run, schema)


def bootstrap_separability_exact_n(
    df: DataFrame, keys: list[str], pool: list[str], sample_id: str, n_reps: int = 1000, seed: int = 42,
    score: str = "score", is_id: str = "is_id",
) -> DataFrame | None:
    """(keys, rep, auroc, fpr95) of resamples with exactly n draws from each pool of n samples.

    The draws are those of ``multinomial_replicates``, made next to a cell's rows: no row is copied and no draw is
    exchanged. ``keys`` and ``is_id`` must fix the pool. None if a pool or a cell is more than one task can hold.
    """
    samples = df.select(*pool, sample_id).distinct()
    placed = prefix_sums(samples, pool, sample_id, {"n": F.lit(1).cast("bigint")}).select(
        *pool, sample_id, F.col("n_before").alias("__pos"), F.col("n_total").alias("__size")
    )
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if max(largest, placed.agg(F.max("__size")).first()[0] or 0) > ordered.ROWS_PER_RANGE:
        return None
    slim = df.join(placed, [*pool, sample_id]).select(
        *keys, finite_or_error(F.col(score).cast("double"), score).alias("s"), F.col(is_id).alias("one"),
        F.col("__pos").alias("pos"), F.col("__size").alias("size"),
    )
    schema = T.StructType([*key_fields(slim, keys), T.StructField("rep", T.IntegerType()), *[T.StructField(o, T.DoubleType()) for o in ("auroc", "fpr95")]])

    def run(cell: pa.Table) -> pa.Table:
        c = {name: _numbers(cell.column(name)) for name in ("s", "one", "pos", "size")}
        by = np.argsort(c["s"], kind="stable")
        c = {name: v[by] for name, v in c.items()}
        sides = [np.flatnonzero(c["one"]), np.flatnonzero(~c["one"])]
        found = []
        for reps in _blocks(max(len(by), *[int(c["size"][at].max(initial=0)) for at in sides]), np.arange(1, n_reps + 1, dtype=np.int64)):
            w = np.zeros((len(by), len(reps)), np.int64)
            for at in sides:
                if len(at):
                    w[at] = _pool_counts(int(c["size"][at[0]]), reps, seed)[c["pos"][at]]
            auc, fpr = _whole_cell(c["s"], c["one"], w)
            without_id = (w[c["one"]].sum(axis=0) == 0) & (w[~c["one"]].sum(axis=0) > 0)
            found.append((auc, np.where(without_id, 0.0, fpr)))  # nothing is above a threshold that is not there
        heads = [cell.column(k).combine_chunks().take(pa.array(np.zeros(n_reps, dtype=np.int64))) for k in keys]
        values = [pa.array(np.concatenate([f[i] for f in found]), from_pandas=True) for i in range(2)]
        return pa.Table.from_arrays([*heads, pa.array(np.arange(1, n_reps + 1, dtype=np.int32)), *values], names=schema.names)

    return slim.groupBy(*keys).applyInArrow(run, schema)


def _pool_counts(size: int, reps: np.ndarray, seed: int) -> np.ndarray:
    """(size, reps) how often each place of a pool is drawn by its ``size`` draws."""
    counts = np.zeros((size, len(reps)), np.int64)
    for i, rep in enumerate(reps):
        for lo in range(0, size, REPLICATE_BLOCK):
            places = np.arange(lo, min(size, lo + REPLICATE_BLOCK), dtype=np.int64)
            counts[:, i] += np.bincount(wide_hash_np(seed, rep, places) % size, minlength=size)
    return counts


def _numbers(col: pa.ChunkedArray) -> np.ndarray:
    """A column as numbers; a missing flag is false."""
    if pa.types.is_boolean(col.type):
        return pc.fill_null(col, False).combine_chunks().to_numpy(zero_copy_only=False)
    return col.to_numpy()


def bootstrap_spearman(df: DataFrame, keys: list[str], sample_id: str, x: str, y: str, n_reps: int = 1000, seed: int = 42) -> DataFrame:
    """(keys, rep, rho); NULL where a replicate has no spread.

    Rows travel packed, some ten bytes each, once for each share of the replicates; ranks never travel. A cell of up to
    two blocks of rows is held by one task, of larger ones each pair of blocks.
    """
    number = lambda c: F.col(c).cast("double") + F.lit(0.0)  # -0.0 ties with 0.0, yet ranges would part them
    slim = df.select(*keys, F.col(sample_id).cast("bigint").alias("sid"), number(x).alias("x"), number(y).alias("y"))
    cells = slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    held = 2 * ordered.ROWS_PER_RANGE
    few = cells.agg(F.max("__n").alias("n"), F.count(F.lit(1)).alias("cells")).first()
    if (few["n"] or 0) <= held:
        return _whole_spearman(slim, keys, few["cells"], n_reps, seed)
    large = cut_lineage(cells.where(F.col("__n") > held))  # one in so many rows at most
    flagged = _looked_up(slim, large, keys)
    return _whole_spearman(flagged.where("__n IS NULL").drop("__n"), keys, few["cells"], n_reps, seed).unionByName(
        _ranged_spearman(flagged.where("__n IS NOT NULL").drop("__n"), keys, n_reps, seed)
    )


def _whole_spearman(slim: DataFrame, keys: list[str], cells: int, n_reps: int, seed: int) -> DataFrame:
    schema = T.StructType([*key_fields(slim, keys), T.StructField("rep", T.IntegerType()), T.StructField("rho", T.DoubleType())])
    packed, shares = _shared(_packed(slim.withColumn("__block", F.lit(0)), [*keys, "__block"], ["sid", "x", "y"]), cells, n_reps)
    limit = ordered.ROWS_PER_RANGE

    def run(cell: pa.Table) -> pa.Table:
        reps = np.arange(1, n_reps + 1, dtype=np.int64)[cell.column("__share")[0].as_py() :: shares]
        return _table(cell, keys, schema, reps, _rank_correlations(lambda name: _unpacked([cell], name), reps, seed, limit))

    return _dealt(packed, [*keys, "__share"], cells * shares).applyInArrow(run, schema)


def _packed(rows: DataFrame, group: list[str], values: list[str]) -> DataFrame:
    """The rows of a group as a few chunks of packed arrays, made beside the rows."""
    schema = T.StructType([*key_fields(rows, group), *[T.StructField(v, T.BinaryType()) for v in values]])

    def chunks(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        lists = pa.Table.from_batches(held).group_by(group).aggregate([(v, "list") for v in values]).combine_chunks()
        columns = [_only(lists.column(g)) for g in group]
        for v in values:
            each = (pc.fill_null(c.values, NO_ID if v == "sid" else np.nan).to_numpy() for c in lists.column(f"{v}_list"))
            columns.append(pa.array([pa.compress(a.tobytes(), "zstd", asbytes=True) + len(a).to_bytes(8, "little") for a in each], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def pack(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACKED_ROWS:
                yield chunks(held)
                held, n = [], 0
        if n:
            yield chunks(held)

    return rows.select(*group, *values).mapInArrow(pack, schema)


def _only(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()


def _unpacked(tables: list[pa.Table], name: str) -> np.ndarray:
    """A column of packed rows, one table after the other."""
    kind = np.dtype(np.int64 if name == "sid" else np.float64)
    chunks = [c.as_buffer() for t in tables for c in t.column(name)]
    sizes = [int.from_bytes(c[len(c) - 8 :], "little") for c in chunks]
    out, at = np.empty(sum(sizes), kind), 0
    for c, n in zip(chunks, sizes, strict=True):
        out[at : at + n] = np.frombuffer(pa.decompress(c[: len(c) - 8], n * kind.itemsize, "zstd"), kind)
        at += n
    return out


def _refuse_gaps(sorted_values: np.ndarray) -> None:
    """A missing value stops the job where a cell is larger than one range."""
    if len(sorted_values) and np.isnan(sorted_values[-1]):
        raise ValueError("NULL or NaN in a rank correlation")


def _shared(packed: DataFrame, groups: int, n_reps: int) -> tuple[DataFrame, int]:
    """Each chunk once for each share of the replicates, and the number of shares."""
    tasks = TASKS_PER_CORE * packed.sparkSession.sparkContext.defaultParallelism
    shares = max(1, min(-(-n_reps // RANK_BLOCK), -(-tasks // max(1, groups))))
    return packed.withColumn("__share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))), shares


def _dealt(packed: DataFrame, group: list[str], groups: int):
    """Grouped over so many partitions that few groups meet in one."""
    spark = packed.sparkSession
    most = 16 * TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(16 * groups, most))
    return packed.repartition(parts, *group).groupBy(*group)


def _table(rows: pa.Table, keys: list[str], schema: T.StructType, reps: np.ndarray, *values: np.ndarray) -> pa.Table:
    """One row a replicate, under the group's keys."""
    heads = [rows.column(k).combine_chunks().take(pa.array(np.zeros(len(reps), dtype=np.int64))) for k in keys]
    return pa.Table.from_arrays([*heads, pa.array(reps.astype(np.int32)), *[pa.array(v, from_pandas=True) for v in values]], names=schema.names)


def _tie_groups(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted values: the number of each one's tie group, and where each group ends. NaNs are one group."""
    first = np.empty(len(v), bool)
    first[:1] = True
    np.not_equal(v[1:], v[:-1], out=first[1:])
    first[np.searchsorted(v, np.nan) + 1 :] = False
    return np.cumsum(first, dtype=np.int32) - np.int32(1), np.r_[np.flatnonzero(first)[1:] - 1, len(v) - 1].astype(np.int32)


def _codes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the values, the tie group of each in its place, and where each group ends in that order."""
    order = _order(v)
    groups, last = _tie_groups(v[order])
    out = np.empty(len(v), np.int32)
    out[order] = groups
    return order, out, last


def _order(v: np.ndarray) -> np.ndarray:
    return np.argsort(v, kind="stable").astype(np.int32)


def _value_ranks(w: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Average rank minus the mean rank of every tie group of weights in order, the sum of their squares and all weight."""
    upto = np.cumsum(w, dtype=np.int64)[last]
    own = np.diff(upto, prepend=0)
    rank = upto - own / 2.0 - upto[-1] / 2.0
    return rank, float((own * rank * rank).sum()), float(upto[-1])


def _products(w: np.ndarray, a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray) -> float:
    """Sum of w a b over rows whose a and b are those of their groups."""
    total = 0.0
    for lo in range(0, len(w), DRAW_BLOCK):
        here = slice(lo, lo + DRAW_BLOCK)
        ranks = a.take(group_a[here])
        ranks *= w[here]
        ranks *= b.take(group_b[here])
        total += float(ranks.sum())
    return total


def _rank_correlations(column, reps: np.ndarray, seed: int, limit: int) -> np.ndarray:
    """Rank correlation of the rows under the weights of each replicate, NaN without spread.

    The rows are sorted once; a replicate's ranks are those of the distinct values, from their summed weights. ``column``
    gives x, y and sid, one after the other and none kept. A missing value stands above all others in up to ``limit`` rows.
    """
    out = np.full(len(reps), np.nan)
    v = column("x")
    if not len(v):
        return out
    by = _order(v)
    v = v[by]
    if len(v) > limit:
        _refuse_gaps(v)
    group_x, last_x = _tie_groups(v)
    v = column("y")[by]
    by_y, group_y, last_y = _codes(v)
    if len(v) > limit:
        _refuse_gaps(v[by_y[-1:]])
    del v
    draw = PoissonDraws(seed, column("sid")[by])
    del by
    for i, w in enumerate(draw.each(reps)):
        (a, xx, _), (b, yy, _) = _value_ranks(w, last_x), _value_ranks(w[by_y], last_y)
        spread = np.sqrt(xx * yy)
        if spread > 0:
            out[i] = _products(w, a, group_x, b, group_y) / spread
    return out


def _with_blocks(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows with the block of their cell that they belong to, its level, and how many blocks the cell has.

    Blocks are runs of neighbouring ranges. A heavy value has blocks of its own, cut by id: they are of one level, and
    their rows tie with each other. Otherwise a higher level holds higher values.
    """
    limit, single = ordered.ROWS_PER_RANGE, F.min(value) == F.max(value)
    n = rows.count()
    ranged = ordered.cut_into_ranges(rows, value, None, n)
    heavy = [r[0] for r in ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("n"), single.alias("one")).where((F.col("n") > limit) & F.col("one")).collect()]
    if heavy:  # so many rows each, so a short list
        cuts = ordered._cut_points(ranged.where(F.col("__range").isin(heavy)), "sid", 2 * -(-n // limit))
        ranged = ordered._bucketize(ranged.drop("__tie_range"), "sid", "__tie_range", cuts, isolate=False)
        ranged = ranged.withColumn("__tie_range", F.when(F.col("__range").isin(heavy), F.col("__tie_range")).otherwise(F.lit(0)))
    cell, one_range = Window.partitionBy(*keys), Window.partitionBy(*keys, "__range")
    parts = ranged.groupBy(*keys, *_PART).agg(F.count(F.lit(1)).alias("n"))
    parts = parts.select(
        *keys, *_PART, ((F.sum("n").over(one_range) > limit) & F.col("__range").isin(heavy)).alias("heavy"),
        F.coalesce(F.sum("n").over(cell.orderBy("__range").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"),
        (F.sum("n").over(one_range.orderBy("__tie_range")) - F.col("n")).alias("inside"),
    )
    step, piece = F.floor(F.col("below") / limit), F.when(F.col("heavy"), F.floor(F.col("inside") / limit)).otherwise(0)
    placed = parts.select(
        *keys, *_PART, F.dense_rank().over(cell.orderBy(step, "heavy")).alias("__level"),
        (F.dense_rank().over(cell.orderBy(step, "heavy", piece)) - 1).alias("__block"),
    )
    placed = cut_lineage(placed.withColumn("__blocks", F.max("__block").over(cell) + 1))
    return _looked_up(ranged, placed, [*keys, *_PART]).drop(*_PART)


def _looked_up(rows: DataFrame, small: DataFrame, names: list[str]) -> DataFrame:
    """Rows with the other columns of a small table, NULL without a partner; NULL keys are equal."""
    same = F.lit(True)
    for n in names:
        same = same & rows[n].eqNullSafe(F.col(f"{n}__q"))
    return rows.join(F.broadcast(_renamed(small, names)), same, "left").drop(*_other(names))


_BLOCK = ["__block", "__level", "__blocks"]


def _ranged_spearman(slim: DataFrame, keys: list[str], n_reps: int, seed: int) -> DataFrame:
    """Cells of any size, from sums over pairs of blocks of rows.

    A centred rank is the sum of centred counts against each block. On x these are known but for a number a block and
    replicate, which depends on the weights of lower and higher blocks alone; on y two blocks are counted against each
    other where both are held. Squares of y's ranks come from blocks of their own.
    """
    part = [*keys, "__block", "__level", "rep"]
    names = ["u", "v", "w", "q"]
    by_x = _packed(_with_blocks(slim, keys, "x"), [*keys, *_BLOCK], ["sid", "x", "y"])
    by_y = _packed(_with_blocks(slim, keys, "y"), [*keys, *_BLOCK], ["sid", "y"])
    sums = T.StructType([*key_fields(by_x, part[:-1]), T.StructField("rep", T.IntegerType()), *[T.StructField(n, T.DoubleType()) for n in names]])
    other = F.explode(F.expr("filter(sequence(0, __blocks - 1), b -> b <> __block)"))
    pairs = by_x.withColumn("__other", other).withColumns({"__p": F.least("__block", "__other"), "__r": F.greatest("__block", "__other")})
    groups = -(-slim.count() // ordered.ROWS_PER_RANGE)
    pairs, shares = _shared(pairs, groups, n_reps)
    singles, single_shares = _shared(by_y, groups, n_reps)

    def crossed(rows: pa.Table) -> pa.Table:
        reps = np.arange(1, n_reps + 1, dtype=np.int64)[rows.column("__share")[0].as_py() :: shares]
        p, r, n = (rows.column(c)[0].as_py() for c in ("__p", "__r", "__blocks"))
        sides = [rows.filter(pc.equal(rows.column("__block"), pa.scalar(b, rows.column("__block").type))) for b in (p, r)]
        own = (r == p + 1, r == p + 1 == n - 1)  # each block is counted against itself in one of its pairs
        found = _cross_sums(len(_unpacked(sides[:1], "sid")), lambda name: _unpacked(sides, name), own, reps, seed)
        return pa.concat_tables([_table(side, part[:-1], sums, reps, *f) for side, f in zip(sides, found, strict=True)])

    def squared(rows: pa.Table) -> pa.Table:
        reps = np.arange(1, n_reps + 1, dtype=np.int64)[rows.column("__share")[0].as_py() :: single_shares]
        v = _unpacked([rows], "y")
        by = _order(v)
        (_, last), draw = _tie_groups(v[by]), PoissonDraws(seed, _unpacked([rows], "sid")[by])
        squares, weights = np.array([_value_ranks(w, last)[1:] for w in draw.each(reps)]).T
        return _table(rows, part[:-1], sums, reps, np.zeros(len(reps)), np.zeros(len(reps)), weights, squares)

    def chained(frame: DataFrame) -> DataFrame:
        """Sums over a cell's blocks, with each block's place among the others: half the weight below less that above."""
        blocks = frame.groupBy(*part).agg(*[F.sum(n).alias(n) for n in names])
        cell = Window.partitionBy(*keys, "rep")
        below = F.coalesce(F.sum("w").over(cell.orderBy("__level").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        upto = F.sum("w").over(cell.orderBy("__level").rangeBetween(Window.unboundedPreceding, 0))
        placed = blocks.withColumn("place", (below + upto - F.sum("w").over(cell)) / 2.0)
        a = F.col("place")
        return placed.groupBy(*keys, "rep").agg(F.sum(F.col("u") + a * F.col("v")).alias("xy"), F.sum(F.col("q") + a * a * F.col("w")).alias("squares"))

    cross = chained(_dealt(pairs, [*keys, "__p", "__r", "__share"], groups * shares).applyInArrow(crossed, sums))
    yy = chained(_dealt(singles, [*keys, "__block", "__share"], groups * single_shares).applyInArrow(squared, sums))
    cell = [*keys, "rep"]
    squares = _renamed(yy.select(*cell, F.col("squares").alias("yy")), cell)
    same = F.lit(True)
    for n in cell:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}__q"))
    spread = F.sqrt(F.col("squares") * F.col("yy"))
    return cross.join(squares, same).select(*cell, F.when(spread > 0, F.col("xy") / spread).alias("rho"))


def _cross_sums(n: int, column, own: tuple[bool, bool], reps: np.ndarray, seed: int) -> list[np.ndarray]:
    """For each of two blocks, the first ``n`` rows and the others, and each replicate: u = sum of w a b and v = sum of w b,
    where a is a row's centred rank on x in its block and b its centred count on y against the other block (for u, if
    ``own``, its own too); if ``own``, w and the sum of w a a, else zeros."""
    x = column("x")
    by = np.r_[_order(x[:n]), n + _order(x[n:])]
    x, y = x[by], column("y")[by]
    draw = PoissonDraws(seed, column("sid")[by])
    halves = [slice(0, n), slice(n, len(by))]
    groups = [_tie_groups(x[h]) for h in halves]
    by_y, group_y, last_y = _codes(y)
    for v in (x[:n], x[n:], y[by_y[-1:]]):
        _refuse_gaps(v)
    del x, y, v, by, by_y
    found = np.zeros((2, 4, len(reps)))
    for i, w in enumerate(draw.each(reps)):
        ranks = [_value_ranks(w[h], last) for h, (_, last) in zip(halves, groups, strict=True)]
        counts = [np.bincount(group_y[h], w[h], len(last_y)) for h in halves]
        centred = [np.cumsum(c) - c / 2.0 - c.sum() / 2.0 for c in counts]
        for s, h in enumerate(halves):
            against = centred[1 - s] + centred[s] if own[s] else centred[1 - s]
            a, squares, weight = ranks[s]
            u = _products(w[h], a, groups[s][0], against, group_y[h])
            found[s, :, i] = u, (counts[s] * centred[1 - s]).sum(), weight * own[s], squares * own[s]
    return list(found)


def _other(names: list[str]) -> list[str]:
    return [f"{n}__q" for n in names]


def _renamed(df: DataFrame, names: list[str]) -> DataFrame:
    """The keys of the other side of a cogroup, under names of their own."""
    return df.withColumnsRenamed(dict(zip(names, _other(names), strict=True)))


def _answers(rows: DataFrame, asked: DataFrame, group: list[str], keys: list[str], outputs: list[str], kernel, seed: int) -> DataFrame:
    """(keys, rep, outputs): a kernel over a part's columns, the weights of the asked replicates and the questions."""
    schema = T.StructType(
        [*key_fields(rows, keys), T.StructField("rep", T.IntegerType()), *[T.StructField(o, T.DoubleType()) for o in outputs]]
    )
    columns = [c for c in rows.columns if c not in group]

    def answer(part: pa.Table, questions: pa.Table) -> pa.Table:
        reps = questions.column("rep").to_numpy().astype(np.int64)
        if not len(reps):  # no replicate is decided here
            return pa.Table.from_arrays([pa.array([], f.type) for f in empty], schema=empty)
        data = {c: part.column(c).to_numpy(zero_copy_only=False) for c in columns}
        asks = {c: questions.column(c).to_numpy(zero_copy_only=False) for c in questions.column_names if c not in _other(group)}
        ids, found = data["sid"].astype(np.int64), []
        width = max(1, REPLICATE_BLOCK // len(ids))
        for lo in range(0, len(reps), width):
            some = slice(lo, lo + width)
            found.append(kernel(data, _weights(ids, reps[some], seed), {c: a[some] for c, a in asks.items()}))
        heads = [part.column(k).combine_chunks().take(pa.array(np.zeros(len(reps), np.int64))) for k in keys]
        values = [pa.array(np.concatenate([f[i] for f in found]), from_pandas=True) for i in range(len(outputs))]
        return pa.Table.from_arrays([*heads, pa.array(reps.astype(np.int32)), *values], names=schema.names)

    empty = to_arrow_schema(schema)
    needed = rows.join(asked.select(*group).distinct(), group, "left_semi")
    return needed.groupBy(*group).cogroup(_renamed(asked, group).groupBy(*_other(group))).applyInArrow(answer, schema)


def _last_prefix(wrong: np.ndarray, w: np.ndarray, limit: float, n0: np.ndarray, e0: np.ndarray) -> np.ndarray:
    """Longest prefix whose risk meets the limit, 0 if none; weights are copies, and n0 rows with e0 errors come before.

    Copies of a wrong row only raise the risk: within one the best prefix is the longest still under the limit.
    """
    n, e = n0 + np.cumsum(w, axis=0), e0 + np.cumsum(w * wrong[:, None], axis=0)
    with np.errstate(invalid="ignore", divide="ignore"):
        whole = np.where((w > 0) & (e / n <= limit), n, 0)
    before, errors = n - w, e - w * wrong[:, None]
    room = np.floor((limit * before - errors) / (1.0 - limit))
    inside = np.where((w > 1) & wrong[:, None] & (room >= 1), before + np.minimum(room, w), 0)
    return np.maximum(whole, inside).max(axis=0)


def bootstrap_coverage(
    df: DataFrame, keys: list[str], sample_id: str, target: float = 0.10, n_reps: int = 1000, seed: int = 42,
    score: str = "score", correct: str = "correct",
) -> DataFrame:
    """(keys, rep, coverage): the largest share of rows, by descending score and ties by id, whose risk meets the target.

    0 where no prefix does, NULL where nothing was drawn. A part of the score axis reports its rows, its errors and the
    least of errors - limit * rows over its prefixes; with the sums before it that tells whether one of its prefixes
    meets the target, and only the last such part of each replicate is opened.
    """
    limit = target + RISK_EPS
    slim = df.select(
        *keys, finite_or_error(F.col(score).cast("double"), score).alias("s"), F.col(sample_id).cast("bigint").alias("sid"),
        (F.col(correct).cast("double") < 1.0).alias("wrong"),
    )
    rows, needed = with_ranges(slim, "s", "sid")

    def ordered_rows(c: dict) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((c["sid"], -c["s"]))
        return order, c["wrong"][order].astype(bool)

    def whole_cell(c: dict, w: np.ndarray) -> list[np.ndarray]:
        order, wrong = ordered_rows(c)
        zero, n = np.zeros(w.shape[1]), w.sum(axis=0)
        return [np.where(n > 0, _last_prefix(wrong, w[order], limit, zero, zero) / np.maximum(n, 1), np.nan)]

    if not needed:
        return _replicates(slim, keys, ["coverage"], whole_cell, n_reps, seed)

    def summary(c: dict, w: np.ndarray) -> list[np.ndarray]:
        order, wrong = ordered_rows(c)
        w = w[order]
        n, e = np.cumsum(w, axis=0), np.cumsum(w * wrong[:, None], axis=0)
        # after a right row's last copy, or after a wrong row's first
        first = np.where(wrong[:, None], w - 1, 0)
        least = np.where(w > 0, (e - first) - limit * (n - first), np.inf).min(axis=0)
        return [n[-1].astype(float), e[-1].astype(float), least]

    group, cell = [*keys, *_PART], [*keys, "rep"]
    parts = _replicates(rows, group, ["w", "e", "least"], summary, n_reps, seed)
    by_rep = Window.partitionBy(*cell)
    before = by_rep.orderBy(F.col("__range").desc(), F.col("__tie_range")).rowsBetween(Window.unboundedPreceding, -1)
    chained = cut_lineage(
        parts.select(
            *group, "rep", "least", F.sum("w").over(by_rep).alias("n"),
            F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("n0"), F.coalesce(F.sum("e").over(before), F.lit(0.0)).alias("e0"),
        )
    )
    meets = F.col("e0") - F.lit(limit) * F.col("n0") + F.col("least") <= 0
    last = chained.where(meets).groupBy(*cell).agg(F.max_by(F.struct(*_PART, "n0", "e0", "n"), F.struct("n0", -F.col("__range"), "__tie_range")).alias("p"))

    def opened(c: dict, w: np.ndarray, q: dict) -> list[np.ndarray]:
        order, wrong = ordered_rows(c)
        return [_last_prefix(wrong, w[order], limit, q["n0"], q["e0"]) / q["n"]]

    found = _answers(rows, last.select(*keys, "rep", "p.*"), group, keys, ["coverage"], opened, seed)
    every = chained.groupBy(*cell).agg(F.max("n").alias("n"))
    known = found.select(*cell, F.col("coverage").alias("__c"))
    return every.join(known, cell, "left").select(*cell, F.when(F.col("n") > 0, F.coalesce("__c", F.lit(0.0))).alias("coverage"))


def _weighted_trim(v: np.ndarray, w: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Trimmed mean and population std per weight column (weights are copies)."""
    order = np.argsort(v, kind="stable")
    v, w = v[order][:, None], w[order]
    upto, n = np.cumsum(w, axis=0), w.sum(axis=0)
    k = np.floor(share * n)
    whole = (n < 3) | (k <= 0) | (2 * k >= n)
    kept = np.where(whole, w, np.clip(np.minimum(upto, n - k) - np.maximum(upto - w, k), 0, None))
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = (kept * v).sum(axis=0) / kept.sum(axis=0)
        return mean, np.sqrt((kept * (v - mean) ** 2).sum(axis=0) / kept.sum(axis=0))


def bootstrap_dispersion_gap(df: DataFrame, keys: list[str], sample_id: str, n_reps: int = 1000, seed: int = 42, side: str = "side") -> DataFrame:
    """(keys, rep, cvid_gap, logit_gap_gap): OOD minus ID, from rows with logit_norm and logit_gap.

    NULL where a side drew nothing.
    """
    slim = df.select(*keys, F.col(sample_id).alias("sid"), (F.col(side) == "OOD").alias("ood"), "logit_norm", "logit_gap")

    def kernel(c: dict, w: np.ndarray) -> list[np.ndarray]:
        stats = []
        for mine in (c["ood"], ~c["ood"]):
            mean, std = _weighted_trim(c["logit_norm"][mine], w[mine], TRIM_SHARE)
            stats.append((std / (np.abs(mean) + CVID_EPS), _weighted_trim(c["logit_gap"][mine], w[mine], TRIM_SHARE)[0]))
        return [stats[0][i] - stats[1][i] for i in (0, 1)]

    measures = ["logit_norm", "logit_gap"]
    long = slim.unpivot([*keys, "sid", "ood"], measures, "measure", "v").withColumn("v", F.col("v").cast("double"))
    rows, needed = with_ranges(long, "v", "sid", source=slim)
    if not needed:
        return _replicates(slim, keys, ["cvid_gap", "logit_gap_gap"], kernel, n_reps, seed)
    stats = _ranged_trim(rows, [*keys, "ood", "measure"], n_reps, seed)
    stat = F.when(F.col("measure") == "logit_norm", F.col("std") / (F.abs("mean") + F.lit(CVID_EPS))).otherwise(F.col("mean"))
    of = lambda name, ood: F.max(F.when((F.col("measure") == name) & (F.col("ood") == F.lit(ood)), stat))
    return stats.groupBy(*keys, "rep").agg(
        (of("logit_norm", True) - of("logit_norm", False)).alias("cvid_gap"), (of("logit_gap", True) - of("logit_gap", False)).alias("logit_gap_gap")
    )


def _ranged_trim(rows: DataFrame, keys: list[str], n_reps: int, seed: int) -> DataFrame:
    """(keys, rep, mean, std) of what the trim leaves: parts inside count by their sums, the parts at either end are opened.

    Squares are taken from each cell's mean, so that they may be added over parts.
    """
    centre = rows.groupBy(*keys).agg(F.avg("v").alias("centre"))
    rows = cut_lineage(rows.join(centre, keys))
    group, cell = [*keys, *_PART], [*keys, "rep"]

    def sums(c: dict, w: np.ndarray) -> list[np.ndarray]:
        d = (c["v"] - c["centre"])[:, None]
        return [w.sum(axis=0).astype(float), (w * d).sum(axis=0), (w * d * d).sum(axis=0)]

    parts = _replicates(rows, group, ["w", "s1", "s2"], sums, n_reps, seed)
    by_rep = Window.partitionBy(*cell)
    before = by_rep.orderBy(*_PART).rowsBetween(Window.unboundedPreceding, -1)
    n, k = F.col("n"), F.floor(F.lit(TRIM_SHARE) * F.col("n")).cast("double")
    whole = (n < 3) | (k <= 0) | (2 * k >= n)
    chained = parts.select(*group, "rep", "w", "s1", "s2", F.sum("w").over(by_rep).alias("n"), F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("b"))
    first = F.when(whole, F.lit(0.0)).otherwise(F.least("w", F.greatest(F.lit(0.0), k - F.col("b"))))
    end = F.when(whole, F.col("w")).otherwise(F.greatest(F.lit(0.0), F.least("w", n - k - F.col("b"))))
    chained = cut_lineage(chained.select(*group, "rep", "w", "s1", "s2", first.alias("first"), end.alias("end")))
    inside = (F.col("first") == 0) & (F.col("end") == F.col("w"))

    def cut(c: dict, w: np.ndarray, q: dict) -> list[np.ndarray]:
        order = np.argsort(c["v"], kind="stable")
        d, w = (c["v"] - c["centre"])[order][:, None], w[order]
        upto = np.cumsum(w, axis=0)
        kept = np.clip(np.minimum(upto, q["end"]) - np.maximum(upto - w, q["first"]), 0, None)
        return [kept.sum(axis=0), (kept * d).sum(axis=0), (kept * d * d).sum(axis=0)]

    asked = chained.where(~inside & (F.col("first") < F.col("end"))).select(*group, "rep", "first", "end")
    opened = _answers(rows, asked, group, keys, ["w", "s1", "s2"], cut, seed)
    every = chained.where(inside).select(*cell, "w", "s1", "s2").unionByName(opened)
    total = every.groupBy(*cell).agg(*[F.sum(c).alias(c) for c in ("w", "s1", "s2")]).join(centre, keys)
    mean = F.try_divide("s1", "w")
    return total.select(
        *cell, (F.col("centre") + mean).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.try_divide("s2", "w") - mean * mean)).alias("std")
    )


_PART = ["__range", "__tie_range"]


def _ranged(rows: DataFrame, keys: list[str], n_reps: int, seed: int) -> DataFrame:
    group = [*keys, *_PART]
    all_reps = np.arange(1, n_reps + 1, dtype=np.int64)
    bigints, doubles = T.ArrayType(T.LongType()), T.ArrayType(T.DoubleType())
    part_schema = T.StructType(
        [
            *key_fields(rows, group),
            T.StructField("vmin", T.DoubleType()),
            T.StructField("vmax", T.DoubleType()),
            T.StructField("wins", doubles),
            T.StructField("w_id", bigints),
            T.StructField("w_ood", bigints),
        ]
    )

    def summarize(part: pa.Table) -> pa.Table:
        s, ids, one = _sorted_rows(part)
        found = []
        for reps in _blocks(len(s), all_reps):
            wins, w_id, w_ood, _ = _wins(s, one, _weights(ids, reps, seed))
            found.append((wins, w_id.sum(axis=0), w_ood.sum(axis=0)))
        wins, w_id, w_ood = (np.concatenate([f[i] for f in found]) for i in range(3))
        head = [part.column(k).combine_chunks().slice(0, 1) for k in group]
        tail = [
            pa.array([float(s[0])]), pa.array([float(s[-1])]), pa.array([wins], pa.list_(pa.float64())),
            pa.array([w_id], pa.list_(pa.int64())), pa.array([w_ood], pa.list_(pa.int64())),
        ]
        return pa.Table.from_arrays([*head, *tail], names=part_schema.names)

    parts = rows.groupBy(*group).applyInArrow(summarize, part_schema)
    flat = parts.select(
        *keys, "__range", "vmin", "vmax", F.posexplode(F.arrays_zip("wins", "w_id", "w_ood")).alias("p", "z")
    ).select(*keys, "__range", "vmin", "vmax", (F.col("p") + 1).alias("rep"), "z.wins", "z.w_id", "z.w_ood")
    # parts of one heavy score pair with each other too: half of all their pairs
    single = F.min("vmin") == F.max("vmax")
    ranges = flat.groupBy(*keys, "rep", "__range").agg(
        F.min("vmin").alias("vmin"),
        F.max("vmax").alias("vmax"),
        F.when(single, F.lit(0.5) * F.sum("w_id") * F.sum("w_ood")).otherwise(F.sum("wins")).alias("wins"),
        F.sum("w_id").alias("w_id"),
        F.sum("w_ood").alias("w_ood"),
    )
    w = Window.partitionBy(*keys, "rep").orderBy("__range")
    before, whole = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n_id = F.sum("w_id").over(whole)
    h = F.lit(ID_TAIL) * (n_id - 1)
    chained = cut_lineage(
        ranges.select(
            *keys, "rep", "__range", "vmin", "vmax", "wins", "w_id", "w_ood",
            F.coalesce(F.sum("w_id").over(before), F.lit(0)).alias("id_before"),
            F.coalesce(F.sum("w_ood").over(before), F.lit(0)).alias("ood_before"),
            n_id.alias("n_id"),
            F.sum("w_ood").over(whole).alias("n_ood"),
            F.floor(h).alias("k_lo"),
            F.ceil(h).alias("k_hi"),
            (h - F.floor(h)).alias("frac"),
        )
    )
    cell = [*keys, "rep"]
    pairs = F.max("n_id").cast("double") * F.max("n_ood")
    auc = chained.groupBy(*cell).agg(
        F.try_divide(F.sum(F.col("wins") + F.col("w_id") * F.col("ood_before")), pairs).alias("auroc"), F.max("frac").alias("frac")
    )
    ends = F.explode(F.array(F.struct(F.lit("lo").alias("end"), F.col("k_lo").alias("k")), F.struct(F.lit("hi").alias("end"), F.col("k_hi").alias("k"))))
    wanted = (
        chained.select(*cell, "__range", "vmin", "vmax", "id_before", "w_id", ends.alias("e"))
        .select(*cell, "__range", "vmin", "vmax", (F.col("e.k") - F.col("id_before")).cast("bigint").alias("pos"), "w_id", "e.end")
        .where("pos >= 0 and pos < w_id")
    )
    single_value = F.col("vmin") == F.col("vmax")
    known = wanted.where(single_value).select(*cell, "end", F.col("vmin").alias("v"))
    opened = _open_ranges(rows, wanted.where(~single_value).select(*cell, "__range", "end", F.col("pos").cast("double").alias("q")), keys, seed, "value")
    values = known.unionByName(opened.select(*cell, "end", F.col("found").alias("v")))
    pick = lambda e: F.max(F.when(F.col("end") == e, F.col("v")))
    limits = values.groupBy(*cell).agg(pick("lo").alias("lo"), pick("hi").alias("hi"))
    thr = cut_lineage(
        auc.join(limits, cell, "left").select(*cell, "auroc", (F.col("lo") + F.col("frac") * (F.col("hi") - F.col("lo"))).alias("thr"))
    )
    placed = chained.join(thr.select(*cell, "thr"), cell)
    outside = placed.groupBy(*cell).agg(
        F.sum(F.when(F.col("vmin") > F.col("thr"), F.col("w_ood")).otherwise(0)).alias("above"), F.max("n_ood").alias("n_ood")
    )
    cut = placed.where("vmin <= thr and thr < vmax").select(*cell, "__range", F.lit("above").alias("end"), F.col("thr").alias("q"))
    inside = _open_ranges(rows, cut, keys, seed, "above").select(*cell, F.col("found").alias("more"))
    return (
        thr.join(outside, cell)
        .join(inside, cell, "left")
        .select(
            *cell, "auroc", F.try_divide(F.col("above") + F.coalesce(F.col("more"), F.lit(0.0)), F.col("n_ood")).alias("__f"), "thr"
        )
        .select(*cell, "auroc", F.when(F.col("thr").isNotNull(), F.col("__f")).alias("fpr95"))
    )


def _open_ranges(rows: DataFrame, asked: DataFrame, keys: list[str], seed: int, what: str) -> DataFrame:
    """Answer per-replicate questions inside their range: the value at a weighted ID position,
    or the OOD weight above a threshold. Heavy single-value ranges never get here."""
    group = [*keys, "__range"]
    schema = T.StructType(
        [*key_fields(asked, [*keys, "rep", "end"]), T.StructField("found", T.DoubleType())]
    )

    def answer(part: pa.Table, questions: pa.Table) -> pa.Table:
        reps = questions.column("rep").to_numpy().astype(np.int64)
        q = questions.column("q").to_numpy()
        found = np.zeros(len(reps))
        if len(part) and len(reps):
            s, ids, one = _sorted_rows(part)
            width = max(1, REPLICATE_BLOCK // len(s))
            for lo in range(0, len(reps), width):
                w = _weights(ids, reps[lo : lo + width], seed)
                here = q[lo : lo + width]
                if what == "value":
                    found[lo : lo + width] = _at(s, np.cumsum(w * one[:, None], axis=0), here)
                else:
                    found[lo : lo + width] = (w * ~one[:, None] * (s[:, None] > here[None, :])).sum(axis=0)
        cols = [questions.column(k) for k in (*keys, "rep", "end")]
        return pa.Table.from_arrays([*cols, pa.chunked_array([pa.array(found)])], names=schema.names)

    needed = rows.join(asked.select(*group).distinct(), group, "left_semi")
    return needed.groupBy(*group).cogroup(asked.groupBy(*group)).applyInArrow(answer, schema)
