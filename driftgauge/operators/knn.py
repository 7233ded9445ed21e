"""Exact k-nearest-neighbour join under cosine distance, cut into bounded blocks.

Training vectors are assigned to pivots, and neighbouring pivots are packed into blocks of a bounded size; only a pivot
of more rows than that is cut. A task holds one block, and a group of queries streams past it. A query first goes to the
block of its own pivot. There the rows around that pivot bound its k-th distance, the triangle inequality tells which
pivots can still hold a closer row, and only their rows are compared; the blocks elsewhere that hold such a pivot are
searched in a second round. So a query is sent to a block once at most, whatever the number of pivots, and comes back
with k rows from each, never with its pairs; a cell of one block needs no second round. Training rows are sent once for
each group of queries, and the number of groups follows the cores, not the rows.
Inside a block a short prefix along its principal axes bounds every distance from below, and only rows that the bound
leaves are compared in all dimensions.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.functions.draws import keyed_hash
from driftgauge.operators.kernels import cell_key, matrix, row_groups, unit
from driftgauge.operators.ordered import union_all
from driftgauge.session import cut_lineage

# A training block is about this many bytes, and this many rows at most; a query is sent to a block once at most.
BLOCK_BYTES = 64 * 1024 * 1024
BLOCK_ROWS = 1_048_576
# Queries of a cell are cut into groups of no fewer than this, until there is work for all cores: each gets the blocks.
GROUP_QUERIES = 8192
TASKS_PER_CORE = 4
PIVOT_ROWS = 4096
PIVOT_BYTES = 64 * 1024 * 1024  # of all pivots of all cells, which every task holds
# Tile of one distance matrix inside a task.
TILE_QUERIES, TILE_ROWS = 1024, 8192
MERGE_FAN_IN = 64
# Entries of one matrix of distances from queries to pivots.
PIVOT_TILE = 4_000_000
# Axes of the prefix that bounds distances, used for vectors at least four times as long.
PREFIX = 12
_SLACK = 1e-9


_PAIR = ["__cell", "__tb", "__qb"]
_FOUND = "__cell string, __qid {qid}, __tb int, __d array<double>, __i array<bigint>, __p int, __need array<int>, __bound double, __v array<double>"


def _pivots(train: DataFrame, n_pivots: int, seed: int) -> dict[str, np.ndarray]:
    """A few training vectors per cell, smallest keyed hash first (min-by keeps state small), along their main axis."""
    slot = (keyed_hash(seed, F.col("__tid")) % F.lit(n_pivots)).alias("__slot")
    picked = train.select("__cell", slot, "__tid", "__v").groupBy("__cell", "__slot").agg(F.min_by("__v", "__tid").alias("v"))
    out: dict[str, list] = {}
    for r in picked.orderBy("__cell", "__slot").collect():
        out.setdefault(r["__cell"], []).append(r["v"])
    return {c: _along_axis(unit(np.asarray(v, dtype=np.float64))) for c, v in out.items()}


def _along_axis(v: np.ndarray) -> np.ndarray:
    """Rows in order of their main axis, so that blocks of consecutive pivots lie together."""
    centred = v - v.mean(axis=0)
    return v[np.argsort(centred @ np.linalg.eigh(centred.T @ centred)[1][:, -1], kind="stable")]


def _euclid(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distance between unit rows; sqrt(2 * cosine distance)."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (x @ y.T), 0.0))


class _Layout:
    """Where the rows of a cell's pivots lie: reach, first block and number of blocks of each pivot."""

    def __init__(self, n_pivots: int, found: list[tuple[int, int, float]], block: int):
        self.reach = np.full(n_pivots, -np.inf)
        self.first, self.parts = np.zeros(n_pivots, dtype=np.int64), np.ones(n_pivots, dtype=np.int64)
        self.blocks, used = 0, block  # no block is open yet
        for p, n, radius in sorted(found):
            self.reach[p] = radius
            if used + n > block:
                self.blocks, used = self.blocks + 1, 0
            self.first[p], self.parts[p] = self.blocks - 1, max(1, math.ceil(n / block))
            self.blocks += int(self.parts[p]) - 1
            used = used + n if n <= block else block
        self.groups = 1

    def needed(self, left: np.ndarray, own: int) -> list[list[int]]:
        """The blocks besides ``own`` that hold any of the pivots marked in a row."""
        holds = np.zeros((len(self.first), self.blocks), dtype=np.float32)
        for p in np.flatnonzero(np.isfinite(self.reach)).tolist():
            holds[p, self.first[p] : self.first[p] + self.parts[p]] = 1.0
        wanted = left.astype(np.float32) @ holds > 0
        wanted[:, own] = False
        return [np.flatnonzero(row).tolist() for row in wanted]


def knn_join(
    train: DataFrame,
    queries: DataFrame,
    keys: list[str],
    k: int,
    vec: str = "feats",
    query_id: str = "sample_id",
    train_id: str = "sample_id",
    block: int | None = None,
    seed: int = 17,
) -> DataFrame:
    """(keys, query id, neighbours ARRAY<STRUCT<distance, id>>): the k nearest training rows.

    Ties go to the smaller training id. Fewer than k come back only if the cell has fewer; a query of a cell without
    training rows keeps its row, with no neighbours.
    """
    sc = train.sparkSession.sparkContext
    t = train.select(cell_key(keys).alias("__cell"), F.col(train_id).cast("bigint").alias("__tid"), F.col(vec).alias("__v"))
    q = queries.select(*keys, cell_key(keys).alias("__cell"), F.col(query_id).alias("__qid"), F.col(vec).alias("__v"))
    sizes = t.groupBy("__cell").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("__v")).alias("d"))
    shape = sizes.agg(F.max("n").alias("n"), F.max("d").alias("d"), F.count(F.lit(1)).alias("cells")).first()
    t_block = block or int(min(BLOCK_ROWS, max(4096, BLOCK_BYTES // (8 * max(1, shape["d"] or 1)))))
    # about sqrt(n) pivots in cells that are worth splitting, as far as all cells' pivots fit their bound
    n_cells, n = max(1, shape["cells"]), shape["n"] or 0
    wanted = math.isqrt(n) if n >= 2 * (block or PIVOT_ROWS) else 1
    n_pivots = int(max(1, min(wanted, PIVOT_BYTES // (8 * n_cells * max(1, shape["d"] or 1)))))
    pivots = sc.broadcast(_pivots(t, n_pivots, seed))

    @F.arrow_udf("struct<p:int,d:double>")
    def nearest_pivot(vecs: pa.Array, cells: pa.Array) -> pa.Array:
        p, d = np.zeros(len(vecs), dtype=np.int32), np.zeros(len(vecs))
        for cell, rows in row_groups(cells):
            if cell in pivots.value:
                x = unit(matrix(vecs.take(pa.array(rows))))
                step = max(64, PIVOT_TILE // len(pivots.value[cell]))
                for lo in range(0, len(rows), step):
                    dist = _euclid(x[lo : lo + step], pivots.value[cell])
                    p[rows[lo : lo + step]] = dist.argmin(axis=1)
                    d[rows[lo : lo + step]] = dist.min(axis=1)
        return pa.StructArray.from_arrays([pa.array(p), pa.array(d)], names=["p", "d"])

    t = t.withColumn("__near", nearest_pivot("__v", "__cell")).select(
        "__cell", "__tid", "__v", F.col("__near.p").alias("__p"), F.col("__near.d").alias("__d")
    )
    found: dict[str, list] = {}
    for r in t.groupBy("__cell", "__p").agg(F.count(F.lit(1)).alias("n"), F.max("__d").alias("radius")).collect():
        found.setdefault(r["__cell"], []).append((r["__p"], r["n"], r["radius"]))  # cells x pivots, three numbers each
    layout = {cell: _Layout(len(pivots.value[cell]), own, t_block) for cell, own in found.items()}
    tasks, n_blocks = TASKS_PER_CORE * sc.defaultParallelism, max(1, sum(own.blocks for own in layout.values()))
    for r in q.groupBy("__cell").agg(F.count(F.lit(1)).alias("n")).collect():
        if r["__cell"] in layout:
            layout[r["__cell"]].groups = max(1, min(math.ceil(tasks / n_blocks), r["n"] // GROUP_QUERIES))
    shared = sc.broadcast(layout)

    @F.arrow_udf("struct<first:int,parts:int,groups:int>")
    def places(cells: pa.Array, near: pa.Array) -> pa.Array:
        """Blocks of a pivot and groups of the cell's queries; no group in a cell without training rows."""
        p, out = near.to_numpy(zero_copy_only=False), np.zeros((3, len(near)), dtype=np.int32)
        for cell, rows in row_groups(cells):
            own = shared.value.get(cell)
            if own is not None:
                out[:, rows] = own.first[p[rows]], own.parts[p[rows]], np.full(len(rows), own.groups)
        return pa.StructArray.from_arrays([pa.array(o) for o in out], names=["first", "parts", "groups"])

    at = F.col("__at.first")
    t_side = t.withColumn("__at", places("__cell", "__p")).select(
        "__cell", (at + F.pmod(F.xxhash64("__tid"), F.col("__at.parts"))).cast("int").alias("__tb"), "__p", "__tid", "__v",
        F.col("__at.groups").alias("__groups"),
    )
    home = q.select("__cell", "__qid", "__v", nearest_pivot("__v", "__cell")["p"].alias("__p"))
    home = home.withColumn("__at", places("__cell", "__p")).where("__at.groups > 0").select(
        "__cell", at.alias("__tb"), "__p", "__qid", F.lit(None).cast("double").alias("__bound"), "__v", F.col("__at.groups").alias("__groups")
    )
    top = _search(t_side, home, k, pivots, shared)
    most = max((own.blocks for own in layout.values()), default=1)
    if most > 1:
        first = cut_lineage(top)
        rest = first.where(F.size("__need") > 0).withColumn("__groups", places("__cell", "__p")["groups"]).select(
            "__cell", F.explode("__need").alias("__tb"), "__p", "__qid", "__bound", "__v", "__groups"
        )
        top = union_all([x.select("__cell", "__qid", "__tb", "__d", "__i") for x in (first, _search(t_side, rest, k, pivots, shared))])
    if most > MERGE_FAN_IN:  # merge in two steps so that one query never gathers the tops of all blocks at once
        some = top.groupBy("__cell", "__qid", F.floor(F.col("__tb") / MERGE_FAN_IN).alias("__tb")).agg(_best(k).alias("__top"))
        top = some.select("__cell", "__qid", F.col("__top.distance").alias("__d"), F.col("__top.id").alias("__i"))
    return _finish(q, keys, query_id, top.groupBy("__cell", "__qid").agg(_best(k).alias("__top")))


def _best(k: int):
    """The k nearest of the gathered lists, which travel as plain numbers."""
    both = F.arrays_zip(F.flatten(F.collect_list("__d")), F.flatten(F.collect_list("__i")))
    return F.slice(F.sort_array(both.cast("array<struct<distance:double,id:bigint>>")), 1, k)


def _finish(q: DataFrame, keys: list[str], query_id: str, top: DataFrame) -> DataFrame:
    return (
        q.select(*keys, "__cell", "__qid")
        .join(top, ["__cell", "__qid"], "left")
        .select(*keys, F.col("__qid").alias(query_id), F.coalesce(F.col("__top"), F.array().cast(top.schema["__top"].dataType)).alias("neighbours"))
    )


def _search(t: DataFrame, q: DataFrame, k: int, pivots, layout) -> DataFrame:
    """Top-k per query over the training rows of its target block, no farther than its ``__bound`` if it has one.

    A query without a bound also names the other blocks it needs, and takes its vector and bound along.
    """
    qid_type = q.schema["__qid"].dataType
    t_side = t.select(
        "__cell", "__tb", F.explode(F.sequence(F.lit(0), F.col("__groups") - 1)).alias("__qb"), F.lit(0).alias("__side"), "__p",
        "__tid", F.lit(None).cast(qid_type).alias("__qid"), F.lit(None).cast("double").alias("__bound"), "__v",
    ).where("__qb >= 0")
    q_side = q.select(
        "__cell", "__tb", F.pmod(F.xxhash64("__qid"), F.col("__groups")).cast("int").alias("__qb"), F.lit(1).alias("__side"), "__p",
        F.lit(None).cast("bigint").alias("__tid"), "__qid", "__bound", "__v",
    )

    def top_k(batches):
        key, ids, parts, near, block = None, [], [], [], None
        for batch in batches:
            for own, side, rows in _runs(batch, _PAIR):
                if own != key:
                    key, ids, parts, near, block = own, [], [], [], None
                vectors, p = matrix(rows.column("__v")), rows.column("__p").to_numpy()
                if side == 0:
                    ids.append(rows.column("__tid").to_numpy())
                    parts.append(unit(vectors))
                    near.append(p)
                    continue
                if not ids:
                    continue
                if block is None:
                    block = _Block.of(np.concatenate(ids), np.concatenate(parts), np.concatenate(near))
                    parts, near = [], []
                yield _top_rows(rows, block, unit(vectors), p, k, key, pivots.value[key[0]], layout.value[key[0]])

    return _together(t_side, q_side).mapInArrow(top_k, _FOUND.format(qid=qid_type.simpleString()))


def _top_rows(rows: pa.RecordBatch, block: _Block, x: np.ndarray, p: np.ndarray, k: int, key: tuple, pivots: np.ndarray, own: _Layout) -> pa.RecordBatch:
    bounded = not rows.column("__bound").null_count
    bound = rows.column("__bound").to_numpy(zero_copy_only=False) if bounded else None
    best, near, left = _search_block(x, p, block, k, bound, pivots, own.reach)
    real = np.isfinite(best)
    offsets = pa.array(np.concatenate([[0], np.cumsum(real.sum(axis=1))]).astype(np.int32))
    found = [pa.ListArray.from_arrays(offsets, pa.array(a[real])) for a in (best, block.ids[near])]
    need = [[]] * len(x) if bounded or own.blocks == 1 else own.needed(left, key[1])
    more = np.array([len(n) > 0 for n in need], bool)
    kth = best[:, -1] if best.shape[1] == k else np.full(len(x), np.inf)
    # a vector travels on only if its query does
    vectors = pc.if_else(pa.array(more), rows.column("__v"), pa.scalar(None, rows.column("__v").type))
    columns = [
        rows.column("__cell"), rows.column("__qid"), rows.column("__tb"), *found, rows.column("__p"),
        pa.array(need, pa.list_(pa.int32())), pa.array(kth), vectors.cast(pa.list_(pa.float64())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["__cell", "__qid", "__tb", "__d", "__i", "__p", "__need", "__bound", "__v"])


def _together(t_side: DataFrame, q_side: DataFrame) -> DataFrame:
    """Both sides by block, the training rows of a block before its queries, and queries of one pivot together."""
    return t_side.unionByName(q_side).repartition(*_PAIR).sortWithinPartitions(*_PAIR, "__side", "__p")


def _runs(batch: pa.RecordBatch, pair: list[str]):
    """Consecutive rows of one (pair, side): the pair's values, the side, and the rows."""
    if not batch.num_rows:
        return
    codes = [batch.column(c).dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in (*pair, "__side")]
    change = np.zeros(batch.num_rows, bool)
    for c in codes:
        change[1:] |= c[1:] != c[:-1]
    starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
    for a, b in zip(starts[:-1], starts[1:]):
        rows = batch.slice(a, b - a)
        yield tuple(rows.column(c)[0].as_py() for c in pair), rows.column("__side")[0].as_py(), rows


class _Block:
    """Unit training rows in order of their ids, by pivot, with prefixes along their principal axes."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, axes: np.ndarray | None, near: np.ndarray):
        self.ids, self.rows, self.axes = ids, rows, axes
        if axes is not None:
            self.prefix, self.rest = _prefix(rows, axes)
        self.by_pivot = np.argsort(near, kind="stable")
        self.starts = np.searchsorted(near[self.by_pivot], np.arange(int(near.max(initial=0)) + 2))

    @classmethod
    def of(cls, ids: np.ndarray, rows: np.ndarray, near: np.ndarray | None = None) -> _Block:
        order = np.argsort(ids, kind="stable")
        rows = rows[order]
        axes = None
        if rows.shape[1] >= 4 * PREFIX and len(rows) > PREFIX:
            axes = np.linalg.qr(np.random.default_rng(0).normal(size=(rows.shape[1], PREFIX)))[0]
            for _ in range(4):  # subspace iteration; any orthonormal axes give valid bounds
                axes = np.linalg.qr(rows.T @ (rows @ axes))[0]
        return cls(ids[order], rows, axes, np.zeros(len(ids), np.int32) if near is None else near[order])

    def sizes(self, n_pivots: int) -> np.ndarray:
        """Rows of every pivot of the cell in this block."""
        return np.pad(np.diff(self.starts), (0, n_pivots))[:n_pivots]

    def of_pivots(self, pivots: np.ndarray) -> np.ndarray:
        """Places of the rows of some pivots, in order of their ids."""
        return np.sort(np.concatenate([self.by_pivot[self.starts[p] : self.starts[p + 1]] for p in pivots.tolist()]))


def _prefix(x: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of unit rows along the axes, and the length of what is left."""
    head = x @ axes
    return head, np.sqrt(np.maximum((x * x).sum(axis=1) - (head * head).sum(axis=1), 0.0))


def _search_block(
    x: np.ndarray, home: np.ndarray, block: _Block, k: int, bound: np.ndarray | None, pivots: np.ndarray, reach: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest rows of a block per query, and the pivots of the cell that may hold a row as near as the k-th of them.

    ``bound`` is a distance no neighbour exceeds; without one the rows around the query's pivot give it.
    """
    width, n_pivots = min(k, len(block.ids)), len(pivots)
    best, near = np.full((len(x), width), np.inf), np.zeros((len(x), width), dtype=np.int64)
    left = np.ones((len(x), n_pivots), bool)
    sizes = block.sizes(n_pivots)
    step = max(64, PIVOT_TILE // n_pivots)
    for lo in range(0, len(x), step):
        some = slice(lo, lo + step)
        q, at_home = x[some], home[some]
        groups = [np.flatnonzero(at_home == p) for p in np.unique(at_home)] if n_pivots > 1 else []
        away = _euclid(q, pivots)
        limit = np.full(len(q), np.inf) if bound is None else bound[some]
        if bound is None and width == k:
            limit = limit.copy()
            for own in groups:
                limit[own] = _nearest(q[own], block, k, limit[own], _around(pivots[at_home[own[0]]], block, k, pivots, sizes))[0][:, -1]
        hit = away - reach <= np.sqrt(2.0 * limit)[:, None] + _SLACK
        found, rows = np.full((len(q), width), np.inf), np.zeros((len(q), width), dtype=np.int64)
        wide = hit.astype(np.float32) @ sizes.astype(np.float32) > len(block.ids) / 2 if n_pivots > 1 else np.ones(len(q), bool)
        if wide.any():
            found[wide], rows[wide] = _nearest(q[wide], block, width, limit[wide])
        for own in groups:
            own = own[~wide[own]]
            wanted = np.flatnonzero(hit[own].any(axis=0) & (sizes > 0))
            if len(own) and len(wanted):
                only = block.of_pivots(wanted)
                found[own], rows[own] = _nearest(q[own], block, width, limit[own], only)
        best[some], near[some] = found, rows
        if width == k:
            limit = np.minimum(limit, found[:, -1])
        left[some] = away - reach <= np.sqrt(2.0 * limit)[:, None] + _SLACK
    return best, near, left


def _around(center: np.ndarray, block: _Block, k: int, pivots: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """At least k rows of a block, of the pivots nearest to a place."""
    order = np.argsort(_euclid(center[None, :], pivots)[0], kind="stable")
    enough = int(np.searchsorted(np.cumsum(sizes[order]), 2 * k)) + 1
    return block.of_pivots(order[:enough][sizes[order[:enough]] > 0])


def _nearest(
    x: np.ndarray, block: _Block, width: int, bound: np.ndarray, only: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` smallest cosine distances per row of x and their rows in the block, tile by tile.

    ``only`` names the rows to look at, in order. Places that nothing within the row's bound fills are infinite.
    """
    best, near = np.full((len(x), width), np.inf), np.zeros((len(x), width), dtype=np.int64)
    heads = None if block.axes is None else _prefix(x, block.axes)
    pick = (lambda a: a) if only is None else (lambda a: a[only])
    rows = pick(block.rows)
    fronts, rests = (None, None) if heads is None else (pick(block.prefix), pick(block.rest))
    for lo in range(0, len(x), TILE_QUERIES):
        some = slice(lo, lo + TILE_QUERIES)
        q, d, who, helped = x[some], best[some], near[some], 1
        for at in range(0, len(rows), TILE_ROWS):
            y, take = rows[at : at + TILE_ROWS], None
            limit = np.minimum(bound[some], d[:, -1]) + _SLACK
            if heads is not None and np.isfinite(limit).all() and helped >= 0:
                head, rest = heads[0][some], heads[1][some]
                dot = head @ fronts[at : at + TILE_ROWS].T + rest[:, None] * rests[None, at : at + TILE_ROWS]
                take = np.flatnonzero((1.0 - dot <= limit[:, None]).any(axis=0))
                if not len(take):
                    continue
                take = take if 2 * len(take) < len(y) else None
                helped += -1 if take is None else 1  # a prefix that tells little costs more than it saves
                y = y if take is None else y[take]
            values, mine = _within(q @ y.T, limit, width)
            if not values.shape[1]:
                continue
            places = (mine if take is None else take[mine]) + at
            both, ids = np.hstack([d, values]), np.hstack([who, places])
            keep = _smallest(both, width)
            d, who = np.take_along_axis(both, keep, axis=1), np.take_along_axis(ids, keep, axis=1)
        best[some], near[some] = d, who
    return best, near if only is None or not len(only) else only[np.minimum(near, len(only) - 1)]


def _within(dot: np.ndarray, limit: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Cosine distances that may be among the ``width`` smallest of their row and within its limit, and their columns, in order."""
    if np.isfinite(limit).all():
        row, column = np.nonzero(dot >= (1.0 - limit)[:, None])
        n = np.bincount(row, minlength=len(dot))
        if 4 * n.max(initial=0) <= dot.shape[1]:
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            values, columns = np.full((len(dot), n.max(initial=0)), np.inf), np.zeros((len(dot), n.max(initial=0)), dtype=np.int64)
            values[row, at], columns[row, at] = np.clip(1.0 - dot[row, column], 0.0, 2.0), column
            return values, columns
    tile = np.clip(1.0 - dot, 0.0, 2.0)
    mine = _smallest(tile, min(width, tile.shape[1]))
    return np.take_along_axis(tile, mine, axis=1), mine


def _smallest(dist: np.ndarray, width: int) -> np.ndarray:
    """Column positions of the ``width`` smallest entries per row, ties to the left."""
    if width >= dist.shape[1]:
        return np.argsort(dist, axis=1, kind="stable")[:, :width]
    near = np.sort(np.argpartition(dist, width - 1, axis=1)[:, :width], axis=1)
    near = np.take_along_axis(near, np.argsort(np.take_along_axis(dist, near, axis=1), axis=1, kind="stable"), axis=1)
    kth = np.take_along_axis(dist, near[:, -1:], axis=1)
    for row in np.flatnonzero((dist <= kth).sum(axis=1) > width):  # ties across the cut
        near[row] = np.argsort(dist[row], kind="stable")[:width]
    return near


def knn_distance(
    train: DataFrame, queries: DataFrame, keys: list[str], k: int = 50, vec: str = "feats", query_id: str = "sample_id", **kw
) -> DataFrame:
    """Mean cosine distance to the k nearest training rows (columns keys, query id, mean_distance)."""
    near = knn_join(train, queries, keys, k, vec, query_id, **kw)
    d = F.transform("neighbours", lambda x: x["distance"])
    mean = F.aggregate(d, F.lit(0.0), lambda a, x: a + x) / F.size(d)
    return near.select(*keys, query_id, F.when(F.size(d) > 0, mean).alias("mean_distance"))
