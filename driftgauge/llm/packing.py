"""Operator 9: documents packed into token windows by non-negative least squares.

A document's ids are cut by its length alone: whole windows, then one *unit piece* (the largest multiple of ``unit``
left), then one *tail* shorter than ``unit``. There are few lengths of either kind, so a histogram over all documents
is a bounded table whatever the corpus. Two small programs are solved on it: all combinations of at most ``depth`` unit
pieces that fill a window exactly, and all of at most ``depth`` tails that fill one unit. Non-negative least squares
gives the repeats that explain the histogram best; these are rounded down, and a greedy pass then repeats any
combination that its leftover lengths still allow. What is left after that is cut into powers of two, which together with
the filled units close up without a gap in descending order. So only the last window can be short, and it is cut into
sequences whose lengths are powers of two.

A piece finds its place from its rank among the pieces of its length: rank within its part of the corpus (counted
while encoding) plus the pieces in the parts before. No list of pieces meets in one task, however common a length is.

Nulls: a null text is an empty one (one id, the end id); a null ``doc_id`` keeps its pieces. Repeated rows are packed
each on their own. Only ``doc_id`` and ``text`` are read. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgauge.llm.common import blocks, texts_of, written
from driftgauge.llm.tokens import END_ID, encoder

WINDOW = 2048
UNIT = 64
DEPTH = 5

_PART = (
    "part int, doc_id long, doc_tokens long, whole_rank long, unit_rank long, tail_rank long, "
    "whole_crcs array<long>, unit_crc long, tail_crc long, unit_bits array<long>, tail_bits array<long>"
)
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def combinations(total: int, depth: int) -> list[tuple[int, ...]]:
    """Ways to fill ``total`` with at most ``depth`` lengths from 1 to ``total`` - 1, longest first."""
    found: list[tuple[int, ...]] = []

    def extend(rest: int, most: int, chosen: tuple[int, ...]) -> None:
        if rest == 0:
            found.append(chosen)
        elif len(chosen) < depth:
            for length in range(min(rest, most), 0, -1):
                extend(rest - length, length, (*chosen, length))

    extend(total, total - 1, ())
    return found


def non_negative_least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |a x - b|: an active set grows by the steepest column and drops columns that hit zero."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0.0)))
    for _ in range(3 * a.shape[1]):
        slope = np.where(active, -np.inf, a.T @ (b - a @ x))
        if active.all() or slope.max(initial=-np.inf) <= tolerance:
            break
        active[int(np.argmax(slope))] = True
        while True:
            trial = np.zeros_like(x)
            trial[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            falling = active & (trial <= 1e-12)
            if not falling.any():
                break
            steps = x[falling] / np.maximum(x[falling] - trial[falling], 1e-300)
            x = x + min(1.0, float(steps.min())) * (trial - x)
            active &= x > 1e-12
            x[~active] = 0.0
        x = trial
    return x


def repeats(histogram: np.ndarray, fills: list[tuple[int, ...]]) -> list[tuple[tuple[int, ...], int]]:
    """How often each combination is used: rounded least squares, then greedily what the leftovers allow."""
    uses = np.zeros((len(histogram), len(fills)), np.int64)
    for column, lengths in enumerate(fills):
        np.add.at(uses[:, column], list(lengths), 1)
    wanted = np.floor(non_negative_least_squares(uses.astype(float), histogram.astype(float)) + 1e-6).astype(np.int64)
    left, times = histogram.astype(np.int64).copy(), np.zeros(len(fills), np.int64)

    def take(column: int, most: int | None) -> None:
        rows = np.flatnonzero(uses[:, column])
        able = int((left[rows] // uses[rows, column]).min())
        times[column] += (n := able if most is None else min(able, most))
        left[rows] -= n * uses[rows, column]

    for column in np.argsort(-wanted, kind="stable"):
        take(int(column), int(wanted[column]))
    for column in sorted(range(len(fills)), key=lambda c: (len(fills[c]), c)):
        take(column, None)
    return [(fills[c], int(times[c])) for c in range(len(fills)) if times[c]]


class _Places:
    """Where the r-th piece of a length goes: group number and offset in the group, for the planned ones."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]], size: int):
        runs: list[list[tuple[int, int, int]]] = [[] for _ in range(size)]
        self.taken = np.zeros(size, np.int64)
        self.groups = 0
        for lengths, times in plan:
            offset = 0
            for length in lengths:
                runs[length].append((int(self.taken[length]), self.groups, offset))
                self.taken[length] += times
                offset += length
            self.groups += times
        self._runs = [np.array(r, np.int64).reshape(-1, 3) for r in runs]

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        group, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for n in np.unique(length):
            own, runs = length == n, self._runs[n]
            run = runs[np.searchsorted(runs[:, 0], rank[own], side="right") - 1]
            group[own], offset[own] = run[:, 1] + rank[own] - run[:, 0], run[:, 2]
        return group, offset


class Plan:
    """Places of all pieces, from the counts of whole windows, unit pieces (in units) and tails."""

    def __init__(self, whole: int, units: np.ndarray, tails: np.ndarray, window: int, unit: int, depth: int):
        self.window, self.unit, self.whole = window, unit, whole
        self.units = _Places(repeats(units, combinations(window // unit, depth)), window // unit)
        self.tails = _Places(repeats(tails, combinations(unit, depth)), unit)
        left_units, left_tails = units - self.units.taken, tails - self.tails.taken
        # Powers of two in descending order: first of each size among all, then of each length among those of a size.
        self.sizes = [window >> s for s in range(1, window.bit_length())]
        self._first, self._base, at = {}, {}, 0
        for size in self.sizes:
            per = size // unit if size >= unit else size
            counts = left_units if size >= unit else left_tails
            has = np.array([bool(n & per) for n in range(len(counts))])
            before = np.cumsum(np.where(has, counts, 0)) - np.where(has, counts, 0)
            filled = self.tails.groups if size == unit else 0  # filled units come before left ones
            self._first[size], self._base[size] = at, filled + before
            at += size * (filled + int(np.where(has, counts, 0).sum()))
        self.total = at

    def whole_sequence(self, rank: np.ndarray) -> np.ndarray:
        return rank

    def unit_place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        group, offset = self.units.of(length, rank)
        return self.whole + group, offset * self.unit

    def tail_place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        group, offset = self.tails.of(length, rank)
        sequence, start = self._at(self._first[self.unit] + group * self.unit)
        return sequence, start + offset

    def bit_place(self, size: int, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the power-of-two part of left pieces; ``rank`` counts from the first left piece of the length."""
        return self._at(self._first[size] + size * (self._base[size][length] + rank))

    def _at(self, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence = self.whole + self.units.groups + position // self.window
        offset = position % self.window
        last = position // self.window == self.total // self.window  # the short one, cut at its binary digits
        rest, size, short = self.total % self.window, self.window // 2, 0
        begin, number = np.zeros(len(position), np.int64), np.zeros(len(position), np.int64)
        for at_size in [size >> s for s in range(size.bit_length())]:
            if rest & at_size:
                inside = last & (offset >= short)
                begin[inside], number[inside] = short, number[inside] + (1 if short else 0)
                short += at_size
        return sequence + number, offset - begin


def _bits(n: int, top: int) -> list[int]:
    """Powers of two of ``n``, descending, below ``top``."""
    return [1 << b for b in range(top.bit_length() - 2, -1, -1) if n >> b & 1]


def cut_documents(docs: DataFrame, tokenizer: str | None, end_id: int, window: int, unit: int) -> DataFrame:
    """One row per document: its tokens, the checksums of the pieces it may be cut into, and its ranks in its part."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = encoder(tokenizer), TaskContext.get().partitionId()
        whole_rank, unit_rank, tail_rank = 0, [0] * (window // unit), [0] * unit
        for block in blocks(batches, "text"):
            ids, bounds = words.encode(texts_of(block, "text"), end_id)
            data = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
            rows = []
            for doc_id, first, end in zip(block.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                whole, rest = divmod(end - first, window)
                units, tail = divmod(rest, unit)
                at_unit = first + whole * window
                at_tail = at_unit + units * unit

                def crc(a: int, n: int) -> int:
                    return zlib.crc32(data[4 * a : 4 * (a + n)])

                def bit_crcs(a: int, n: int) -> list[int]:
                    out = []
                    for size in _bits(n, window):
                        out.append(crc(a, size))
                        a += size
                    return out

                rows.append(
                    (
                        part,
                        doc_id,
                        end - first,
                        whole_rank,
                        unit_rank[units],
                        tail_rank[tail],
                        [crc(first + k * window, window) for k in range(whole)],
                        crc(at_unit, units * unit) if units else None,
                        crc(at_tail, tail) if tail else None,
                        bit_crcs(at_unit, units * unit),
                        bit_crcs(at_tail, tail),
                    )
                )
                whole_rank += whole
                unit_rank[units] += 1
                tail_rank[tail] += 1
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int32(), *[pa.int64()] * 5, pa.list_(pa.int64()), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 2]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=[f.split()[0] for f in _PART.split(", ")],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, _PART)


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    window: int = WINDOW,
    unit: int = UNIT,
    depth: int = DEPTH,
) -> DataFrame:
    """Pieces of all ``docs`` (``doc_id``, ``text``) with their sequence and offset. ``window``, ``unit``: powers of two."""
    if window & (window - 1) or unit & (unit - 1) or not 1 < unit < window:
        raise ValueError("window and unit must be powers of two, unit the smaller")
    cuts = written(cut_documents(docs, tokenizer, end_id, window, unit), "packing")
    n_units = window // unit
    rest = F.pmod("doc_tokens", F.lit(window))
    units, tail = F.floor(rest / unit).cast("int"), F.pmod(rest, F.lit(unit)).cast("int")
    # A class for each length of a piece: 0 for whole windows, then unit pieces, then tails.
    unit_class, tail_class = F.when(units > 0, units), F.when(tail > 0, tail + n_units)
    one = F.lit(1).cast("long")
    pieces = F.array(
        F.struct(F.lit(0).alias("class"), F.size("whole_crcs").cast("long").alias("n")),
        F.struct(unit_class.alias("class"), one.alias("n")),
        F.struct(tail_class.alias("class"), one.alias("n")),
    )
    counts = (
        cuts.select("part", F.explode(pieces).alias("c"))
        .select("part", "c.class", "c.n")
        .where("class is not null")
        .groupBy("part", "class")
        .agg(F.sum("n").alias("n"))
    )
    counts = written(counts, "packing-counts")
    histogram = np.zeros(n_units + unit, np.int64)
    for row in counts.groupBy("class").agg(F.sum("n").alias("n")).collect():  # at most window / unit + unit rows
        histogram[row["class"]] = row["n"]
    plan = Plan(int(histogram[0]), np.r_[0, histogram[1:n_units]], np.r_[0, histogram[n_units + 1 :]], window, unit, depth)

    earlier = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        counts.select("part", "class", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"))
        .groupBy("part")
        .agg(F.map_from_entries(F.collect_list(F.struct("class", "n"))).alias("before"))
    )

    def ranked(rank: str, key: Column) -> Column:
        return (F.col(rank) + F.coalesce(F.col("before")[key], F.lit(0))).alias(rank)

    placed = cuts.join(before, "part").select(
        "doc_id",
        "doc_tokens",
        ranked("whole_rank", F.lit(0)),
        ranked("unit_rank", unit_class),
        ranked("tail_rank", tail_class),
        "whole_crcs",
        "unit_crc",
        "tail_crc",
        "unit_bits",
        "tail_bits",
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _pieces(batch, plan)

    return placed.mapInArrow(place, _PIECE)


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return pc.fill_null(batch.column(name), 0).to_numpy(zero_copy_only=False)


def _pieces(batch: pa.RecordBatch, plan: Plan) -> pa.RecordBatch:
    """All pieces of a batch of documents with their places."""
    window, unit = plan.window, plan.unit
    tokens = _numbers(batch, "doc_tokens")
    whole, rest = tokens // window, tokens % window
    units, tails = rest // unit, rest % unit
    found: list[tuple[np.ndarray, ...]] = []  # rows, start, length, checksum, sequence, offset

    rows = np.repeat(np.arange(len(tokens)), whole)
    number = np.arange(len(rows)) - np.repeat(np.cumsum(whole) - whole, whole)
    crcs = batch.column("whole_crcs").flatten().to_numpy(zero_copy_only=False)
    sequence = plan.whole_sequence(_numbers(batch, "whole_rank")[rows] + number)
    found.append((rows, number * window, np.full(len(rows), window), crcs, sequence, np.zeros(len(rows), np.int64)))

    kinds = (
        ("unit", units, plan.units.taken, plan.unit_place, whole * window, unit),
        ("tail", tails, plan.tails.taken, plan.tail_place, whole * window + units * unit, 1),
    )
    for kind, length, taken, place, start, scale in kinds:
        rank, crc = _numbers(batch, f"{kind}_rank"), _numbers(batch, f"{kind}_crc")
        planned = np.flatnonzero((length > 0) & (rank < taken[length]))
        sequence, offset = place(length[planned], rank[planned])
        found.append((planned, start[planned], length[planned] * scale, crc[planned], sequence, offset))
        bits = batch.column(f"{kind}_bits")
        first, bit_crcs = bits.offsets.to_numpy(), bits.values.to_numpy(zero_copy_only=False)
        left = (length > 0) & (rank >= taken[length])
        for size in plan.sizes:
            own = size // scale if size >= scale else 0
            if not own or (kind == "tail" and size >= unit):
                continue
            rows = np.flatnonzero(left & (length & own > 0))
            above = length[rows] & ~(2 * own - 1)
            sequence, offset = plan.bit_place(size, length[rows], rank[rows] - taken[length[rows]])
            crc_at = first[rows] + np.bitwise_count(above)
            found.append((rows, start[rows] + above * scale, np.full(len(rows), size), bit_crcs[crc_at], sequence, offset))

    rows, start, length, crcs, sequence, offset = (np.concatenate(c) for c in zip(*found, strict=True))
    values = [start, length, crcs, tokens[rows], sequence, offset]
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id").take(pa.array(rows)), *(pa.array(v.astype(np.int64)) for v in values)],
        names=[f.split()[0] for f in _PIECE.split(", ")],
    )
