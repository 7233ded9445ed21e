"""Operator 3: text quality by gradient-boosted trees over document statistics.

Statistics of whole texts (lengths, shares of symbols, capitals, digits, repeated words and lines, distinct words) are
computed on the executors. A bounded sample of labelled rows, statistics only, trains histogram trees in numpy on the
driver: every statistic is cut into quantile bins, each tree level adds up gradients per node, statistic and bin. The
trees are complete binary trees kept as flat arrays, so scoring walks all rows of a batch down one level with one
indexing step. Rows of a label that the sample thins weigh as much as the rows they stand for, so scores estimate the
share of good documents of the whole labelled table at every size.

Nulls: a null text is an empty one; null labels and ids teach nothing, a repeated label counts once at its smallest
value. Empty texts are scored like others. Repeated rows are all returned; a null id is not held out. If the sample
lacks one of the classes, the score is the smoothed share of good labels (0.5 without labels). Labels, language, source
and id are never inputs of a score. Only the named columns are read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.llm.common import blocks, per_text, texts_of, words_of, written
from driftgauge.llm.quality_rules import SPACES, SYMBOLS, repeated_words
from driftgauge.llm.sampling import bounded_sample, fold

STATISTICS = (
    "log_words",
    "word_chars",
    "word_chars_deviation",
    "distinct_words",
    "commonest_word",
    "single_char_words",
    "caps_words",
    "title_words",
    "symbols",
    "bars",
    "exclamations",
    "points",
    "commas",
    "digits",
    "other_marks",
    "non_ascii",
    "log_lines",
    "words_a_line",
    "dup_lines",
    "repeated_words",
    "marked_words",
    "sentence_starts",
)
CUT = 0.3


def statistics(texts: pa.Array) -> np.ndarray:
    """(texts, statistics) of whole texts."""
    codes, bounds, words = words_of(texts)
    n = np.maximum(np.diff(bounds), 1).astype(float)

    def matches(pattern: str) -> np.ndarray:
        return pc.count_substring_regex(words, pattern).to_numpy(zero_copy_only=False).astype(np.int64)

    def share(of_word: np.ndarray, per: np.ndarray = n) -> np.ndarray:
        return per_text(of_word[codes], bounds) / per

    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    letters, small, big = matches(r"\pL"), matches(r"\p{Ll}"), matches(r"\p{Lu}")
    mean = share(chars)
    deviation = np.sqrt(np.maximum(share(chars * chars) - mean * mean, 0))
    distinct, common = np.zeros(len(n)), np.zeros(len(n))
    lines = np.zeros((len(n), 2))
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if b > a:
            ordered = np.sort(codes[a:b])
            starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
            distinct[i], common[i] = len(starts), np.diff(np.r_[starts, b - a]).max()
    for i, text in enumerate(texts.to_pylist()):
        own = [line for line in text.split("\n") if line.strip(SPACES)]
        lines[i] = len(own), len(own) - len(set(own))
    n_lines = np.maximum(lines[:, 0], 1)
    columns = [
        np.log1p(np.diff(bounds)),
        mean,
        deviation,
        distinct / n,
        common / n,
        share(chars == 1),
        share((letters > 1) & (small == 0)),
        share((big == 1) & (small > 0)),
        share(matches(SYMBOLS)),
        share(matches(r"\|")),
        share(matches("!")),
        share(matches(r"\.")),
        share(matches(",")),
        share(matches(r"\pN")),
        share(matches(r"[^\pL\pN#*$%&|<>!.,]")),
        share(matches(r"[^\x00-\x7F]")),
        np.log1p(lines[:, 0]),
        np.diff(bounds) / n_lines,
        lines[:, 1] / n_lines,
        repeated_words(codes, bounds, len(words)) / n,
        share(matches(r"[^\pL\pN]") > 1),
        share(matches(r"\.") > 0) / np.maximum(share(big > 0), 1e-9),
    ]
    return np.nan_to_num(np.stack(columns, axis=1), nan=0.0, posinf=1e9, neginf=-1e9).astype(np.float64)


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth: inner nodes' statistic and cut, leaves' value; row = tree."""

    base: float
    statistic: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = (self.statistic.shape[1] + 1).bit_length() - 1 if self.statistic.size else 0
        for statistic, cut, leaf in zip(self.statistic, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, statistic[node]] > cut[node])
            total += leaf[node - len(statistic)]
        return 1 / (1 + np.exp(-total))


def fit_trees(
    x: np.ndarray,
    y: np.ndarray,
    rounds: int = 80,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 64,
    ridge: float = 1.0,
    least_weight: float = 1.0,
    weights: np.ndarray | None = None,
) -> Trees:
    """Gradient boosting of the logistic loss on histograms; ``weights`` of rows count relative to their mean."""
    weights = np.ones(len(y)) if weights is None else weights * (len(y) / max(weights.sum(), 1e-9))
    share = ((weights * y).sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    inner = (1 << depth) - 1
    none = Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if not 0 < y.sum() < len(y):
        return none
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)
    slot = binned + bins * np.arange(width)  # value > edges[b] exactly if its bin is over b
    margin = np.full(n, base)
    statistic, cut, leaf = (np.zeros((rounds, s), t) for s, t in ((inner, np.int64), (inner, float), (inner + 1, float)))
    for tree in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = weights * (y - p), weights * p * (1 - p)
        node = np.zeros(n, np.int64)
        cut[tree] = np.inf
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            place = ((node - first)[:, None] * (width * bins) + slot).ravel()
            size = count * width * bins
            g = np.bincount(place, np.repeat(gradient, width), size).reshape(count, width, bins)
            h = np.bincount(place, np.repeat(weight, width), size).reshape(count, width, bins)
            left_g, left_h = g.cumsum(axis=2), h.cumsum(axis=2)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - all_g**2 / (all_h + ridge)
            gain[(left_h < least_weight) | (right_h < least_weight)] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            for c in range(count):
                f, b = divmod(int(best[c]), bins)
                if gain[c, f, b] > 1e-9 and b < len(edges[f]):
                    statistic[tree, first + c], cut[tree, first + c] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), statistic[tree, node]] > cut[tree, node])
        node -= inner
        g, h = np.bincount(node, gradient, inner + 1), np.bincount(node, weight, inner + 1)
        leaf[tree] = rate * g / (h + ridge)
        margin += leaf[tree][node]
    return Trees(base, statistic, cut, leaf)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fit_quality(docs: DataFrame, labels: DataFrame, per_label: int = 20_000, folds: int = 5, held_out: int = 0) -> Trees:
    """Trees from about ``per_label`` labelled documents of each label, outside the held-out fold."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            x = statistics(texts_of(block, "text"))
            yield pa.RecordBatch.from_arrays(
                [*(block.column(c) for c in ("doc_id", "quality", "weight")), pa.array([r.tobytes() for r in x], pa.binary())],
                names=["doc_id", "quality", "weight", "x"],
            )

    known = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .where(fold("doc_id", folds) != held_out)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").cast("int").alias("quality"))
    )
    known = bounded_sample(known, "quality", per_label, weight="weight")
    # two labels of about per_label ids each: sent to the texts, which stay where they are
    rows = _rows(docs).join(F.broadcast(written(known, "labelled-sample")), "doc_id").select("doc_id", "quality", "weight", "text")
    table = rows.mapInArrow(measure, "doc_id long, quality int, weight double, x binary").toArrow()
    if not table.num_rows:
        return fit_trees(np.zeros((0, len(STATISTICS))), np.zeros(0))
    x = np.frombuffer(b"".join(table.column("x").to_pylist())).reshape(table.num_rows, -1)
    y = table.column("quality").to_numpy().astype(float)
    order = np.lexsort((y, *x.T, table.column("doc_id").to_numpy()))  # the order of arrival must not matter
    return fit_trees(x[order], y[order], weights=table.column("weight").to_numpy()[order])


def score_quality(docs: DataFrame, trees: Trees, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and the score of every whole text."""
    inner = [f"kept{i}" for i in range(len(keep))]
    types = "".join(f"{i} {docs.schema[c].dataType.simpleString()}, " for c, i in zip(keep, inner, strict=True))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "own_text"):
            found = trees.score(statistics(texts_of(block, "own_text")))
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in inner), pa.array(found)], names=[*inner, "score"])

    rows = docs.select(
        *[F.col(f"`{c}`").alias(i) for c, i in zip(keep, inner, strict=True)], F.col("text").cast("string").alias("own_text")
    )
    scored = rows.mapInArrow(score, f"{types}score double")
    return scored.select(*[F.col(i).alias(c) for c, i in zip(keep, inner, strict=True)], F.col("score").alias("quality_score"))


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score_quality(_rows(docs), fit_quality(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= cut).cast("int").alias("predicted"),
    )


def good_documents(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``cut``."""
    scored = score_quality(docs, fit_quality(docs, labels), tuple(docs.columns))
    kept = scored.toDF(*[f"c{i}" for i in range(len(docs.columns))], "own_score").where(F.col("own_score") >= cut)
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
