"""Operator 10: quality rules whose cutoffs carry a guarantee on false rejections.

Every rule compares one statistic of a text with a cutoff. A quarter of the labelled rows (by a hash of the text, all of
them, counted by the steps they need) chooses one path through the cutoffs of all rules, from none at all to strict ones: each step tightens the
rule that rejects most bad documents for the good ones it loses. The other labelled rows are the holdout: in each stratum
(a language) the path is walked, and a step is certified if an exact binomial test rules out, at the corrected level,
that all rules together reject more than ``risk`` of its good documents. The walk stops at the first step that fails, so
within a walk no correction is needed (fixed-sequence testing; the path does not depend on the holdout); over strata the
level is divided (Bonferroni). Hence with probability ``1 - delta`` no stratum loses more than ``risk`` of its good
documents to the rules. With the defaults and four strata that takes 217 good texts of the holdout, none rejected; a
stratum with fewer certifies nothing and keeps everything the fixed base rules keep.

The test needs independent rows: a labelled id counts once, and so does a text that several labelled ids hold (as bad if
any label says so). Strata are judged by Spark, whatever their number; only the path's counts come to the driver: how many
good and bad texts there are for each distinct combination of steps.

Nulls: a null text has no words; a null stratum is a stratum of its own; null labels and null ids of labels count for
nothing; a repeated label counts once, at its smallest value. Repeated rows are kept. Only the named columns are read.
Empty tables give empty results. Whole texts are read, whatever their length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgauge.llm.common import blocks, per_text, texts_of, words_of, written

SYMBOLS = r"[#*$%&|<>]"
SPACES = " \t\n\v\f\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_caps_words", "n_lines", "n_dup_lines", "n_repeat_words"]
PATH_LOSS = 0.1  # good documents of the path's rows that its last step may lose


@dataclass(frozen=True)
class Rule:
    """Reject if ``numerator`` / ``denominator`` is beyond the cutoff; ``cutoffs`` run from mild to strict."""

    name: str
    numerator: str
    denominator: str
    above: bool
    cutoffs: tuple[float, ...]

    def value(self) -> Column:
        return F.when(F.col(self.denominator) > 0, F.col(self.numerator) / F.col(self.denominator)).otherwise(F.lit(0.0))

    def beyond(self, cutoff: Column) -> Column:
        return self.value() > cutoff if self.above else self.value() < cutoff


def _shares(first: float, last: float, n: int) -> tuple[float, ...]:
    return tuple(round(float(x), 4) for x in np.linspace(first, last, n))


RULES = (
    Rule("symbols", "n_symbols", "n_words", True, _shares(3.0, 0.05, 60)),
    Rule("caps", "n_caps_words", "n_words", True, _shares(0.95, 0.05, 46)),
    Rule("dup_lines", "n_dup_lines", "n_lines", True, _shares(0.9, 0.05, 35)),
    Rule("repeats", "n_repeat_words", "n_words", True, _shares(0.9, 0.05, 35)),
    Rule("long_words", "word_chars", "n_words", True, _shares(30.0, 6.0, 49)),
    Rule("short_words", "word_chars", "n_words", False, _shares(1.0, 4.0, 31)),
)


def repeated_words(codes: np.ndarray, bounds: np.ndarray, n_codes: int) -> np.ndarray:
    """Words of each text inside a three-word window that the text holds at least twice."""
    if n_codes**3 >= 1 << 62 and len(codes) > 1:  # number the pairs first, so that three words fit into 64 bits
        _, pairs = np.unique(codes[:-1] * n_codes + codes[1:], return_inverse=True)
        keys = pairs[:-1] * n_codes + codes[2:]
    else:
        keys = (codes[:-2] * n_codes + codes[1:-1]) * n_codes + codes[2:]
    found = np.zeros(len(bounds) - 1, np.int64)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if b - a < 4:
            continue
        own = keys[a : b - 2]
        ordered = np.sort(own)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(twice):
            starts = np.isin(own, twice)
            covered = np.zeros(b - a, bool)
            for shift in range(3):
                covered[shift : shift + len(own)] |= starts
            found[i] = covered.sum()
    return found


def _lines(text: str) -> tuple[int, int]:
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(lines), len(lines) - len(set(lines))


def text_counts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``COUNTS`` of every whole text."""
    inner = [f"kept{i}" for i in range(len(keep))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            texts = texts_of(block, "text")
            codes, bounds, words = words_of(texts)
            chars = pc.utf8_length(words).to_numpy(zero_copy_only=False)
            symbols = pc.count_substring_regex(words, SYMBOLS).to_numpy(zero_copy_only=False)
            letters = pc.count_substring_regex(words, r"\pL").to_numpy(zero_copy_only=False)
            small = pc.count_substring_regex(words, r"\p{Ll}").to_numpy(zero_copy_only=False)
            caps = (letters > 1) & (small == 0)
            lines = np.array([_lines(t) for t in texts.to_pylist()], np.int64).reshape(-1, 2)
            values = [
                np.diff(bounds),
                per_text(chars[codes], bounds),
                per_text(symbols[codes], bounds),
                per_text(caps[codes], bounds),
                lines[:, 0],
                lines[:, 1],
                repeated_words(codes, bounds, len(words)),
            ]
            yield pa.RecordBatch.from_arrays(
                [*(block.column(c) for c in inner), *(pa.array(v, pa.int64()) for v in values)], names=[*inner, *COUNTS]
            )

    rows = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(keep, inner, strict=True)], F.col("text").cast("string").alias("text"))
    types = ", ".join(f"{i} {docs.schema[c].dataType.simpleString()}" for c, i in zip(keep, inner, strict=True))
    counted = rows.mapInArrow(count, f"{types}, {', '.join(f'{c} long' for c in COUNTS)}")
    return counted.select(*[F.col(i).alias(c) for c, i in zip(keep, inner, strict=True)], *COUNTS)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def log_binomial_cdfs(most: int, n: int, p: float) -> np.ndarray:
    """log P(X <= k) for k = 0..most and X binomial(n, p), by exact summation."""
    i = np.arange(min(most, n))
    terms = np.concatenate([[0.0], np.cumsum(np.log((n - i) / (i + 1)) + math.log(p) - math.log1p(-p))]) + n * math.log1p(-p)
    return np.logaddexp.accumulate(terms)


def log_binomial_cdf(k: int, n: int, p: float) -> float:
    return float(log_binomial_cdfs(k, n, p)[-1])


def certified(rejected: list[int], n: int, risk: float, level: float) -> int:
    """How many of the steps, mild to strict, keep the false rejections under ``risk`` at ``level``.

    ``rejected`` has the good documents out of ``n`` that each step rejects. A step passes if seeing so few would have
    probability ``level`` at most were the risk any larger: the exact upper bound is then below ``risk``.
    """
    chances = log_binomial_cdfs(math.ceil(n * risk), n, risk) if n else np.zeros(1)
    allowed = int(np.searchsorted(chances, math.log(level), side="right")) - 1  # so many rejections still pass
    passed = 0
    for k in rejected:
        if k > allowed or k >= n * risk:
            break
        passed += 1
    return passed


def needed(rule: Rule) -> Column:
    """How many of the rule's cutoffs, mild to strict, must be in use for it to reject a text; one more than it has: never."""
    beyond = F.size(F.filter(F.array(*map(F.lit, rule.cutoffs)), rule.beyond))  # the strictest ones
    return F.lit(len(rule.cutoffs) + 1) - beyond


def choose_path(needs: np.ndarray, good: np.ndarray, sizes: list[int], n: np.ndarray | None = None) -> np.ndarray:
    """(steps, rules) cutoffs in use at each step, each row no milder than the one before.

    ``needs`` has, for every text and rule, the cutoffs that must be in use for the rule to reject it; a row stands for
    ``n`` such texts (one, unless given).
    """
    n = np.ones(len(good), np.int64) if n is None else n
    now, steps = np.zeros(len(sizes), np.int64), []
    left, n_good = np.ones(len(good), bool), max(1, int(n[good].sum()))
    while True:
        best = None
        for r, size in enumerate(sizes):
            bad = needs[left & ~good, r]
            bad = bad[bad <= size]
            if not len(bad):
                continue
            to = int(bad.min())  # the next cutoff that catches anything
            hit = left & (needs[:, r] <= to)
            gain, loss = int(n[hit & ~good].sum()), int(n[hit & good].sum())
            rank = (gain / (loss + 0.5), gain, -r)
            if best is None or rank > best[0]:
                best = rank, r, to
        if best is None:
            break
        _, r, to = best
        now[r] = to
        left &= needs[:, r] > to
        if n[good & ~left].sum() > PATH_LOSS * n_good:
            break
        steps.append(now.copy())
    return np.array(steps, np.int64).reshape(-1, len(sizes))


def rule_step(path: np.ndarray, r: int, rule: Rule) -> Column:
    """The first step of the path (from 1) at which a rule rejects a text with its ``needs``; one past the last: never."""
    # for each number of cutoffs needed, the step that first uses so many
    at = [int(np.searchsorted(path[:, r], need)) + 1 for need in range(1, len(rule.cutoffs) + 2)]
    return F.element_at(F.array(*map(F.lit, at)), F.col("needs")[r])


def first_step(path: np.ndarray, rules: tuple[Rule, ...] = RULES) -> Column:
    """The first step at which any rule rejects a text."""
    return F.least(*[rule_step(path, r, rule) for r, rule in enumerate(rules)])


def labelled_texts(counts: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """stratum, text_hash, quality and needs of the distinct labelled texts that the base rules let through."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    needs = F.array(*[needed(rule) for rule in rules])
    rows = counts.where(~base_failed()).join(known, "doc_id").select("doc_id", "stratum", "text_hash", "quality", needs.alias("needs"))
    one = rows.groupBy("doc_id").agg(F.min(F.struct("text_hash", "stratum", "quality", "needs")).alias("row")).select("row.*")
    return one.groupBy("stratum", "text_hash").agg(F.min("quality").alias("quality"), F.min("needs").alias("needs"))


def learn_cutoffs(
    counts: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, risk: float = 0.02, delta: float = 0.05
) -> tuple[np.ndarray, DataFrame]:
    """The path, and for every stratum the number of steps certified, with its good holdout texts ``n``.

    ``counts`` has ``doc_id``, ``stratum``, ``text_hash`` and the counts; ``labels`` has ``doc_id`` and ``quality``.
    """
    texts = written(labelled_texts(counts, labels, rules), "labelled-texts")
    draw = F.xxhash64("text_hash", F.lit("path"))
    good = (F.col("quality") == 1).alias("good")
    rows = texts.where(F.pmod(draw, F.lit(4)) == 0).groupBy(good, "needs").agg(F.count("*").alias("n")).toArrow()
    needs = rows.column("needs").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, len(rules))
    is_good = rows.column("good").combine_chunks().to_numpy(zero_copy_only=False)
    path = choose_path(needs, is_good, [len(rule.cutoffs) for rule in rules], rows.column("n").to_numpy())
    holdout = texts.where((F.pmod(draw, F.lit(4)) != 0) & (F.col("quality") == 1))
    steps = holdout.select("stratum", first_step(path, rules).alias("step")).groupBy("stratum", "step").agg(F.count("*").alias("n"))
    per_stratum = steps.groupBy("stratum").agg(F.collect_list(F.struct("step", "n")).alias("steps"))  # at most the path's steps
    per_stratum = written(per_stratum, "rule-steps")
    level = delta / max(1, per_stratum.count())
    n_steps = len(path)

    def judge_strata(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed, sizes = [], []
            for found in batch.column("steps").to_pylist():
                at = np.zeros(n_steps + 2, np.int64)
                for x in found:
                    at[x["step"]] = x["n"]
                sizes.append(int(at.sum()))
                passed.append(certified(np.cumsum(at)[1 : n_steps + 1].tolist(), sizes[-1], risk, level))
            columns = [batch.column("stratum"), pa.array(passed, pa.int32()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["stratum", "passed", "n"])

    return path, written(per_stratum.mapInArrow(judge_strata, "stratum string, passed int, n long"), "certified-steps")


def apply_cutoffs(counts: DataFrame, path: np.ndarray, learned: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``counts`` with base_failed, ``failed_rules`` and kept."""
    learned = learned.select(F.col("stratum").alias("own_stratum"), "passed")
    judged = counts.join(learned, F.col("stratum").eqNullSafe(F.col("own_stratum")), "left")
    judged = judged.withColumn("needs", F.array(*[needed(rule) for rule in rules]))
    passed = F.coalesce(F.col("passed"), F.lit(0))
    failed = [F.when(rule_step(path, r, rule) <= passed, F.lit(rule.name)) for r, rule in enumerate(rules)]
    judged = judged.withColumn("base_failed", base_failed()).withColumn("failed_rules", F.array_compact(F.array(*failed)))
    kept = ~F.col("base_failed") & (F.size("failed_rules") == 0)
    return judged.withColumn("kept", kept).drop("own_stratum", "passed", "needs", "text_hash")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Counts and verdict of every document, with cutoffs learned from its labelled rows."""
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.col(f"`{stratum}`").cast("string").alias("stratum"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"),
    )
    counts = written(text_counts(rows, ("doc_id", "stratum", "text_hash")), "text-counts")
    return apply_cutoffs(counts, *learn_cutoffs(counts, labels, RULES, risk, delta))
