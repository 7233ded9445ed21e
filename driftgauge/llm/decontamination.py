"""Operator 6: documents that hold a benchmark item, by pigeonhole pieces and Myers' distance.

Texts and items are compared as words: lower-case runs of letters and digits; in scripts without spaces between words
every character is a word. An item of m words may differ from a
passage by k = (1 - similarity) x m word edits. It is split into k + 1 pieces; by the pigeonhole principle a passage
within k edits holds at least one piece unchanged. All windows of a text are hashed at the few piece lengths in use and
looked up among the piece hashes. Each hit fixes where the item would start, and the words around it are verified by
Myers' bit-parallel edit distance. So no passage within the budget is missed, wherever it stands in a text of any length.

The items are the stated query set: they are read in blocks of a bounded number of bytes, each block is sent with one
pass over the documents, and nothing else is broadcast.

Nulls: null texts match nothing, nor do items without a letter or digit. An item of fewer than ``least_words`` words (8)
has no budget: it is found where it stands word for word. Items need not be unique, each gets its own rows. A null id is kept as it is. Repeated documents are
reported each. Only the named columns are read. Empty tables give an empty table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.llm.common import blocks, texts_of, words_of

SIMILARITY = 0.8
LEAST_WORDS = 8
UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"
BYTES_PER_PASS = 8 << 20
MATCHES = "item_id long, n_words long, distance long, first_word long, end_word long"


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Lower-case runs of letters and digits (single characters of ``UNSPACED``), as codes, bounds and each code's word."""
    plain = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\pL\pN]+", " ")
    split = pc.match_substring_regex(plain, UNSPACED)
    if pc.any(split).as_py():
        apart = pc.replace_substring_regex(plain.filter(split), f"({UNSPACED})", r" \1 ")
        plain = pc.replace_with_mask(plain, split, apart)
    return words_of(plain)


def word_hashes(words: pa.Array) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """A polynomial hash of every run of ``length`` words."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, length, np.uint64)
    for j in range(length):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[j : j + n]
    return out ^ out >> np.uint64(29)


def pieces(m: int, budget: int) -> list[tuple[int, int]]:
    """(start, length) of ``budget`` + 1 pieces that make up ``m`` words."""
    cuts = [i * m // (budget + 1) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_end(pattern: dict[int, int], m: int, text: list[int]) -> tuple[int, int]:
    """Least edits that turn the pattern into some run of ``text``, and the first end of such a run (Myers 1999)."""
    ones, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = ones, 0, m, m, 0
    for at, word in enumerate(text, 1):
        equal = pattern.get(word, 0)
        diagonal = ((equal & plus) + plus) ^ plus | equal | minus
        up, down = minus | ~(diagonal | plus) & ones, plus & diagonal
        score += 1 if up & high else -1 if down & high else 0
        up, down = up << 1 & ones, down << 1 & ones
        plus, minus = down | ~(diagonal | up) & ones, up & diagonal
        if score < best:
            best, end = score, at
    return best, end


@dataclass
class Items:
    """Items of one pass: word hashes, budgets and piece tables by length."""

    ids: list[int | None]
    words: list[np.ndarray]
    budgets: list[int]
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # sorted piece hashes, their items, their starts

    @classmethod
    def of(cls, ids: list[int | None], texts: list[str], similarity: float, least_words: int) -> Items:
        codes, bounds, words = plain_words(pa.array(texts, pa.string()))
        hashes = word_hashes(words)
        kept_ids, kept, budgets = [], [], []
        by_length: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for item, a, b in zip(ids, bounds[:-1], bounds[1:], strict=True):
            if a == b:
                continue
            own = hashes[codes[a:b]]
            budget = int((1 - similarity) * len(own) + 1e-9) if len(own) >= least_words else 0
            for start, length in pieces(len(own), budget):
                mark = int(window_hashes(own[start : start + length], length)[0])
                by_length[length].append((mark, len(kept), start))
            kept_ids.append(item)
            kept.append(own)
            budgets.append(budget)
        tables = {}
        for length, rows in by_length.items():
            rows.sort()
            marks, items, starts = zip(*rows, strict=True)
            tables[length] = (np.array(marks, np.uint64), np.array(items, np.int64), np.array(starts, np.int64))
        return cls(kept_ids, kept, budgets, tables)

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, place where it would start) for every piece found in the words; places may lie outside of a text."""
        items, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for length, (marks, of_item, start) in self.tables.items():
            found = window_hashes(hashes, length)
            shift = np.uint64(64 - min(24, max(12, len(marks).bit_length() + 4)))
            may = np.zeros(1 << 64 - int(shift), bool)
            may[marks >> shift] = True
            at = np.flatnonzero(may[found >> shift])
            first = np.searchsorted(marks, found[at], side="left")
            count = np.searchsorted(marks, found[at], side="right") - first
            at, first, count = at[count > 0], first[count > 0], count[count > 0]
            row = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
            items.append(of_item[row])
            places.append(np.repeat(at, count) - start[row])
        return np.concatenate(items), np.concatenate(places)

    def matches(self, hashes: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, first word, end word) of the best passage of each text and item within the budget."""
        items, places = self.hits(hashes)
        m, k = np.array([len(w) for w in self.words], np.int64)[items], np.array(self.budgets, np.int64)[items]
        low, high = places - k, places + m + k
        order = np.lexsort((low, items))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        patterns: dict[int, dict[int, int]] = {}
        run: tuple[int, int, int] | None = None
        windows = zip(items[order].tolist(), low[order].tolist(), high[order].tolist(), strict=True)
        for item, a, b in [*windows, (-1, 0, 0)]:
            if run is not None and run[0] == item and a <= run[2]:
                run = (item, run[1], max(run[2], b))
                continue
            if run is not None:
                self._search(run, hashes, bounds, patterns, best)
            run = (item, a, b)
        return [(t, i, *found) for (t, i), found in sorted(best.items())]

    def _search(self, run, hashes, bounds, patterns, best) -> None:
        """Best passage of an item in the words ``run[1]`` to ``run[2]``, text by text."""
        item, low, high = run
        low, high = max(0, low), min(len(hashes), high)
        m, budget = len(self.words[item]), self.budgets[item]
        if item not in patterns:
            bits: dict[int, int] = defaultdict(int)
            for j, word in enumerate(self.words[item].tolist()):
                bits[word] |= 1 << j
            patterns[item] = bits
        text = max(0, int(np.searchsorted(bounds, low, side="right")) - 1)
        while text < len(bounds) - 1 and bounds[text] < high:
            a, b = max(low, int(bounds[text])), min(high, int(bounds[text + 1]))
            if b - a >= m - budget:
                words = hashes[a:b].tolist()
                distance, end = best_end(patterns[item], m, words)
                if distance <= budget and distance < best.get((text, item), (budget + 1,))[0]:
                    back: dict[int, int] = defaultdict(int)
                    for j, word in enumerate(self.words[item][::-1].tolist()):
                        back[word] |= 1 << j
                    _, size = best_end(back, m, words[:end][::-1][: m + budget])
                    shift = a - int(bounds[text])
                    best[(text, item)] = (distance, shift + end - size, shift + end)
            text += 1


def item_blocks(items: DataFrame, id_column: str, text_column: str, bytes_per_pass: int) -> Iterator[tuple[list, list]]:
    """Ids and texts of the items, in blocks of about ``bytes_per_pass``."""
    rows = items.select(
        F.col(f"`{id_column}`").cast("long").alias("item_id"), F.col(f"`{text_column}`").cast("string").alias("text")
    ).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // bytes_per_pass)
    for number in range(n):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == number).collect()
        yield [r["item_id"] for r in block], [r["text"] for r in block]


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    similarity: float = SIMILARITY,
    least_words: int = LEAST_WORDS,
    keep: tuple[str, ...] = ("doc_id",),
    bytes_per_pass: int = BYTES_PER_PASS,
) -> DataFrame:
    """One row for each document and item found in it, with the kept columns and the best passage (word positions).

    ``docs`` has ``text`` and the columns of ``keep``; ``items`` has ``item_id`` and ``text``.
    """
    inner = [f"kept{i}" for i in range(len(keep))]
    types = ", ".join(f"{i} {docs.schema[c].dataType.simpleString()}" for c, i in zip(keep, inner, strict=True))
    rows = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(keep, inner, strict=True)], F.col("text").cast("string").alias("text"))
    schema = f"{types}, {MATCHES}"

    def one_pass(block: Items) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in blocks(batches, "text"):
                codes, bounds, words = plain_words(texts_of(batch, "text"))
                found = block.matches(word_hashes(words)[codes] if len(words) else np.zeros(0, np.uint64), bounds)
                if not found:
                    continue
                text, item, distance, first, end = zip(*found, strict=True)
                columns = [
                    pa.array([block.ids[i] for i in item], pa.int64()),
                    pa.array([len(block.words[i]) for i in item], pa.int64()),
                    *(pa.array(c, pa.int64()) for c in (distance, first, end)),
                ]
                at = pa.array(text, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(at) for c in inner), *columns],
                    names=[*inner, "item_id", "n_words", "distance", "first_word", "end_word"],
                )

        return rows.mapInArrow(search, schema)

    passes = [
        one_pass(Items.of(ids, texts, similarity, least_words))
        for ids, texts in item_blocks(items, "item_id", "text", bytes_per_pass)
    ]
    found = reduce(DataFrame.union, passes) if passes else docs.sparkSession.createDataFrame([], schema)
    return found.select(*[F.col(i).alias(c) for c, i in zip(keep, inner, strict=True)], *[f.split()[0] for f in MATCHES.split(", ")])


def clean_documents(
    docs: DataFrame,
    items: DataFrame,
    similarity: float = SIMILARITY,
    least_words: int = LEAST_WORDS,
    bytes_per_pass: int = BYTES_PER_PASS,
) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns."""
    names = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col("text").cast("string").alias("own_text"))

    def one_pass(rows: DataFrame, block: Items) -> DataFrame:
        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in blocks(batches, "own_text"):
                codes, bounds, words = plain_words(texts_of(batch, "own_text"))
                found = block.matches(word_hashes(words)[codes] if len(words) else np.zeros(0, np.uint64), bounds)
                clear = np.ones(batch.num_rows, bool)
                clear[[f[0] for f in found]] = False
                yield batch.filter(pa.array(clear))

        return rows.mapInArrow(clean, rows.schema)

    for ids, texts in item_blocks(items, "item_id", "text", bytes_per_pass):
        rows = one_pass(rows, Items.of(ids, texts, similarity, least_words))
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
