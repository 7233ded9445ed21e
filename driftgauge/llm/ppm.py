"""Operator 12: language-model scores by prediction by partial matching over bytes, and a unigram base beside them.

The model is pretrained: the counts of all byte strings of ``ORDER + 1`` symbols in the training texts (ASCII letters
lower-cased; an edge symbol stands ``ORDER`` times before a text and once after it) are merged by aggregation, so what is
gathered is all of the corpus. From them context tries are made, one for each range of the last two context symbols, so
that no task builds or holds more than about ``SHARD_GRAMS`` strings of them and every position needs one trie. A trie is
a double array over contexts, most recent symbol first; a context's predicted symbols are further children.

A symbol costs, from the longest context that was seen: if the context knows the symbol, its share of what is not
excluded; else the escape, and the next shorter context, in which all symbols of the longer one are excluded. In a
context with t occurrences and q distinct symbols left after exclusion a symbol seen n times has (2n - 1) / 2t and the
escape has q / 2t. Below the empty context every symbol of the 257 that is left is equally likely. As a longer context's
symbols are all known to the shorter one, what exclusion leaves depends on the longer context alone; all escapes of a
context are summed when its trie is built, and a position costs one walk and one addition.

Tries are broadcast in bundles of at most ``BUNDLE_GRAMS`` strings; the texts are read once for each bundle, and each
pass scores the positions whose context lies in it. The base needs counts of all words: texts are written as blocks of
word codes with each block's own dictionary, as sorted 96-bit hashes. Parts of the dictionaries meet by the leading bits
of their hashes, are added up there, and the totals go back to their blocks: packed arrays move, not rows.

Nulls: a null text is an empty one, whose end is still predicted; a null id is not held out, and its text is learned
from. Repeated rows count as often as they are there and are all returned. Without training rows every symbol has 1/257
and every token the base 0. Texts of any length are scored whole. An empty table gives an empty table. Only ``doc_id``
and ``text`` are read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.llm.common import blocks, texts_of, words_of, written
from driftgauge.llm.double_array import DoubleArray, build, prefixes
from driftgauge.llm.sampling import fold

ORDER = 4
EDGE = 256
SYMBOLS = 257
BITS = 9
SHARD_GRAMS = 300_000
BUNDLE_GRAMS = 2_400_000
SCORED_BYTES = 1 << 20
ENCODED_BYTES = 8 << 20
DISTINCT_GRAMS = 2_000_000  # held by a task before it sends them on
PART_WORDS = 1_000_000
WORD_TYPES = (("high", np.uint64), ("low", np.uint32), ("taught", np.int64))


def symbols_of(texts: pa.Array, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one run of symbols, each with its edges, and where each text starts in it (its edges included)."""
    lower = pc.ascii_lower(texts).cast(pa.large_binary())
    sizes = pc.binary_length(lower).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(lower.to_pylist()), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes + order + 1)])
    run = np.full(starts[-1], EDGE, np.int32)
    run[np.arange(len(data)) + np.repeat(order * np.arange(1, len(sizes) + 1) + np.arange(len(sizes)), sizes)] = data
    return run, starts[:-1]


def predicted(run: np.ndarray, starts: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Places of all symbols but the edges before texts."""
    keep = np.ones(len(run), bool)
    keep[(starts[:, None] + np.arange(order)).ravel()] = False
    return np.flatnonzero(keep)


def gram_table(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """gram (order + 1 symbols of nine bits) and n, over the texts of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0

        def merged() -> pa.RecordBatch:
            grams, n = (np.concatenate(x) for x in zip(*held, strict=True))
            distinct, place = np.unique(grams, return_inverse=True)
            total = np.zeros(len(distinct), np.int64)
            np.add.at(total, place, n)
            return pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(total)], names=["gram", "n"])

        for block in blocks(batches, "text", SCORED_BYTES * 4):
            run, starts = symbols_of(texts_of(block, "text"), order)
            at = predicted(run, starts, order)
            gram = np.zeros(len(at), np.int64)
            for back in range(order, -1, -1):
                gram = (gram << BITS) | run[at - back]
            held.append(np.unique(gram, return_counts=True))
            n_held += len(held[-1][0])
            if n_held > DISTINCT_GRAMS:
                one = merged()
                held, n_held = [(one.column(0).to_numpy(), one.column(1).to_numpy())], one.num_rows
                if n_held > DISTINCT_GRAMS // 2:
                    yield one
                    held, n_held = [], 0
        if held:
            yield merged()

    return docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Short:
    """Counts of symbols without context and after one symbol."""

    n0: np.ndarray  # (257,)
    n1: np.ndarray  # (257, 257), [context, symbol]

    def chains(self) -> tuple[np.ndarray, np.ndarray]:
        """Log weights that a symbol's 2n - 1 (or 1) gets at orders -1 and 0 (columns) after the escapes down to there:
        entered without context, and entered after escaping from each context of order 1 (its own escape left out)."""
        t0, q0 = self.n0.sum(), (self.n0 > 0).sum()
        rest = -np.log(max(SYMBOLS - q0, 1))
        alone = np.array([rest, 0.0])
        if t0:
            alone = np.array([np.log(q0 / (2 * t0)) + rest, -np.log(2 * t0)])
        seen = self.n1 > 0
        t, q = t0 - (seen * self.n0).sum(axis=1), q0 - seen.sum(axis=1)
        escape, share = left(t, q)
        return alone, np.stack([escape + rest, share], axis=1)


def left(t: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the escape, and of the weight of a symbol's 2n - 1, where t occurrences of q symbols are left."""
    some = t > 0
    doubled = np.where(some, 2.0 * t, 1.0)
    return np.where(some, np.log(np.where(some, q, 1) / doubled), 0.0), -np.log(doubled)


@dataclass(frozen=True)
class Shard:
    """The contexts of two symbols or more whose last two symbols lie in a range of pairs.

    ``fall[row[state], j + 1]`` is the log weight of a symbol first known at order j, where ``state`` is the longest
    context; ``n`` holds the log of 2n - 1 at the slots of predicted symbols.
    """

    array: DoubleArray
    pair_state: np.ndarray  # (257 * 257,), -1 without one; [newest symbol, the one before]
    row: np.ndarray
    fall: np.ndarray
    n: np.ndarray

    def packed(self) -> bytes:
        return pickle.dumps((self.array.base, self.array.check, self.pair_state, self.row, self.fall, self.n))

    @classmethod
    def unpacked(cls, data: bytes) -> Shard:
        base, check, *rest = pickle.loads(data)
        return cls(DoubleArray(base, check), *rest)


def make_shard(grams: np.ndarray, counts: np.ndarray, short: Short, order: int = ORDER) -> Shard:
    """A shard of all strings whose contexts end in its pairs."""
    symbols = np.stack([(grams >> (BITS * back)) & ((1 << BITS) - 1) for back in range(order + 1)], axis=1)
    # strings of every context length from 2: context (newest first), then the predicted symbol set apart
    keys, own = [], []
    for k in range(2, order + 1):
        part = np.column_stack([symbols[:, 1 : k + 1], symbols[:, 0] + SYMBOLS])
        code = reduce(lambda acc, c: (acc << 10) | c, part.T.astype(np.int64))
        distinct, first, place = np.unique(code, return_index=True, return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, place, counts)
        padded = np.full((len(distinct), order + 1), -1, np.int64)
        padded[:, : k + 1] = part[first]
        keys.append(padded)
        own.append(total)
    keys, total = np.concatenate(keys), np.concatenate(own)
    parent, symbol, leaf = short_prefixes(keys)
    array, slot = build(parent, symbol, 2 * SYMBOLS)
    n_nodes = len(parent) + 1
    n = np.zeros(n_nodes, np.int64)
    n[leaf] = total
    is_context = np.zeros(n_nodes, bool)
    is_context[1:] = symbol < SYMBOLS
    # occurrences and distinct symbols of each context, and how much of its suffix context they cover
    t, q = np.zeros(n_nodes, np.int64), np.zeros(n_nodes, np.int64)
    np.add.at(t, parent[leaf - 1], total)
    np.add.at(q, parent[leaf - 1], 1)
    at = parent[leaf - 1]  # context node of each predicted string
    shorter = np.concatenate([[0], parent])[at]
    # a context's suffix is its parent; the same symbol there is another child of that parent
    child_slot, ok = array.step(slot[shorter], symbol[leaf - 1])
    value_at_slot = np.zeros(len(array.base), np.int64)
    value_at_slot[slot] = n
    depth = (keys >= 0).sum(axis=1) - 1  # context length
    in_suffix = np.where(ok & (depth > 2), value_at_slot[child_slot], 0)
    pairs = depth == 2
    in_suffix[pairs] = short.n1[keys[pairs, 0], keys[pairs, 2] - SYMBOLS]
    covered = np.zeros(n_nodes, np.int64)
    np.add.at(covered, at, in_suffix)
    # chains from the short contexts down the trie, level by level
    chain = np.zeros((n_nodes, order + 2))
    level = np.zeros(n_nodes, np.int64)
    contexts = np.flatnonzero(is_context)
    for _ in range(order + 1):
        level[1:] = level[parent] + 1
    for node_level in range(1, order + 1):
        here = contexts[level[contexts] == node_level]
        if node_level == 1:
            chain[here, :2] = short.chains()[1][symbol[here - 1]]
            continue
        up = parent[here - 1]
        if node_level == 2:
            newest = symbol[up - 1]
            t_up, q_up = short.n1.sum(axis=1)[newest], (short.n1 > 0).sum(axis=1)[newest]
        else:
            t_up, q_up = t[up], q[up]
        escape, share = left(t_up - covered[here], q_up - q[here])
        chain[here, :node_level] = chain[up, :node_level] + escape[:, None]
        chain[here, node_level] = share  # the suffix context has order node_level - 1
    longest = contexts[level[contexts] >= 2]
    escape, share = left(t[longest], q[longest])
    fall = chain[longest] + escape[:, None]
    fall[np.arange(len(longest)), level[longest] + 1] = share
    row = np.zeros(len(array.base), np.int32)
    row[slot[longest]] = np.arange(len(longest))
    weight = np.zeros(len(array.base))
    weight[slot[leaf]] = np.log(2.0 * total - 1)
    pair_state = np.full(SYMBOLS * SYMBOLS, -1, np.int32)
    seconds = contexts[level[contexts] == 2]
    pair_state[symbol[parent[seconds - 1] - 1] * SYMBOLS + symbol[seconds - 1]] = slot[seconds]
    return Shard(array, pair_state, row, fall, weight)


def short_prefixes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``prefixes`` of keys of several lengths, filled up with -1: the filling is no node, a key ends before it."""
    parent, symbol, leaf = prefixes(keys)
    up = np.concatenate([[0], parent])
    real = np.concatenate([[True], symbol >= 0])
    number = np.cumsum(real) - 1
    while (filling := ~real[leaf]).any():
        leaf[filling] = up[leaf[filling]]
    return number[parent[real[1:]]], symbol[real[1:]], number[leaf]


def score_run(
    run: np.ndarray, at: np.ndarray, pairs: np.ndarray, shard: Shard, short: Short, order: int = ORDER
) -> np.ndarray:
    """Natural log probability of the symbols at places ``at``, whose last two context symbols are ``pairs``."""
    seen = run[at]
    state = shard.pair_state[pairs]
    out = np.empty(len(at))
    alone, after_one = short.chains()
    none = np.flatnonzero(state < 0)
    if len(none):
        one, s = run[at[none] - 1], seen[none]
        t1, q1 = short.n1.sum(axis=1)[one], (short.n1 > 0).sum(axis=1)[one]
        escape, share = left(t1, q1)
        n1, n0 = short.n1[one, s], short.n0[s]
        base = np.where((t1 > 0)[:, None], after_one[one] + escape[:, None], alone)
        lower = np.where(n0 > 0, base[:, 1] + np.log(np.maximum(2 * n0 - 1, 1)), base[:, 0])
        out[none] = np.where(n1 > 0, share + np.log(np.maximum(2 * n1 - 1, 1)), lower)
    deep = np.flatnonzero(state >= 0)
    own, places = state[deep], at[deep]
    depth = np.full(len(deep), 2, np.int8)
    alive = np.arange(len(deep))
    for back in range(3, order + 1):
        slots, ok = shard.array.step(own[alive], run[places[alive] - back])
        alive = alive[ok]
        own[alive], depth[alive] = slots[ok], back
    s = seen[deep]
    row, found = shard.row[own], np.empty(len(deep))
    open_, now = np.arange(len(deep)), own.copy()
    while len(open_):
        slots, ok = shard.array.step(now[open_], s[open_] + SYMBOLS)
        hit = open_[ok]
        found[hit] = shard.n[slots[ok]] + shard.fall[row[hit], depth[hit] + 1]
        missed = open_[~ok]
        depth[missed] -= 1
        now[missed] = shard.array.check[now[missed]]
        low = missed[depth[missed] < 2]
        if len(low):
            one, x = run[places[low] - 1], s[low]
            n1, n0, fall = short.n1[one, x], short.n0[x], shard.fall[row[low]]
            lower = np.where(n0 > 0, fall[:, 1] + np.log(np.maximum(2 * n0 - 1, 1)), fall[:, 0])
            found[low] = np.where(n1 > 0, fall[:, 2] + np.log(np.maximum(2 * n1 - 1, 1)), lower)
        open_ = missed[depth[missed] >= 2]
    out[deep] = found
    return out


@dataclass(frozen=True)
class Model:
    """Counts of short contexts, and a written table of shards (``shard`` number, ``trie``)."""

    short: Short
    edges: np.ndarray  # first pair of every shard but the first
    sizes: list[int]  # strings of each shard
    shards: DataFrame

    def bundles(self) -> list[list[int]]:
        found, held = [[]], 0
        for number, n in enumerate(self.sizes):
            if found[-1] and held + n > BUNDLE_GRAMS:
                found, held = [*found, []], 0
            found[-1].append(number)
            held += n
        return found


def fit_model(docs: DataFrame, order: int = ORDER) -> Model:
    """A model of all texts of ``docs``. Only counts of single symbols and pairs pass through the driver."""
    spark = docs.sparkSession
    grams = written(gram_table(docs, order), "ppm-grams")
    symbol = lambda back: F.shiftright("gram", BITS * back).bitwiseAND((1 << BITS) - 1)
    # newest symbol first: the order of the pairs that cut the shards
    pair = (symbol(1) * SYMBOLS + symbol(2)).cast("int")
    ones = grams.groupBy(symbol(1).alias("c"), symbol(0).alias("s")).agg(F.sum("n").alias("n")).toArrow()
    n1 = np.zeros((SYMBOLS, SYMBOLS), np.int64)
    n1[ones.column("c").to_numpy(), ones.column("s").to_numpy()] = ones.column("n").to_numpy()
    short = Short(n1.sum(axis=0), n1)
    per_pair = grams.groupBy(pair.alias("pair")).count().orderBy("pair").toArrow()
    pairs, sizes = per_pair.column("pair").to_numpy(), per_pair.column("count").to_numpy()
    edges, shard_sizes, held = [], [0], 0
    for p, n in zip(pairs, sizes, strict=True):
        if held and held + n > SHARD_GRAMS:
            edges, shard_sizes, held = [*edges, int(p)], [*shard_sizes, 0], 0
        shard_sizes[-1] += int(n)
        held += int(n)
    number = reduce(lambda acc, e: acc + (pair >= e).cast("int"), edges, F.lit(0))

    def make(part: pa.Table) -> pa.Table:
        shard = make_shard(part.column("gram").to_numpy(), part.column("n").to_numpy(), short, order)
        return pa.table({"shard": part.column("shard").slice(0, 1), "trie": pa.array([shard.packed()], pa.binary())})

    shards = grams.withColumn("shard", number).groupBy("shard").applyInArrow(make, "shard int, trie binary")
    return Model(short, np.array(edges, np.int64), shard_sizes, written(shards, "ppm-shards"))


def score_texts(rows: DataFrame, model: Model, order: int = ORDER) -> DataFrame:
    """key, hash and the log10 probability of the text, one row a (key, hash), from rows with key, hash and text."""
    spark, parts = rows.sparkSession, []
    for number, bundle in enumerate(model.bundles()):
        table = model.shards.where(F.col("shard").isin(bundle)).toArrow()
        tries = dict(zip(table.column("shard").to_pylist(), table.column("trie").to_pylist(), strict=True))
        sent = spark.sparkContext.broadcast((tries, model.short.n0, model.short.n1, model.edges, bundle))

        def score(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            packed, n0, n1, edges, bundle = sent.value
            short, shards = Short(n0, n1), {k: Shard.unpacked(v) for k, v in packed.items()}
            empty = None
            for block in blocks(batches, "text", SCORED_BYTES):
                run, starts = symbols_of(texts_of(block, "text"), order)
                at = predicted(run, starts, order)
                pairs = run[at - 1] * SYMBOLS + run[at - 2]
                logs = np.zeros(len(run))
                own = np.searchsorted(edges, pairs, side="right") if len(edges) else None
                for k in bundle:
                    mine = slice(None) if own is None else own == k
                    if k not in shards:  # no training text at all
                        empty = empty or no_shard(order)
                    logs[at[mine]] = score_run(run, at[mine], pairs[mine], shards.get(k, empty), short, order)
                total = np.add.reduceat(logs, starts) / np.log(10) if len(starts) else logs
                columns = [block.column("key"), block.column("hash"), pa.array(total)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "hash", "part"])

        part = rows.mapInArrow(score, "key long, hash long, part double").groupBy("key", "hash").agg(F.min("part").alias("part"))
        parts.append(part.withColumn("bundle", F.lit(number)))
    whole = reduce(DataFrame.unionByName, parts)
    return whole.groupBy("key", "hash").agg(F.sum("part").alias("score")) if len(parts) > 1 else whole.drop("bundle").withColumnRenamed("part", "score")


def no_shard(order: int = ORDER) -> Shard:
    return make_shard(np.zeros(0, np.int64), np.zeros(0, np.int64), Short(np.zeros(SYMBOLS, np.int64), np.zeros((SYMBOLS, SYMBOLS), np.int64)), order)


BLOCK = (
    "keys array<long>, hashes array<long>, held array<boolean>, high binary, low binary, taught binary, n_words long, "
    "codes binary, bounds binary"
)


def word_keys(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of 96 bits for each word."""
    found = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in words.to_pylist()), ">u8").reshape(-1, 2)
    return found[:, 0].astype(np.uint64), (found[:, 1] >> np.uint64(32)).astype(np.uint32)


def word_blocks(rows: DataFrame) -> DataFrame:
    """Blocks of rows as word codes; a block's words are hashes in ascending order, with their number in training texts."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            block = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            codes, bounds, dictionary = words_of(pc.ascii_lower(texts_of(block, "text")))
            held = block.column("held").to_numpy(zero_copy_only=False)
            high, low = word_keys(dictionary)
            order = np.lexsort((low, high))
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            codes = rank[codes]
            taught = np.bincount(codes[np.repeat(~held, np.diff(bounds))], minlength=len(order))
            binary = [x.tobytes() for x in (high[order], low[order], taught.astype(np.int64))]
            lists = [pa.array([block.column(c).to_pylist()], pa.list_(t)) for c, t in (("key", pa.int64()), ("hash", pa.int64()), ("held", pa.bool_()))]
            more = [len(order), codes.tobytes(), bounds.astype(np.int32).tobytes()]
            names = ["keys", "hashes", "held", "high", "low", "taught", "n_words", "codes", "bounds"]
            return pa.RecordBatch.from_arrays([*lists, *[pa.array([x]) for x in (*binary, *more)]], names=names)

        parts, size = [], 0
        for block in blocks(batches, "text"):
            parts.append(block)
            size += pc.sum(pc.binary_length(texts_of(block, "text"))).as_py() or 0
            if size >= ENCODED_BYTES:
                yield packed(parts)
                parts, size = [], 0
        if parts:
            yield packed(parts)

    return rows.mapInArrow(encode, BLOCK).withColumn("block", F.monotonically_increasing_id())


def word_counts(texts: DataFrame) -> DataFrame:
    """Training counts of every block's words: block, part and the counts of the block's words in that part of the hashes.

    The hashes are dealt by their leading bits into parts of about ``PART_WORDS`` entries. ``distinct`` and ``tokens``
    (on one row of each part) add up to the distinct words and the words of the training texts.
    """
    n_parts = max(1, -(-(texts.agg(F.sum("n_words")).first()[0] or 0) // PART_WORDS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                high, low, taught = (np.frombuffer(row[c], t) for c, t in WORD_TYPES)
                part = ((high >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int32)
                cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
                cuts = [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]
                blobs = [pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (high, low, taught)]
                first = pa.array([int(part[a]) for a, _ in cuts], pa.int32())
                block = pa.array([row["block"]] * len(cuts), pa.int64())
                yield pa.RecordBatch.from_arrays([first, block, *blobs], names=["part", "block", *names])

    def total(group: pa.Table) -> pa.Table:
        high, low, taught = (np.frombuffer(b"".join(group.column(c).to_pylist()), t) for c, t in WORD_TYPES)
        sizes = pc.binary_length(group.column("low")).to_numpy() // 4
        order = np.lexsort((low, high))
        new = np.ones(len(order), bool)
        new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
        word = np.cumsum(new) - 1
        sums = np.add.reduceat(taught[order], np.flatnonzero(new))
        n = np.empty(len(order), np.int64)
        n[order] = sums[word]
        ends = np.cumsum(sizes)
        alone = [0] * (group.num_rows - 1)
        return pa.table(
            {
                "block": group.column("block"), "part": group.column("part"),
                "n": pa.array([n[b - k : b].tobytes() for b, k in zip(ends, sizes, strict=True)], pa.binary()),
                "distinct": pa.array([int((sums > 0).sum()), *alone], pa.int64()),
                "tokens": pa.array([int(taught.sum()), *alone], pa.int64()),
            }
        )

    names = [c for c, _ in WORD_TYPES]
    dealt = texts.select("block", *names).mapInArrow(deal, "part int, block long, high binary, low binary, taught binary")
    return dealt.groupBy("part").applyInArrow(total, "block long, part int, n binary, distinct long, tokens long")


def base_scores(rows: DataFrame) -> DataFrame:
    """key, hash, held, n_tokens, n_known, train_tokens and base_score of every row."""
    texts = written(word_blocks(rows), "word-blocks")
    counts = written(word_counts(texts), "word-counts")
    total = counts.agg(F.coalesce(F.sum("distinct"), F.lit(0)).alias("v"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()
    ends = rows.where(~F.col("held")).count()
    n, v = total["n"] + ends, total["v"] + (ends > 0)
    fields = {"key": pa.int64(), "hash": pa.int64(), "held": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64()}

    def score(block: pa.Table, found: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        codes, bounds = np.frombuffer(row["codes"], np.int32), np.frombuffer(row["bounds"], np.int32).astype(np.int64)
        parts = sorted(zip(found.column("part").to_pylist(), found.column("n").to_pylist(), strict=True))
        count = np.frombuffer(b"".join(x for _, x in parts), np.int64)  # parts follow the order of the hashes
        logs = lambda c: np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        sizes = np.diff(bounds)
        some = np.flatnonzero(sizes)
        score, known = np.full(len(sizes), logs(ends)), np.full(len(sizes), int(ends > 0))
        if len(some):
            score[some] += np.add.reduceat(logs(count)[codes], bounds[some])
            known[some] += np.add.reduceat((count > 0)[codes].astype(np.int64), bounds[some])
        values = [row["keys"], row["hashes"], row["held"], sizes + 1, known, score]
        return pa.table({name: pa.array(x, t) for (name, t), x in zip(fields.items(), values, strict=True)})

    scored = (
        texts.select(F.col("block").alias("own_block"), "keys", "hashes", "held", "codes", "bounds")
        .groupBy("own_block")
        .cogroup(counts.select("block", "part", "n").groupBy("block"))
        .applyInArrow(score, "key long, hash long, held boolean, n_tokens long, n_known long, base_score double")
    )
    return scored.withColumn("train_tokens", F.lit(n).cast("long"))


def language_model(docs: DataFrame, folds: int = 5, held_out: int = 1, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held = F.coalesce(fold("doc_id", folds) == held_out, F.lit(False))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("key"), F.xxhash64(text).alias("hash"), held.alias("held"), text.alias("text")
    )
    model = fit_model(rows.where(~F.col("held")), order)
    scores = written(score_texts(rows.select("key", "hash", "text"), model, order), "ppm-scores")
    scores = scores.select(F.col("key").alias("own_key"), F.col("hash").alias("own_hash"), "score")
    same = F.col("key").eqNullSafe(F.col("own_key")) & (F.col("hash") == F.col("own_hash"))
    columns = [F.col("key").alias("doc_id"), F.col("held").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return base_scores(rows).join(scores, same).select(*columns)
