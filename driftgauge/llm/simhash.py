"""Operator 7: near duplicates by SimHash, linked by meet-in-the-middle ball hashing.

Two fingerprints differ in at most ``radius`` bits if and only if some value lies within half the radius of both. So
every distinct fingerprint emits its ball: all variants within ``radius`` // 2 bits (2,081 of them for radius 4), and
fingerprints that meet in a variant are linked. Variants are dealt by their leading bits: a fingerprint is sent once to
each prefix that its ball reaches (a few dozen copies, not 2,081), and its variants under that prefix are made inside
the task. The number of leading bits follows the number of distinct fingerprints, so a task's variants stay bounded at
any size; where fingerprints crowd under one prefix, the task halves it by further bits. Everything that meets in one
variant is within the radius of everything else there, hence one link to the smallest member keeps all components and
no group is expanded into pairs.

Copies share one fingerprint and are folded before anything is dealt. Links are whole: no cap on a variant's members.

Nulls: a null text is an empty one; texts without a word have fingerprint zero and are linked like any other. A null
``doc_id`` keeps its row and never names a component (null if no member has an id). Repeated rows are all returned.
Only ``doc_id`` and ``text`` are read. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftgauge.llm.common import blocks, texts_of, written
from driftgauge.llm.graph import components

RADIUS = 4
VARIANTS_PER_TASK = 4_000_000
HASHES_AT_ONCE = 1 << 16
WIDE_WORDS = 8
POINT_BITS = 32  # bits of a zone that may differ in up to RADIUS places
ROWS_AT_ONCE = 1024
LEAST_ZONE_BITS = 6  # bits of a zone that must be equal
RECALL = 0.998
PRESENCE_BITS = 1024
NEAREST = 8  # candidates that a text is compared with before all others


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of the ``words``-word shingles of a text, A-Z lower-cased, repeats included, in bounded arrays."""
    import xxhash

    split = text.lower().split()
    if not split:
        return
    ends = list(accumulate((len(w) + 1 for w in split), initial=0))
    joined, digest = b" ".join(split), xxhash.xxh64_intdigest
    n = max(1, len(split) - words + 1)
    last = ends[min(words, len(split)) :]
    for a in range(0, n, HASHES_AT_ONCE):
        b = min(n, a + HASHES_AT_ONCE)
        yield np.fromiter((digest(joined[i : j - 1], seed) for i, j in zip(ends[a:b], last[a:b], strict=True)), "<u8", b - a)


def bit_counts(words: np.ndarray) -> np.ndarray:
    """How many rows of a (rows, k) array of 64-bit words set each of the 64 k bits, lowest first."""
    counts = np.zeros(64 * words.shape[1], np.int64)
    for a in range(0, len(words), 255):  # byte-wide sums, eight to a word, cannot overflow within 255 rows
        bits = np.unpackbits(words[a : a + 255].view(np.uint8), axis=1, bitorder="little")
        counts += bits.view(np.uint64).sum(axis=0).view(np.uint8)
    return counts


def fingerprint(text: bytes, words: int) -> int:
    """SimHash: a bit is 1 if it is set in over half of the shingles' hashes."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, words):
        counts += bit_counts(hashes[:, None])
        n += len(hashes)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def wide_fingerprint(text: bytes, words: int) -> np.ndarray:
    """SimHash of ``WIDE_WORDS`` words of 64 bits over the distinct shingles, so repeats weigh nothing."""
    return wide_bits(shingle_set(text, words))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(np.concatenate([np.zeros(0, "<u8"), *shingle_hashes(text, words)]))


def wide_bits(shingles: np.ndarray) -> np.ndarray:
    """The wide fingerprint of shingle hashes: each is mixed with one constant for each word."""
    counts = np.zeros(64 * WIDE_WORDS, np.int64)
    steps = np.arange(1, WIDE_WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for a in range(0, len(shingles), HASHES_AT_ONCE):
        z = shingles[a : a + HASHES_AT_ONCE, None] + steps
        z ^= z >> np.uint64(30)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(27)
        z *= np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        counts += bit_counts(z)
    return np.packbits(2 * counts > len(shingles), bitorder="little")


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and fingerprint (its 64 bits as a long) of every whole text."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            found = [fingerprint(t, words) for t in texts_of(block, "text").cast(pa.binary()).to_pylist()]
            marks = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), marks], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(compute, "doc_id long, fp long")


@lru_cache(maxsize=256)
def ball_masks(bits: int, flips: int) -> np.ndarray:
    """All masks over the lowest ``bits`` bits with at most ``flips`` bits set."""
    masks = {0}
    for _ in range(flips):
        masks |= {m | 1 << b for m in masks for b in range(bits)}
    return np.array(sorted(masks), np.uint64)


def ball_size(bits: int, flips: int) -> int:
    return sum(comb(bits, f) for f in range(flips + 1))


def meetings(points: np.ndarray, flips: np.ndarray, bits: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(members, group) of points whose balls meet, sorted by group then member; ``flips`` are those each point has left.

    Only the lowest ``bits`` bits are varied. Sets that would make over ``limit`` variants are halved by the highest of
    these bits: a point goes to its own side, and to the other one if it has a flip to spend.
    """

    def search(who: np.ndarray, left: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if len(who) < 2:
            return
        kinds = [np.flatnonzero(left == f) for f in range(int(left.max()) + 1)]
        if bits and sum(len(k) * ball_size(bits, f) for f, k in enumerate(kinds)) > limit:
            side = points[who] >> np.uint64(bits - 1) & np.uint64(1)
            for value in (0, 1):
                spent = left - (side != value)
                stay = spent >= 0
                yield from search(who[stay], spent[stay], bits - 1)
            return
        low = points[who] & np.uint64((1 << bits) - 1)
        balls = [(k, low[k][:, None] ^ ball_masks(bits, f)[None, :]) for f, k in enumerate(kinds) if len(k)]
        values = np.sort(np.concatenate([b.ravel() for _, b in balls]))
        met = np.unique(values[1:][values[1:] == values[:-1]])
        if not len(met):
            return
        shift = np.uint64(64 - 20)
        mix = np.uint64(0x9E3779B97F4A7C15)
        marked = np.zeros(1 << 20, bool)
        marked[met * mix >> shift] = True
        owners, variants = [], []
        for k, ball in balls:
            row, column = np.nonzero(marked[ball * mix >> shift])
            value = ball[row, column]
            at = np.minimum(np.searchsorted(met, value), len(met) - 1)
            sure = met[at] == value
            owners.append(who[k[row[sure]]])
            variants.append(at[sure])
        owner, variant = np.concatenate(owners), np.concatenate(variants)
        order = np.lexsort((owner, variant))
        yield owner[order], variant[order]

    with np.errstate(over="ignore"):
        yield from search(np.arange(len(points)), flips, bits)


def star(members: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The smallest member of each member's group."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return np.repeat(members[first], np.diff(np.r_[first, len(members)]))


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest item of each linked set) after the links between ``a`` and ``b``."""
    while True:
        low = np.minimum(label[a], label[b])
        if (low == label[a]).all() and (low == label[b]).all():
            return label
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]


def dealt(rows: DataFrame, n: int, bits: int, flips: int, variants_per_task: int) -> tuple[DataFrame, int]:
    """``rows`` (``point``) once for each prefix of the point's bits that its ball reaches.

    The prefix is as long as keeps a task's variants bounded for ``n`` rows.
    """
    wanted = n * ball_size(bits, flips) / variants_per_task
    prefix = min(bits, 32, max(0, math.ceil(math.log2(max(wanted, 1)))))
    reach = F.array(*[F.lit(int(m)).cast("long") for m in ball_masks(prefix, flips)])
    top = F.shiftrightunsigned("point", bits - prefix) if prefix else F.lit(0).cast("long")
    sent = rows.withColumn("mask", F.explode(reach)).withColumn("prefix", top.bitwiseXOR(F.col("mask"))).drop("mask")
    return sent, prefix


def flips_left(points: np.ndarray, own: int, bits: int, prefix: int, flips: int) -> np.ndarray:
    if not prefix:
        return np.full(len(points), flips, np.int64)
    return flips - np.bitwise_count((points >> np.uint64(bits - prefix)) ^ np.uint64(own)).astype(np.int64)


def ball_links(marks: DataFrame, radius: int = RADIUS, variants_per_task: int = VARIANTS_PER_TASK) -> DataFrame:
    """Links (a, b) that connect exactly what chains of fingerprints within ``radius`` bits connect.

    ``marks`` has distinct longs ``fp``.
    """
    if radius % 2:
        raise ValueError("the radius must be even: both balls take half of it")
    flips = radius // 2
    sent, prefix = dealt(marks.select(F.col("fp").alias("point")), marks.count(), 64, flips, variants_per_task)

    def collide(table: pa.Table) -> pa.Table:
        points = np.sort(table.column("point").to_numpy())
        bits = points.view(np.uint64)
        left = flips_left(bits, table.column("prefix")[0].as_py(), 64, prefix, flips)
        label = np.arange(len(points))
        for members, group in meetings(bits, left, 64 - prefix, variants_per_task):
            label = join_labels(label, members, star(members, group))
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": points[linked], "b": points[label[linked]]})

    return sent.groupBy("prefix").applyInArrow(collide, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id: the smallest ``doc_id`` reachable over fingerprints within ``radius`` bits."""
    rows = written(fingerprints(docs, words), "fingerprints")
    marks = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(ball_links(marks.select("fp"), radius))
    rooted = marks.join(roots, marks["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("fp").alias("own_fp"), "component_id")
    return rows.join(named, rows["fp"] == named["own_fp"]).select("doc_id", "fp", "component_id")


def hex_digits(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def differing_bits(similarity: float) -> int:
    """Bits of the wide fingerprint in which two texts of this shingle similarity may differ.

    Five standard deviations are allowed for: the bits only find candidates, their shingles decide.
    """
    share = differing_share(similarity)
    bits = 64 * WIDE_WORDS
    return int(bits * share + 5 * math.sqrt(bits * share * (1 - share)))


def differing_share(similarity: float) -> float:
    """Share of bits in which two texts of this shingle similarity differ on average: their angle over pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def zone_shape(n: int, similarity: float, variants_per_task: int) -> tuple[int, int]:
    """How many bits must be equal in a zone, so that a task's variants stay bounded, and how many zones that takes.

    A pair at ``similarity`` meets in one zone if those bits agree and at most ``RADIUS`` of the others differ; there
    are as many zones as make it meet in at least one with probability ``RECALL``.
    """
    share = differing_share(similarity)
    variants = n * ball_size(POINT_BITS, RADIUS // 2) / variants_per_task
    equal = max(LEAST_ZONE_BITS, math.ceil(math.log2(max(variants, 1))))
    close = sum(comb(POINT_BITS, d) * share**d * (1 - share) ** (POINT_BITS - d) for d in range(RADIUS + 1))
    meets = (1 - share) ** equal * close
    return equal, math.ceil(math.log(1 - RECALL) / math.log(1 - meets))


def zone_bits(equal: int, zones: int) -> np.ndarray:
    """Which bits of the wide fingerprint make up each zone, without repeats in a zone."""
    rng, bits, size = np.random.default_rng(7), 64 * WIDE_WORDS, equal + POINT_BITS
    per = bits // size
    dealt_bits = [rng.permutation(bits)[: per * size].reshape(per, size) for _ in range(-(-zones // per))]
    return np.concatenate(dealt_bits)[:zones]


def linked_by_bits(wide: np.ndarray, most: int, groups: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Labels after linking all members of a group that differ in at most ``most`` bits of the wide fingerprint.

    The smallest member of a group is compared first; pairs that this leaves apart are compared after that.
    """
    label = np.arange(len(wide))

    def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(wide[a] ^ wide[b]).sum(axis=1) <= most

    for members, group in groups:
        pairs = np.unique(np.stack([members, star(members, group)], axis=1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        near = close(pairs[:, 0], pairs[:, 1])
        label = join_labels(label, pairs[near, 0], pairs[near, 1])
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        apart = np.add.reduceat(label[members] != label[star(members, group)], first) > 0
        sizes = np.diff(np.r_[first, len(members)])
        seen = set()
        for at in np.flatnonzero(apart & (sizes > 2)):
            who = members[first[at] : first[at] + sizes[at]]
            if (key := who.tobytes()) in seen:
                continue
            seen.add(key)
            for i in range(1, len(who) - 1):
                rest = who[i + 1 :][label[who[i + 1 :]] != label[who[i]]]
                mine = np.full(len(rest), who[i])
                near = close(mine, rest)
                if near.any():
                    label = join_labels(label, mine[near], rest[near])
    return label


def presence(shingles: np.ndarray) -> np.ndarray:
    """``PRESENCE_BITS`` bits, one a hash value of a shingle that the set holds."""
    bits = np.zeros(PRESENCE_BITS, bool)
    bits[(shingles >> np.uint64(64 - PRESENCE_BITS.bit_length() + 1)).astype(np.int64)] = True
    return np.packbits(bits)


def may_be_similar(bits: np.ndarray, size: np.ndarray, similarity: float):
    """A test of pairs: False only if their sets cannot have the similarity.

    A presence bit of one set alone stands for a shingle that the other does not hold, which bounds what is common.
    """

    def test(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        only_a, only_b = (np.bitwise_count(bits[p] & ~bits[q]).sum(axis=1, dtype=np.int64) for p, q in ((a, b), (b, a)))
        common = np.minimum(size[a] - only_a, size[b] - only_b)
        return common >= similarity * (size[a] + size[b] - common) - 1e-9

    return test


def pairs_apart(
    wide: np.ndarray, label: np.ndarray, most: int, groups: Iterator[tuple[np.ndarray, np.ndarray]], possible=None
) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, bits): members of a group with different labels whose wide fingerprints differ in at most ``most`` bits.

    ``possible`` is a further test of pairs. Where groups overlap so much that their pairs outnumber those of all rows, all rows are compared instead.
    """
    found, seen, work = [np.zeros((0, 2), np.int64)], set(), 0

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        near = np.bitwise_count(wide[a] ^ wide[b]).sum(axis=1) <= most
        if possible is not None:
            a, b = a[near], b[near]
            near = possible(a, b)
        found.append(np.stack([np.minimum(a, b)[near], np.maximum(a, b)[near]], axis=1))

    def keep_across(who: np.ndarray) -> None:
        who = who[np.argsort(label[who], kind="stable")]
        for i, after in enumerate(np.searchsorted(label[who], label[who], side="right").tolist()):
            if after < len(who):
                keep(np.full(len(who) - after, who[i]), who[after:])

    for members, group in groups:
        if work > len(wide) ** 2:
            break
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[first, len(members)])
        two = first[sizes == 2]
        pairs = np.unique(np.stack([members[two], members[two + 1]], axis=1), axis=0)
        pairs = pairs[label[pairs[:, 0]] != label[pairs[:, 1]]]
        keep(pairs[:, 0], pairs[:, 1])
        own = label[members]
        mixed = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)
        for at in np.flatnonzero(mixed & (sizes > 2)):
            who = members[first[at] : first[at] + sizes[at]]
            if (key := who.tobytes()) in seen:
                continue
            seen.add(key)
            if (work := work + len(who) ** 2) > len(wide) ** 2:
                break
            keep_across(who)
        if len(found) > 1000:
            found = [np.unique(np.concatenate(found), axis=0)]
    if work > len(wide) ** 2:
        keep_across(np.arange(len(wide)))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pairs, np.bitwise_count(wide[pairs[:, 0]] ^ wide[pairs[:, 1]]).sum(axis=1).astype(np.int64)


def wide_fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, the hash of the text, its wide fingerprint and ``node``, the hash of its set of shingles."""
    import xxhash

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            wide, node = [], []
            for text in texts_of(block, "text").cast(pa.binary()).to_pylist():
                shingles = shingle_set(text, words)
                wide.append(wide_bits(shingles).tobytes())
                node.append(xxhash.xxh64_intdigest(shingles.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id"),
                    block.column("text_hash"),
                    pa.array(wide, pa.binary()),
                    pa.array(np.array(node, np.uint64).view(np.int64)),
                ],
                names=["doc_id", "text_hash", "wide", "node"],
            )

    return _texts(docs).mapInArrow(compute, "doc_id long, text_hash long, wide binary, node long")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
    )


def shingle_sets(docs: DataFrame, rows: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node and ``shingles``, the sorted distinct shingle hashes, of the given nodes of ``rows``, each from one text."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            sets = [shingle_set(t, words).tobytes() for t in texts_of(block, "text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    first = rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(place).alias("k"))
    first = first.select("node", F.col("k.doc_id").alias("first_id"), F.col("k.text_hash").alias("first_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))
    found = _texts(docs).join(first, same).select("node", "text").mapInArrow(compute, "node long, shingles binary")
    return found.groupBy("node").agg(F.min("shingles").alias("shingles"))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have at least this similarity: common shingles over all shingles."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = []
            for x, y in zip(batch.column("mine").to_pylist(), batch.column("theirs").to_pylist(), strict=True):
                p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                if min(len(p), len(q)) < similarity * max(len(p), len(q)):
                    same.append(False)
                    continue
                both = len(np.intersect1d(p, q, assume_unique=True))
                same.append(both >= similarity * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    mine = sets.select(F.col("node").alias("a"), F.col("shingles").alias("mine"))
    theirs = sets.select(F.col("node").alias("b"), F.col("shingles").alias("theirs"))
    return pairs.join(mine, "a").join(theirs, "b").mapInArrow(compare, "a long, b long")


def similar_documents(
    docs: DataFrame,
    words: int = 5,
    similarity: float = 0.8,
    variants_per_task: int = VARIANTS_PER_TASK,
) -> DataFrame:
    """doc_id, text_hash and ``root``: equal for documents linked by shingle similarity of ``similarity`` or more.

    At this similarity 64 bits differ in about ten places, far beyond a radius whose balls can be listed. So the
    fingerprint is 512 bits wide, and the ball hashing runs in zones of its bits: within a zone a few bits are equal and
    32 others differ in at most 4, met in the middle by balls of 2. A document goes to one group of each zone, named by
    the equal bits. Their number grows with the logarithm of the corpus and keeps the groups bounded; the number of
    zones (34 up to some 500,000 documents) is such that a pair at ``similarity`` meets in at least one with probability
    ``RECALL``, a closer pair with a higher one.

    The fingerprint only finds candidates: what meets, differs in at most ``differing_bits`` and, by a bitmap of the
    shingles that never errs to the other side, may have the similarity. Only texts that have one
    go on, with their sets of shingles, and a link is a pair whose sets have the similarity. First each text is compared
    with the smallest text it hangs together with, so a crowd of near copies is linked by as many comparisons as it has
    members; then each text with its few nearest candidates, and last all candidates, as far as they are not linked yet.
    Texts with the same set of shingles, among them those without a word, are one node from the start.
    """
    rows = written(wide_fingerprints(docs, words), "wide-fingerprints")
    marks = rows.groupBy("node").agg(F.min("wide").alias("wide"))
    equal, n_zones = zone_shape(marks.count(), similarity, variants_per_task)
    order, most, flips = zone_bits(equal, n_zones), differing_bits(similarity), RADIUS // 2

    def zoned(marks: DataFrame) -> DataFrame:
        names = marks.columns

        def zones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = np.arange(n_zones, dtype=np.int64) << equal
            weights = 1 << np.arange(max(equal, POINT_BITS), dtype=np.int64)
            for whole in batches:
                for a in range(0, whole.num_rows, ROWS_AT_ONCE):
                    batch = whole.slice(a, ROWS_AT_ONCE)
                    data = np.frombuffer(b"".join(batch.column("wide").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                    bits = np.unpackbits(data, axis=1, bitorder="little")[:, order]
                    zone = number + bits[:, :, :equal].astype(np.int64) @ weights[:equal]
                    point = bits[:, :, equal:].astype(np.int64) @ weights[:POINT_BITS]
                    at = pa.array(np.repeat(np.arange(batch.num_rows), n_zones))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(zone.ravel()), pa.array(point.ravel()), *(batch.column(n).take(at) for n in names)],
                        names=["zone", "point", *names],
                    )

        kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in marks.schema)
        return marks.mapInArrow(zones, f"zone long, point long, {kept}")

    def met(table: pa.Table) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
        node = table.column("node").to_numpy()
        points = table.column("point").to_numpy().astype(np.uint64)
        wide = np.frombuffer(b"".join(table.column("wide").to_pylist()), np.uint64).reshape(len(node), -1)
        return node, wide, meetings(points, np.full(len(points), flips, np.int64), POINT_BITS, variants_per_task)

    def collide(table: pa.Table) -> pa.Table:
        node, wide, groups = met(table.sort_by("node"))
        label = linked_by_bits(wide, most, groups)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": node[linked], "b": node[label[linked]]})

    def apart(most_each: int | None):
        def collide(table: pa.Table) -> pa.Table:
            table = table.sort_by("node")
            node, wide, groups = met(table)
            label = np.unique(table.column("label").to_numpy(), return_inverse=True)[1]
            marked = np.frombuffer(b"".join(table.column("presence").to_pylist()), np.uint64).reshape(len(node), -1)
            possible = may_be_similar(marked, table.column("size").to_numpy(), similarity)
            pairs, bits = pairs_apart(wide, label, most, groups, possible)
            if most_each is not None:
                pairs, bits = np.concatenate([pairs, pairs[:, ::-1]]), np.concatenate([bits, bits])
                ranked = np.lexsort((pairs[:, 1], bits, pairs[:, 0]))
                owner = pairs[ranked, 0]
                rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
                pairs, bits = pairs[ranked[rank < most_each]], bits[ranked[rank < most_each]]
            return pa.table({"a": node[pairs[:, 0]], "b": node[pairs[:, 1]], "bits": bits})

        return collide

    hung = written(zoned(marks).groupBy("zone").applyInArrow(collide, "a long, b long").distinct(), "candidates")
    ends = written(hung.select(F.col("a").alias("node")).union(hung.select("b")).distinct(), "candidate-nodes")
    sets = written(shingle_sets(docs, rows, ends, words), "shingle-sets")

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x, "<u8") for x in batch.column("shingles").to_pylist()]
            columns = [batch.column("node"), pa.array([presence(x).tobytes() for x in own], pa.binary()), pa.array([len(x) for x in own], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "presence", "size"])

    near = written(marks.join(sets.mapInArrow(present, "node long, presence binary, size long"), "node"), "candidate-marks")
    links = written(verified(hung.groupBy("a").agg(F.min("b").alias("b")), sets, similarity), "near-links")
    for most_each in (NEAREST, None):
        roots = components(links)
        labelled = near.join(roots, "node", "left").select("node", "wide", "presence", "size", F.coalesce("root", "node").alias("label"))
        pairs = zoned(labelled).groupBy("zone").applyInArrow(apart(most_each), "a long, b long, bits long")
        if most_each is not None:  # a text has at most NEAREST in each zone
            rank = F.row_number().over(Window.partitionBy("a").orderBy("bits", "b"))
            pairs = pairs.distinct().withColumn("rank", rank).where(F.col("rank") <= most_each)
        pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        links = links.union(written(verified(pairs, sets, similarity), "near-links"))
        if pairs.isEmpty():
            break
    roots = components(links)
    return rows.join(roots, rows["node"] == roots["node"], "left").select(
        "doc_id", "text_hash", F.coalesce(roots["root"], rows["node"]).alias("root")
    )


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each linked group the row of the smallest ``doc_id`` stays.

    A null ``doc_id`` comes after all others, equal ids are told apart by text, and of equal rows one stays.
    """
    found = similar_documents(docs, words, similarity)
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    kept = found.groupBy("root").agg(F.min(key).alias("k")).select(
        F.col("k.doc_id").alias("kept_id"), F.col("k.text_hash").alias("kept_hash")
    )
    inner = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    id_column, text = f"c{docs.columns.index('doc_id')}", f"c{docs.columns.index('text')}"
    rows = docs.select(*inner).withColumn("own_hash", F.xxhash64(F.col(text).cast("string")))
    same = F.col(id_column).cast("long").eqNullSafe(F.col("kept_id")) & (F.col("own_hash") == F.col("kept_hash"))
    stayed = rows.join(kept, same, "left_semi")
    first = Window.partitionBy(id_column, "own_hash").orderBy(F.lit(0))
    once = stayed.withColumn("copy", F.row_number().over(first)).where("copy = 1")
    return once.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
