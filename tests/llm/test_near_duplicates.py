"""Fingerprints, ball hashing and components against brute force."""

import re

import numpy as np
import pytest
import xxhash

from driftgauge.llm import simhash
from driftgauge.llm.graph import components
from driftgauge.llm.simhash import (
    ball_links,
    ball_size,
    differing_bits,
    fingerprint,
    hex_digits,
    meetings,
    near_duplicates,
    one_of_each,
    pairs_apart,
    similar_documents,
    wide_fingerprint,
)

from .odd import DOCS, EMPTY, PROSE, docs_frame


def plain_fingerprint(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(marks, radius):
    parent = {m: m for m in marks}

    def root(m):
        while parent[m] != m:
            m = parent[m]
        return m

    for a in marks:
        for b in marks:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {m: root(m) for m in marks}


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def clustered(n_bases, near, rng, bits=64):
    marks = set()
    for base in rng.integers(0, 1 << 63, n_bases, dtype=np.uint64):
        marks.add(int(base))
        for _ in range(near):
            flipped = int(base)
            for b in rng.integers(0, bits, rng.integers(1, 8)):
                flipped ^= 1 << int(b)
            marks.add(flipped)
    return sorted(marks)


@pytest.mark.parametrize("text", [d[1] for d in DOCS] + ["One two", "a b c d e", "Ünï cöde WORDS here NOW"])
@pytest.mark.parametrize("words", [1, 4])
def test_fingerprint(text, words):
    assert fingerprint((text or "").encode(), words) == plain_fingerprint(text, words)


@pytest.mark.parametrize("per_task", [4_000_000, 20_000, 3_000])
def test_ball_links_connect_what_brute_force_connects(spark, per_task):
    marks = clustered(25, 12, np.random.default_rng(3))
    frame = spark.createDataFrame([(signed(m),) for m in marks], "fp long")
    links = [(r["a"], r["b"]) for r in ball_links(frame, 4, per_task).collect()]
    expected = plain_components(marks, 4)
    linked = {signed(m): signed(m) for m in marks}

    def root(m):
        while linked[m] != m:
            m = linked[m]
        return m

    for a, b in links:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 64
        x, y = sorted((root(a), root(b)))
        linked[y] = x
    groups = lambda of: sorted(sorted(m for m in of if of[m] == r) for r in set(of.values()))
    ours = {m: root(m) for m in linked}
    assert groups({signed(m): signed(r) for m, r in expected.items()}) == groups(ours)


def test_crowded_points_are_halved():
    rng = np.random.default_rng(5)
    points = np.unique(np.array([1 << 40 ^ int(x) for x in rng.integers(0, 1 << 9, 200)], np.uint64))
    pairs = set()
    for members, group in meetings(points, np.full(len(points), 2), 64, 5_000):
        for g in np.unique(group):
            own = members[group == g]
            pairs |= {(int(a), int(b)) for a in own for b in own if a < b}
    near = {
        (a, b)
        for a in range(len(points))
        for b in range(a + 1, len(points))
        if (int(points[a]) ^ int(points[b])).bit_count() <= 4
    }
    assert pairs == near
    assert ball_size(64, 2) == 2081


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(70)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = {n: n for link in links for n in link}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    assert {n: found.get(n, n) for n in label} == label
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_duplicates_odd_rows(spark):
    rows = near_duplicates(docs_frame(spark), words=4).withColumn("hex", hex_digits()).collect()
    assert len(rows) == len(DOCS)
    expected = {(d[0], f"{plain_fingerprint(d[1], 4):016x}") for d in DOCS}
    assert {(r["doc_id"], r["hex"]) for r in rows} == expected
    of = {r["doc_id"]: r["component_id"] for r in rows}
    assert of[2] == 1 and of[1] == 1 and of[8] == 1  # copies, and a copy in capitals
    assert of[4] == 3 and of[6] == 3  # texts without a word
    assert of[None] is None
    assert near_duplicates(docs_frame(spark, EMPTY)).collect() == []


def edited(text, share, rng):
    words = text.split(" ")
    for i in rng.choice(len(words), max(1, int(share * len(words))), replace=False):
        words[i] = f"new{rng.integers(1 << 30)}"
    return " ".join(words)


def similarity(a, b, words=5):
    sets = []
    for text in (a, b):
        w = text.lower().split()
        sets.append({" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_one_of_each_group_stays(spark):
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, base_of = [], {}
    for i in range(40):
        text = " ".join(rng.choice(vocabulary, 300))
        rows.append((100 * i, text, "en", "s", 1))
        for j in range(1, 4):
            near = text if j == 1 else edited(text, 0.012, rng)
            assert similarity(text, near) >= 0.8
            rows.append((100 * i + j, near, "en", "s", 1))
            base_of[100 * i + j] = 100 * i
    for i in range(60):
        rows.append((10_000 + i, " ".join(rng.choice(vocabulary, int(rng.integers(5, 200)))), "en", "s", 1))
    docs = docs_frame(spark, rows)
    kept = one_of_each(docs)
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == docs.columns
    assert ids == {100 * i for i in range(40)} | {10_000 + i for i in range(60)}


def test_one_of_each_odd_rows(spark):
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in one_of_each(docs_frame(spark)).collect())
    assert kept == [(False, 1), (False, 3), (False, 5), (False, 7), (False, 9), (True, 0)]
    assert one_of_each(docs_frame(spark, EMPTY)).collect() == []
    crowd = [(i, PROSE, "en", "s", 1) for i in range(3000)]
    assert [r["doc_id"] for r in one_of_each(docs_frame(spark, crowd)).collect()] == [0]


def test_wide_links_estimate_similarity(spark):
    rng = np.random.default_rng(2)
    text = " ".join(f"w{x}" for x in rng.integers(0, 5000, 500))
    far = edited(text, 0.2, rng)
    assert similarity(text, far) < 0.4
    rows = similar_documents(docs_frame(spark, [(1, text, "en", "s", 1), (2, far, "en", "s", 1)])).collect()
    assert len({r["root"] for r in rows}) == 2
    assert 64 < differing_bits(0.9) < differing_bits(0.8) < 128


def test_links_are_what_exact_similarity_links(spark):
    rng = np.random.default_rng(21)
    texts = []
    for _ in range(30):
        base = " ".join(f"w{x}" for x in rng.integers(0, 5000, 400))
        texts += [base] + [edited(base, share, rng) for share in (0.02, 0.032, 0.036, 0.04)]
    chain = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 300))]
    for _ in range(12):
        chain.append(edited(chain[-1], 0.02, rng))
    texts += chain
    rng.shuffle(texts)
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    pairs = [(similarity(a, b), i, j) for i, a in enumerate(texts) for j, b in enumerate(texts[:i])]
    assert sum(0.7 < s < 0.8 for s, _, _ in pairs) > 40
    label = list(range(len(texts)))
    for s, i, j in pairs:
        if s >= 0.8 and label[i] != label[j]:
            label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    found = {r["doc_id"]: r["root"] for r in similar_documents(docs_frame(spark, rows)).collect()}
    groups = lambda of: sorted(sorted(n for n in range(len(texts)) if of[n] == r) for r in {of[n] for n in range(len(texts))})
    assert groups(found) == groups(label)
    kept = {r["doc_id"] for r in one_of_each(docs_frame(spark, rows)).collect()}
    assert kept == set(label)


def test_repeated_lines_do_not_outweigh_the_rest(spark):
    rng = np.random.default_rng(8)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    differ = lambda a, b: int(np.bitwise_count(np.bitwise_xor(*[wide_fingerprint(t.encode(), 5) for t in (a, b)])).sum())
    rows = []
    for i, repeats in enumerate((5, 10, 30)):
        text, line = words(300), words(12)
        copy = text + f"\n{line}" * repeats
        assert similarity(text, copy) > 0.9 and differ(text, copy) <= differing_bits(0.8)
        rows += [(10 * i, text, "en", "s", 1), (10 * i + 1, copy, "en", "s", 1)]
    line = words(20)
    one, other = (words(300) + f"\n{line}" * 10 for _ in range(2))
    assert similarity(one, other) < 0.1 and differ(one, other) > differing_bits(0.8)
    rows += [(100, one, "en", "s", 1), (101, other, "en", "s", 1)]
    assert {r["doc_id"] for r in one_of_each(docs_frame(spark, rows)).collect()} == {0, 10, 20, 100, 101}


def test_pairs_of_crowded_groups_are_whole():
    rng = np.random.default_rng(4)
    wide = rng.integers(0, 4, (40, 8)).astype(np.uint64)
    label = rng.integers(0, 12, 40)
    crowds = [np.sort(rng.choice(40, 30, replace=False)) for _ in range(9)] + [np.arange(40)]
    groups = [(np.concatenate(crowds), np.repeat(np.arange(10), [30] * 9 + [40]))]
    bits = lambda i, j: int(np.bitwise_count(wide[i] ^ wide[j]).sum())
    expected = {(i, j): bits(i, j) for j in range(40) for i in range(j) if label[i] != label[j] and bits(i, j) <= 8}
    pairs, differ = pairs_apart(wide, label, 8, iter(groups))
    assert {tuple(p): b for p, b in zip(pairs.tolist(), differ.tolist(), strict=True)} == expected


def test_presence_bits_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(12)
    sets = []
    for size in (0, 1, 5, 40, 300, 4000):
        base = rng.integers(0, 1 << 63, size).astype("<u8") * np.uint64(2)
        for share in (1.0, 0.95, 0.88, 0.8, 0.7, 0.4):
            kept = base[: int(size * share)]
            sets.append(np.unique(np.concatenate([kept, rng.integers(0, 1 << 63, size - len(kept)).astype("<u8")])))
    bits = np.stack([simhash.presence(s) for s in sets]).view(np.uint64)
    test = simhash.may_be_similar(bits, np.array([len(s) for s in sets]), 0.8)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    ruled_out = 0
    for i, j, ok in zip(a, b, test(a, b), strict=True):
        common = len(np.intersect1d(sets[i], sets[j]))
        similar = common >= 0.8 * (len(sets[i]) + len(sets[j]) - common)
        assert ok or not similar
        ruled_out += not ok
    assert ruled_out > len(a) // 2
