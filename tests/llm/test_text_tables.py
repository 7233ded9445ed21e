"""Token tables, packing and the shared encoder against brute force, odd rows included."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftgauge.llm.packing import Plan, combinations, non_negative_least_squares, pack, repeats
from driftgauge.llm.token_files import read_tokens, token_digest, write_tokens
from driftgauge.llm.tokens import encoder

from .odd import DOCS, EMPTY, docs_frame


def whole_ids(texts):
    tokenizer = encoder()._tokenizer
    return [np.array(e.ids + [1], "<u4") for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


PIECES = ["a", "!! ", "x###", "&&& ", "'", "\" ", "(b) ", "<|", "|>", "<|ENDOFTEXT|>", "z>", "[q] ", "_w_ ", "The", " ", "\n", ". ", ",", "'s", "ß", "é.", "İ", "क़.", "שׁ,", "e\u0301.", "中文", "<|endoftext|>", "12,", " ", "ﬁ.", "don't", "\t", "..", "x,y. "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), min_size=1, max_size=6))
def test_encoder_equals_whole_texts(texts):
    ids, bounds = encoder().encode(pa.array(texts, pa.string()))
    for a, b, expected in zip(bounds[:-1], bounds[1:], whole_ids(texts), strict=True):
        assert np.array_equal(ids[a:b], expected)


def test_encoder_forgets_without_a_change():
    words = [f"word{i} again" for i in range(400)]
    small = type(encoder())(__import__("driftgauge.llm.tokens", fromlist=["x"]).vocabulary_path(), known_limit=50)
    for _ in range(3):
        for a in range(0, 400, 40):
            ids, bounds = small.encode(pa.array(words[a : a + 40]))
            for i, expected in enumerate(whole_ids(words[a : a + 40])):
                assert np.array_equal(ids[bounds[i] : bounds[i + 1]], expected)


def test_token_table(spark, tmp_path):
    docs = docs_frame(spark)
    path = str(tmp_path / "tokens")
    write_tokens(docs, path)
    got = sorted(tuple(r) for r in token_digest(spark, path).collect() if r[0] is not None)
    rows = sorted(((d[0] is not None, d[0] or 0, d[1] is not None, d[1] or "") for d in DOCS))
    ids = whole_ids([r[3] for r in rows])
    start, expected = 0, []
    for row, own in zip(rows, ids, strict=True):
        if row[0]:
            expected.append((row[1], start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    assert got == sorted(expected)
    some = read_tokens(spark, path, first=3, last=5).collect()
    assert {r["doc_id"] for r in some} == {d[0] for d in DOCS if d[0] is not None and 3 <= d[0] <= 5}
    assert "ids" not in read_tokens(spark, path, with_ids=False).columns


def test_token_table_empty(spark, tmp_path):
    path = str(tmp_path / "tokens")
    write_tokens(docs_frame(spark, EMPTY), path)
    assert token_digest(spark, path).collect() == []


def check_packing(rows, docs, window):
    texts = {}
    for doc_id, text, *_ in docs:
        texts.setdefault(doc_id, []).append(text or "")
    ids = {k: whole_ids(v) for k, v in texts.items()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for doc_id, pieces in by_doc.items():
        covered = sorted((p["start"], p["length"], p["doc_tokens"], p["ids_crc32"]) for p in pieces)
        expected = []
        for start, length, tokens, crc in covered:
            assert any(
                len(own) == tokens and zlib.crc32(own[start : start + length].tobytes()) == crc for own in ids[doc_id]
            )
            expected.append(length)
        assert sum(expected) == sum(len(own) for own in ids[doc_id])
    totals = []
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
        totals.append(at)
    short = [t for t in totals if t != window]
    assert all(t & (t - 1) == 0 for t in short) and len(short) == len(set(short))


def test_packing_odd_rows(spark):
    check_packing(pack(docs_frame(spark)).collect(), DOCS, 2048)
    check_packing(pack(docs_frame(spark), window=64, unit=8, depth=3).collect(), DOCS, 64)
    assert pack(docs_frame(spark, EMPTY)).collect() == []
    with pytest.raises(ValueError):
        pack(docs_frame(spark), window=100, unit=8)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 255), min_size=1, max_size=60), st.integers(0, 3))
def test_plan_places_every_piece_once(lengths, whole):
    window, unit = 64, 8
    units, tails = np.zeros(8, np.int64), np.zeros(8, np.int64)
    for n in lengths:
        rest = n % window
        units[rest // unit] += rest // unit > 0
        tails[rest % unit] += rest % unit > 0
    plan = Plan(whole, units, tails, window, unit, 3)
    used = {}
    for kind, counts, places, place, scale in (
        ("u", units, plan.units, plan.unit_place, unit),
        ("t", tails, plan.tails, plan.tail_place, 1),
    ):
        for n in np.flatnonzero(counts):
            for r in range(counts[n]):
                if r < places.taken[n]:
                    s, o = place(np.array([n]), np.array([r]))
                    spans = [(int(s[0]), int(o[0]), int(n) * scale)]
                else:
                    spans = []
                    for size in plan.sizes:
                        own = size // scale if size >= scale else 0
                        if own and (kind == "u" or size < unit) and n & own:
                            s, o = plan.bit_place(size, np.array([n]), np.array([r - places.taken[n]]))
                            spans.append((int(s[0]), int(o[0]), size))
                    assert sum(x[2] for x in spans) == n * scale
                for s, o, size in spans:
                    for at in range(o, o + size):
                        assert (s, at) not in used
                        used[s, at] = True
    assert len(used) == sum(n % window for n in lengths)
    totals = {}
    for s, at in used:
        totals[s] = max(totals.get(s, 0), at + 1)
    assert sum(totals.values()) == len(used)


def test_least_squares_and_repeats():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a = rng.integers(0, 3, (6, 9)).astype(float)
        x = np.where(rng.random(9) < 0.5, rng.random(9) * 5, 0)
        found = non_negative_least_squares(a, a @ x)
        assert (found >= 0).all() and np.linalg.norm(a @ found - a @ x) < 1e-6
    fills = combinations(6, 3)
    assert all(sum(f) == 6 and len(f) <= 3 for f in fills) and (2, 2, 2) in fills
    histogram = np.array([0, 4, 9, 6, 2, 1])
    left = histogram.copy()
    for lengths, times in repeats(histogram, fills):
        for n in lengths:
            left[n] -= times
    assert (left >= 0).all() and (left[1:] * np.arange(1, 6)).sum() < 12
