"""Byte-model scores against plain dictionaries, with one trie and with many, odd rows included."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from driftgauge.llm import ppm

from .odd import DOCS, EMPTY, docs_frame

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def symbols(text):
    return [256] * 4 + list((text or "").translate(LOWER).encode()) + [256]


class Plain:
    def __init__(self, texts):
        self.seen = defaultdict(Counter)
        for text in texts:
            run = symbols(text)
            for i in range(4, len(run)):
                for k in range(5):
                    self.seen[tuple(run[i - k : i])][run[i]] += 1

    def chance(self, context, symbol):
        out, excluded = 1.0, set()
        for k in range(4, -1, -1):
            counts = self.seen.get(tuple(context[4 - k :]))
            if not counts:
                continue
            left = {s: n for s, n in counts.items() if s not in excluded}
            total = sum(left.values())
            if symbol in left:
                return out * (2 * left[symbol] - 1) / (2 * total)
            if total:
                out *= len(left) / (2 * total)
            excluded |= set(counts)
        return out / (257 - len(excluded))

    def score(self, text):
        run = symbols(text)
        return sum(math.log10(self.chance(run[i - 4 : i], run[i])) for i in range(4, len(run)))


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def plain_rows(docs):
    train = [d[1] or "" for d in docs if not held(d[0])]
    words = lambda text: re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    counts = Counter(w for text in train for w in words(text))
    ends, n = len(train), sum(counts.values()) + len(train)
    v = len(counts) + (ends > 0)
    model = Plain(train)
    one = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    out = []
    for doc_id, text, *_ in docs:
        own = [counts[w] for w in words(text)] + [ends]
        out.append((doc_id, held(doc_id), len(own), sum(c > 0 for c in own), n, sum(map(one, own)), model.score(text)))
    return out


def same(got, expected):
    order = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
    got, expected = sorted(map(tuple, got), key=order), sorted(expected, key=order)
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    for g, e in zip(got, expected, strict=True):
        assert g[5:] == pytest.approx(e[5:], rel=1e-5, abs=1e-5)


@pytest.mark.parametrize("sizes", [None, (40, 200, 30)])
def test_odd_rows(spark, monkeypatch, sizes):
    if sizes:
        monkeypatch.setattr(ppm, "SHARD_GRAMS", sizes[0])
        monkeypatch.setattr(ppm, "BUNDLE_GRAMS", sizes[1])
        monkeypatch.setattr(ppm, "PART_WORDS", sizes[2])
        monkeypatch.setattr(ppm, "ENCODED_BYTES", 500)
    same(ppm.language_model(docs_frame(spark)).collect(), plain_rows(DOCS))


def test_random_texts(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("ab cé\nD", [6, 5, 4, 3, 1, 1, 1], k=rng.randrange(60))), "en", "s", 1) for i in range(120)]
    rows += rows[:30]
    same(ppm.language_model(docs_frame(spark, rows)).collect(), plain_rows(rows))


def test_chances_add_up_to_one():
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcd e"), 40)) for _ in range(30)]
    run, starts = ppm.symbols_of(pa.array(texts))
    at = ppm.predicted(run, starts)
    grams = np.zeros(len(at), np.int64)
    for back in range(4, -1, -1):
        grams = (grams << ppm.BITS) | run[at - back]
    grams, counts = np.unique(grams, return_counts=True)
    n1 = np.zeros((257, 257), np.int64)
    np.add.at(n1, (grams >> 9 & 511, grams & 511), counts)
    short = ppm.Short(n1.sum(axis=0), n1)
    shard = ppm.make_shard(grams, counts, short)
    for context in ([256] * 4, list(b"abcd"), list(b"zzzz"), list(b"zzza"), list(b"zzab"), list(b"  ab"), list(b"e ab")):
        run = np.array([x for s in range(257) for x in (*context, s)], np.int32)
        at = np.arange(4, len(run), 5)
        logs = ppm.score_run(run, at, run[at - 1] * 257 + run[at - 2], shard, short)
        # symbols that could follow a known context escape to shorter ones; what an escape finds nothing for is lost
        assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)


def test_longer_contexts_help_on_texts_not_seen(spark):
    rng = random.Random(3)
    parts = ["lo", "rem", "ip", "sum", "do", "lor"]
    rows = [(i, " ".join("".join(rng.choices(parts, k=4)) for _ in range(30)), "en", "s", 1) for i in range(200)]

    def held_out_score(order):
        got = ppm.language_model(docs_frame(spark, rows), order=order).where("held_out").collect()
        return sum(r["score"] for r in got) / sum(len(rows[r["doc_id"]][1]) + 1 for r in got)

    # six equally likely parts of two or three letters; four symbols do not tell where a word ends
    assert held_out_score(2) < held_out_score(4)
    assert held_out_score(4) > -0.40


def test_nothing_to_learn_from(spark):
    rows = [(i, "abc", "en", "s", 1) for i in range(300) if held(i)]
    for r in ppm.language_model(docs_frame(spark, rows)).collect():
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (2, 0, 0, 0.0)
        assert r["score"] == pytest.approx(-4 * math.log10(257))


def test_empty(spark):
    assert ppm.language_model(docs_frame(spark, EMPTY)).collect() == []
