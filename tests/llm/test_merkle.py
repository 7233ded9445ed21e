"""The Merkle manifest against a plain tree, odd rows and several heights included."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from driftgauge.llm import merkle

from .odd import DOCS, EMPTY, docs_frame


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])]
    return digest("".join(parts))


def plain_tree(leaves):
    """Root, and the siblings (level by level) of every leaf."""
    found, places, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, p in enumerate(places):
            run = range(p - p % 8, min(p - p % 8 + 8, len(level)))
            found[i].append((level[run[0] : p], level[p + 1 : run[-1] + 1]))
        places = [p // 8 for p in places]
        level = [digest("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
    return level[0], found


def plain_manifest(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, plain_leaf(row)))
    names = sorted(trees, key=lambda v: (v is not None, (v or "").encode()))
    own = {name: plain_tree([leaf for *_, leaf in sorted(trees[name])]) for name in names}
    root, tops = plain_tree([own[name][0] for name in names])
    out = []
    for name, top in zip(names, tops, strict=True):
        for (has_id, doc_id, leaf), path in zip(sorted(trees[name]), own[name][1], strict=True):
            siblings = "".join("".join(a) + "".join(b) for a, b in [*path, *top])
            out.append((doc_id if has_id else None, leaf, own[name][0], root, digest(siblings)))
    return out


def manifest_rows(spark, docs, path, stride):
    steps = merkle.write_manifest(docs, path, stride=stride)
    found = merkle.read_proofs(spark, path, steps, stride=stride)
    found = found.withColumn("siblings", merkle.siblings_digest(F.col("proof")))
    return found.withColumn("folded", merkle.folded(F.col("leaf"), F.col("proof"))).collect()


def key(row):
    return tuple((v is not None, v) for v in row)


@pytest.mark.parametrize("stride", [1, 2, 3])
def test_odd_rows(spark, tmp_path, stride):
    rows = manifest_rows(spark, docs_frame(spark), str(tmp_path / "m"), stride)
    got = [(r["key"], r["leaf"], r["subroot"], r["root"], r["siblings"]) for r in rows]
    assert sorted(got, key=key) == sorted(plain_manifest(DOCS), key=key)
    assert all(r["folded"] == r["root"] for r in rows)


@pytest.mark.parametrize("stride", [1, 2])
def test_several_heights(spark, tmp_path, stride):
    sizes = {"a": 1, "b": 7, "c": 8, "d": 9, "e": 64, "f": 65, None: 130, "": 3, "é": 513, "z": 600}
    rows = [(i * 7919 % 100_003 - 50_000, f"T {i} {name}", name, "s", i) for name, n in sizes.items() for i in range(n)]
    rows += [(5, "same", "z", "s", 1)] * 20
    found = manifest_rows(spark, docs_frame(spark, rows), str(tmp_path / "m"), stride)
    got = [(r["key"], r["leaf"], r["subroot"], r["root"], r["siblings"]) for r in found]
    assert sorted(got, key=key) == sorted(plain_manifest(rows), key=key)
    assert all(r["folded"] == r["root"] for r in found)


def test_many_trees(spark, tmp_path):
    rows = [(i, "x", f"lang{i % 77}", None, None) for i in range(300)]
    found = manifest_rows(spark, docs_frame(spark, rows), str(tmp_path / "m"), 1)
    got = [(r["key"], r["leaf"], r["subroot"], r["root"], r["siblings"]) for r in found]
    assert sorted(got) == sorted(plain_manifest(rows))


def test_only_checkpoint_levels_are_stored(spark, tmp_path):
    rows = [(i, "x", "en", None, None) for i in range(600)]
    path = str(tmp_path / "m")
    steps = merkle.write_manifest(docs_frame(spark, rows), path, stride=2)
    counts = [spark.read.parquet(f"{path}/rows/level={k}").count() for k in range(steps[0] + 1)]
    assert counts == [600, 10, 1]


def test_a_changed_leaf_or_sibling_is_seen(spark, tmp_path):
    rows = [(i, f"Text {i}", "en", "s", i) for i in range(100)]
    path = str(tmp_path / "m")
    steps = merkle.write_manifest(docs_frame(spark, rows), path, extra={"other": merkle.leaf_digest(F.lit(1))})
    found = merkle.read_proofs(spark, path, steps, ("other",))
    swapped = F.transform("proof", lambda s: F.struct(s["after"].alias("before"), s["before"].alias("after")))
    got = found.select(
        (merkle.folded(F.col("other"), F.col("proof")) == F.col("root")).alias("leaf"),
        (merkle.folded(F.col("leaf"), swapped) == F.col("root")).alias("order"),
    ).collect()
    assert not any(r["leaf"] or r["order"] for r in got)


def test_empty(spark, tmp_path):
    assert manifest_rows(spark, docs_frame(spark, EMPTY), str(tmp_path / "m"), 3) == []


def test_query_on_odd_rows(spark, tmp_path):
    from driftgauge.llm.queries import QUERIES

    docs_frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["op13_merkle_manifest"](spark, str(tmp_path)).collect()
    got = [(r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in rows]
    assert sorted(got, key=key) == sorted(plain_manifest(DOCS), key=key)
    texts = {(d[0], plain_leaf(d)): d[1] for d in DOCS}
    for r in rows:
        text = texts[r["doc_id"], r["leaf"]]
        changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        changed = changed and text is not None and any("A" <= c <= "Z" for c in text)
        assert r["verified"] == (not changed) == (r["folded_root"] == r["root"])
