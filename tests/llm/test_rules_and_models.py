"""Quality rules, classifier and language id: brute force, exact bounds, held-out accuracy, odd rows."""

import math
import os
import re
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftgauge.llm import quality_rules as rules
from driftgauge.llm.common import load
from driftgauge.llm.language import fit_languages, identify, predict_languages
from driftgauge.llm.quality_classifier import Trees, classify, fit_quality, fit_trees, good_documents, statistics
from driftgauge.llm.sampling import bounded_sample

from .odd import DOCS, EMPTY, docs_frame

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    seen, duplicates = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            duplicates += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, duplicates, len(covered)


REPEATS = [
    "a b c a b c a b",
    "a a a a",
    "one line\none line\n\n  \none line ",
    "# * $ % & | < > x",
    "a b c d a b c",
    "  lead and trail  ",
]


def test_counts_equal_brute_force(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(REPEATS + [d[1] for d in DOCS])]
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for r in rules.text_counts(docs_frame(spark, rows)).collect():
        assert tuple(r[c] for c in columns) == plain_counts(rows[r["doc_id"]][1]), rows[r["doc_id"]][1][:80]


def test_many_words_are_numbered_in_pairs_first():
    codes = np.array([0, 1, 2, 0, 1, 2, 9], np.int64)
    for n in (10, 1 << 21):
        assert rules.repeated_words(codes, np.array([0, 7]), n).tolist() == [6]


def test_binomial_sum_is_exact():
    for n, p in product((5, 40), (0.02, 0.3)):
        for k in range(n):
            plain = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert math.isclose(rules.log_binomial_cdf(k, n, p), math.log(plain), rel_tol=1e-9, abs_tol=1e-12)


def test_certification_controls_the_risk():
    assert rules.certified([0, 0, 1, 500], 1000, 0.02, 0.01) == 3
    assert rules.certified([0], 50, 0.02, 0.01) == 0  # too few rows to prove anything
    assert rules.certified([0], 0, 0.02, 0.01) == 0
    rng, wrong, runs = np.random.default_rng(0), 0, 400
    shares = [0.004, 0.011, 0.0205, 0.05]  # the true shares that four cutoffs reject; the last two break the limit
    for _ in range(runs):
        u = rng.random(2000)
        wrong += rules.certified([int((u < s).sum()) for s in shares], 2000, 0.02, 0.05) >= 3
    assert wrong / runs <= 0.07


def test_a_path_tightens_where_it_pays():
    # rule 0 catches the bad texts 0-3 at no cost, rule 1 text 4 for one good text, text 5 is out of reach
    needs = np.array([[2, 9], [2, 9], [3, 9], [3, 9], [9, 1], [9, 9]] + [[9, 9]] * 19 + [[9, 1]])
    good = np.arange(len(needs)) > 5
    path = rules.choose_path(needs, good, [5, 5])
    assert path.tolist() == [[2, 0], [3, 0], [3, 1]]
    assert rules.choose_path(needs[6:], good[6:], [5, 5]).shape == (0, 2)


def test_one_walk_rejects_few_good_texts_whatever_the_rules(spark):
    """Six rules, noisy statistics: over many draws the share of runs with a broken stratum stays under delta."""
    rng, broken, certified_steps, runs = np.random.default_rng(7), 0, 0, 200
    sizes = [30] * 6
    needs_of = lambda n, bad: np.minimum(31, 1 + rng.geometric(0.09 if bad else 0.02, (n, 6)))
    truth = needs_of(100_000, False)
    for _ in range(runs):
        sample = np.concatenate([needs_of(150, False), needs_of(60, True)])
        path = rules.choose_path(sample, np.arange(210) < 150, sizes)
        if not len(path):
            continue
        held = needs_of(800, False)
        rejected = [int((held <= step).any(axis=1).sum()) for step in path]
        passed = rules.certified(rejected, 800, 0.05, 0.05)
        certified_steps += passed
        broken += bool(passed) and (truth <= path[passed - 1]).any(axis=1).mean() > 0.05
    assert broken / runs <= 0.08 and certified_steps > 0


def test_path_is_chosen_on_all_its_texts(spark, monkeypatch):
    """Counts by distinct steps give the path of the single texts, and no text is left out."""
    rng = np.random.default_rng(12)
    needs, good = rng.integers(1, 8, (400, 2)), rng.random(400) < 0.8
    cells, n = np.unique(np.column_stack([good, needs]), axis=0, return_counts=True)
    grouped = rules.choose_path(cells[:, 1:], cells[:, 0] == 1, [6, 6], n)
    assert (grouped == rules.choose_path(needs, good, [6, 6])).all()
    monkeypatch.setattr(rules, "PATH_ROWS", 5, raising=False)
    texts, choose = [], rules.choose_path
    monkeypatch.setattr(rules, "choose_path", lambda *a: texts.append(int(np.sum(a[3])) if len(a) > 3 else len(a[0])) or choose(*a))
    docs = spark.createDataFrame([(i, "en", " ".join(f"w{(i * 7 + j) % 997}" for j in range(60))) for i in range(400)], "doc_id long, lang string, text string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    rules.judge(docs, labels).count()
    assert texts[0] > 50


def test_verdicts(spark):
    good = [" ".join(f"word{i}x{j}" for j in range(80)) for i in range(2000)]
    junk = [" ".join(f"w{i}{j}###" for j in range(80)) for i in range(700)]
    texts = good + junk
    rows = [(i, t, "en" if i % 3 else None, "s", 1) for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(i, int(i < 2000)) for i in range(2700)] + [(None, 1), (1, None), (1, 1)], "doc_id long, quality int")
    judged = rules.judge(docs_frame(spark, rows), labels).collect()
    assert len(judged) == 2700
    assert all(r["kept"] == (r["doc_id"] < 2000) for r in judged)
    assert {tuple(r["failed_rules"]) for r in judged if not r["kept"]} >= {("symbols",)}


def test_repeated_rows_and_texts_prove_nothing_more(spark):
    """Too few distinct good texts for a certificate, however often they are repeated under whatever ids."""
    good = [" ".join(f"word{i}x{j}" for j in range(80)) for i in range(150)]
    junk = [" ".join(f"w{i}{j}###" for j in range(80)) for i in range(150)]
    rows = [(i, (good + junk)[i % 300], "en", "s", 1) for i in range(3000)] * 2
    labels = spark.createDataFrame([(i, int(i % 300 < 150)) for i in range(3000)], "doc_id long, quality int")
    judged = rules.judge(docs_frame(spark, rows), labels)
    assert judged.count() == 6000 and judged.where("not kept").count() == 0


def test_many_strata(spark):
    good, junk = (" ".join(f"{w}{j}" for j in range(80)) for w in ("word", "###"))
    rows = [(i, f"{good} {i}" if i % 2 else f"{junk} {i}", f"stratum{i % 40}", "s", 1) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    assert rules.judge(docs_frame(spark, rows), labels).where("kept").count() == 400


def test_verdicts_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    judged = rules.judge(docs_frame(spark), none).collect()
    assert len(judged) == len(DOCS) and all(r["kept"] == (not r["base_failed"]) for r in judged)
    assert rules.judge(docs_frame(spark, EMPTY), none).collect() == []


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    trees = fit_trees(x[:2000], y[:2000], rounds=40, depth=3)
    assert ((trees.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97
    row = x[2000]
    total = trees.base
    for statistic, cut, leaf in zip(trees.statistic, trees.cut, trees.leaf, strict=True):
        node = 0
        while node < len(statistic):
            node = 2 * node + (2 if row[statistic[node]] > cut[node] else 1)
        total += leaf[node - len(statistic)]
    assert math.isclose(trees.score(row[None])[0], 1 / (1 + math.exp(-total)))
    assert isinstance(fit_trees(np.zeros((0, 5)), np.zeros(0)), Trees)
    assert fit_trees(x, np.ones(3000)).score(x[:1])[0] > 0.99


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables not present")
def test_classifier_and_language_on_held_out_rows(spark):
    docs, labels = (load(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    found = classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (found["predicted"] == found["quality"]).mean() >= 0.95
    assert found["score"].between(0, 1).all()
    lang = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert (lang["lang_pred"] == lang["lang"]).mean() >= 0.98


def test_classifier_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (9, 0), (None, 0), (5, None)], "doc_id long, quality int")
    rows = classify(docs_frame(spark), labels).collect()
    assert len(rows) == len(DOCS) and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in rows)
    none = labels.limit(0)
    assert {r["score"] for r in classify(docs_frame(spark), none).collect()} == {0.5}
    assert classify(docs_frame(spark, EMPTY), labels).collect() == []
    kept = good_documents(docs_frame(spark), none)
    assert kept.count() == len(DOCS) and kept.columns == docs_frame(spark).columns


def test_language_odd_rows(spark):
    rows = identify(docs_frame(spark)).collect()
    assert len(rows) == len(DOCS)
    by_text = {d[0]: d[1] for d in DOCS}
    for r in rows:
        if not any(c.isalpha() for c in by_text[r["doc_id"]] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        assert r["lang_pred"] in ("en", "de", "und") and 0 <= r["score"] <= 1
    assert identify(docs_frame(spark, EMPTY)).collect() == []
    assert fit_languages(docs_frame(spark, EMPTY)) is None
    assert {r["lang_pred"] for r in predict_languages(docs_frame(spark), None).collect()} == {"und"}


def test_strange_text_is_rejected(spark):
    rng = np.random.default_rng(0)
    words = {"en": ["the", "and", "house", "water", "green"], "de": ["und", "der", "haus", "wasser", "gruen"]}
    rows = [(i, " ".join(rng.choice(words[k], 60)), k, "s", 1) for i, k in enumerate(["en", "de"] * 60)]
    model = fit_languages(docs_frame(spark, rows), per_language=60, per_cluster=2)
    odd = docs_frame(spark, [(1, "zzq xxw qqz wwx " * 20, None, "s", 1), (2, " ".join(words["de"] * 9), None, "s", 1)])
    found = {r["doc_id"]: r for r in predict_languages(odd, model).collect()}
    assert found[1]["rejected"] and not found[2]["rejected"] and found[2]["lang_pred"] == "de"


def plain_vector(text, idf):
    """TF-IDF of one text gram by gram, in a dictionary."""
    from driftgauge.llm.language import DIMENSIONS

    chars = [32] + [ord(c) if c.isalpha() else 32 for c in text.lower()] + [32, 32]
    found, mask = Counter(), (1 << 32) - 1
    for a, b, c in zip(chars, chars[1:], chars[2:], strict=False):
        pair = (a * 0x9E3779B1 + b) & mask
        triple = (pair * 0x85EBCA6B + c) & mask
        if a != 32 or b != 32:
            found[((pair * 0xC2B2AE35) & mask) >> 20] += 1
        if b != 32:
            found[((triple * 0x27D4EB2F) & mask) >> 20] += 1
    assert DIMENSIONS == 4096
    weights = {k: math.log1p(v) * float(idf[k]) for k, v in found.items()}
    length = math.sqrt(sum(w * w for w in weights.values()))
    return {k: w / length for k, w in weights.items()}


def test_language_scores_equal_plain_cosines(spark):
    docs = load(spark, SF, "documents").select("doc_id", "text", "lang").limit(60)
    model = fit_languages(docs, per_language=40, per_cluster=3)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in predict_languages(docs, model).collect():
        own = plain_vector(texts[r["doc_id"]], model.idf)
        cosines = [sum(w * float(c[k]) for k, w in own.items()) for c in model.centroids]
        best = max(range(len(cosines)), key=lambda i: (round(cosines[i], 5), -i))
        assert r["lang_pred"] == model.languages[best] and math.isclose(r["score"], max(cosines), abs_tol=2e-3)


def test_language_model_does_not_depend_on_the_order_of_rows(spark):
    docs = load(spark, SF, "documents").select("doc_id", "text", "lang")
    docs = docs.unionAll(docs.where("lang = 'es'")).unionAll(docs.limit(20))
    one, other = (fit_languages(d, per_language=60) for d in (docs, docs.repartition(7, "text").orderBy("text")))
    assert one.languages == other.languages and len(set(one.languages)) == 4
    for name in ("centroids", "idf", "nearest"):
        assert (getattr(one, name) == getattr(other, name)).all()


def test_many_languages(spark):
    rows = [(i, f"text of language number {i % 1200} {'abcdefghij'[i % 10] * 9}", f"l{i % 1200}", "s", 1) for i in range(2400)]
    assert len(set(fit_languages(docs_frame(spark, rows), per_language=5).languages)) == 1200


def test_sample_is_bounded(spark):
    rows = spark.range(20_000).selectExpr("id as doc_id", "case when id < 50 then 'rare' else 'common' end as kind")
    found = {r["kind"]: r["count"] for r in bounded_sample(rows, "kind", 200).groupBy("kind").count().collect()}
    assert found["rare"] == 50 and 120 < found["common"] < 300
    same = spark.range(20_000).selectExpr("cast(1 as long) as doc_id", "'x' as kind")
    assert bounded_sample(same, "kind", 200).count() <= 800


def test_scores_keep_the_labelled_share_when_a_label_is_thinned(spark):
    text = "The same text for all, so nothing but the share of good labels can be learnt."
    rows = [(i, text, "en", "s", 1) for i in range(4000)]
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(4000)], "doc_id long, quality int")
    x = statistics(pa.array([text]))
    whole = fit_quality(docs_frame(spark, rows), labels).score(x)[0]
    thinned = fit_quality(docs_frame(spark, rows), labels, per_label=200).score(x)[0]
    assert abs(whole - 0.9) < 0.01 and abs(thinned - whole) < 0.03
