"""Operators against brute force on small fixtures, including the edge cases of the metrics."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftgauge.functions import draws, labels, scores
from driftgauge.operators import (
    bootstrap, calibration, cases, correlation, coverage, decisions, dispersion, kernels, knn, learners, manifest, moments, ordered, ranks,
    resample, sampling, scorer, separability, silhouette, sweeps, tables,
)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def score_rows(spark, id_scores, ood_scores):
    data = [("c", True, float(s)) for s in id_scores] + [("c", False, float(s)) for s in ood_scores]
    return spark.createDataFrame(data, "cell string, is_id boolean, score double")


def brute_auroc(a, b):
    a, b = np.asarray(a)[:, None], np.asarray(b)[None, :]
    return float(np.mean((a > b) + 0.5 * (a == b)))


@pytest.mark.parametrize(
    "ids,oods,want", [([1, 1, 1], [1, 1], 0.5), ([3, 4], [1, 2], 1.0), ([1, 2], [3, 4], 0.0), ([1, 2, 2], [2, 0, 3], None)]
)
def test_auroc_edges(spark, ids, oods, want):
    got = separability.auroc(score_rows(spark, ids, oods), ["cell"]).first().auroc
    assert got == pytest.approx(brute_auroc(ids, oods) if want is None else want)


def test_float_scores_make_ties(spark):
    ids, oods = [1.0, 1.0 + 1e-12], [1.0]
    df = score_rows(spark, ids, oods)
    assert separability.auroc(df, ["cell"]).first().auroc == 0.75
    assert separability.auroc(df, ["cell"], score_type="float").first().auroc == 0.5


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), float("-inf")])
def test_non_finite_scores_stop(spark, bad):
    with pytest.raises(Exception, match="non-finite"):
        separability.auroc(score_rows(spark, [1.0, bad], [0.0]), ["cell"]).collect()


def test_fpr95_is_strict(spark):
    rng = np.random.default_rng(0)
    ids, oods = rng.integers(0, 20, 200), rng.integers(-5, 15, 150)
    r = separability.separability(score_rows(spark, ids, oods), ["cell"]).first()
    thr = np.percentile(ids, 5)
    assert r.threshold == pytest.approx(thr)
    assert r.fpr95 == pytest.approx(np.mean(oods > thr))
    op = separability.operating_point(score_rows(spark, ids, oods), ["cell"]).first()
    assert (op.tp, op.fp) == ((ids > thr).sum(), (oods > thr).sum())


def test_ranged_path_equals_plain_path(spark, tiny_tasks):
    """One cell owns nearly all rows and one score a third of them."""
    rng = np.random.default_rng(1)
    s = np.where(rng.random(900) < 0.35, 0.5, rng.normal(size=900))
    ids = rng.random(900) < 0.4
    cell = np.where(rng.random(900) < 0.9, "hot", "cold")
    ok = rng.random(900) < 0.7
    df = spark.createDataFrame(
        [(str(c), bool(i), float(x), n, bool(o)) for n, (c, i, x, o) in enumerate(zip(cell, ids, s, ok))],
        "cell string, is_id boolean, score double, sample_id bigint, correct boolean",
    )
    got = {r.cell: r for r in separability.separability(df, ["cell"]).collect()}
    for c in ("hot", "cold"):
        a, b = s[(cell == c) & ids], s[(cell == c) & ~ids]
        assert got[c].auroc == pytest.approx(brute_auroc(a, b))
        assert got[c].threshold == pytest.approx(np.percentile(a, 5))
        assert got[c].fpr95 == pytest.approx(np.mean(b > np.percentile(a, 5)))
    curve = {(r.cell, r.sample_id): (r.accepted, r.risk) for r in coverage.risk_curve(df, ["cell"]).collect()}
    for c in ("hot", "cold"):
        at = np.flatnonzero(cell == c)
        order = at[np.lexsort((at, -s[at]))]
        risk = np.cumsum(~ok[order]) / np.arange(1, len(order) + 1)
        for k, n in enumerate(order):
            assert curve[(c, n)][0] == k + 1
            assert curve[(c, n)][1] == pytest.approx(risk[k])
    t = {r.cell: r for r in dispersion.trimmed_stats(df, ["cell"], "score", 0.05).collect()}
    x = np.sort(s[cell == "hot"])
    k = int(0.05 * len(x))
    assert t["hot"].trim_mean == pytest.approx(x[k:-k].mean()) and t["hot"].trim_std == pytest.approx(x[k:-k].std())
    pos = sampling.positions(df, ["cell"], "sample_id", 7).collect()
    assert sorted(r.pos for r in pos if r.cell == "hot") == list(range(1, (cell == "hot").sum() + 1))


def test_ranges_bound_the_largest_task(spark, tiny_tasks):
    df = spark.range(2000).select(F.lit("hot").alias("cell"), (F.col("id") % 3 * F.col("id")).cast("double").alias("v"), "id")
    ranged, used = ordered.with_ranges(df, "v", "id")
    assert used
    sizes = [r["count"] for r in ranged.groupBy("cell", "__range", "__tie_range").count().collect()]
    assert sum(sizes) == 2000 and max(sizes) <= 150


@pytest.mark.parametrize("n", [1, 2, 99, 100, 101])
def test_trim_sizes(spark, n):
    x = np.arange(n, dtype=float) ** 2
    df = spark.createDataFrame([("c", float(v)) for v in x], "cell string, v double")
    k = int(0.01 * n)
    want = x if n < 3 or k <= 0 or 2 * k >= n else x[k : n - k]
    r = dispersion.trimmed_stats(df, ["cell"], "v").first()
    assert (r.trim_mean, r.trim_std, r.n_kept) == (pytest.approx(want.mean()), pytest.approx(want.std()), len(want))


def test_coverage_last_prefix_wins(spark):
    ok = [1, 1, 0, 1, 1, 1, 1, 1, 1, 1, 0, 0]  # dips under 15 %, rises, dips again
    df = spark.createDataFrame([("c", i, float(-i), bool(o)) for i, o in enumerate(ok)], "cell string, sample_id bigint, score double, correct boolean")
    curve = coverage.risk_curve(df, ["cell"])
    risk = np.cumsum(1 - np.array(ok)) / np.arange(1, len(ok) + 1)
    last = np.flatnonzero(risk <= 0.15 + 1e-12).max() + 1
    assert coverage.coverage_at_risk(curve, ["cell"], (0.15,)).first().coverage_at_risk15 == pytest.approx(last / len(ok))
    none = coverage.risk_curve(df.withColumn("correct", F.lit(False)), ["cell"])
    assert coverage.coverage_at_risk(none, ["cell"], (0.1,)).first().coverage_at_risk10 == 0.0
    assert coverage.coverage_at_risk(none, ["cell"], (0.1,), none_value=None).first().coverage_at_risk10 is None


def test_weighted_coverage_equals_copied_rows(spark):
    rng = np.random.default_rng(3)
    data = [("c", i, float(rng.normal()), bool(rng.random() < 0.8), int(rng.integers(0, 4))) for i in range(60)]
    df = spark.createDataFrame(data, "cell string, sample_id bigint, score double, correct boolean, w bigint")
    for target in (0.05, 0.1, 0.2, 0.3):
        got = coverage.coverage_at_risk(coverage.risk_curve(df, ["cell"], weight=F.col("w")), ["cell"], (target,)).first()[1]
        rows = [o for r in sorted(data, key=lambda r: (-r[2], r[1])) for o in [r[3]] * r[4]]
        risk = np.cumsum(1 - np.array(rows, dtype=float)) / np.arange(1, len(rows) + 1)
        hit = np.flatnonzero(risk <= target + 1e-12)
        assert got == pytest.approx((hit.max() + 1) / len(rows) if len(hit) else 0.0)


def test_average_ranks_and_w_edges(spark):
    df = spark.createDataFrame(
        [("g", "a", "x", 1.0), ("g", "a", "y", 1.0), ("g", "a", "z", 0.0), ("g", "b", "x", 3.0), ("g", "b", "y", 2.0), ("g", "b", "z", 1.0), ("g", "c", "x", 1.0)],
        "grp string, rater string, item string, v double",
    )
    r = {(x.rater, x.item): x["rank"] for x in ranks.item_ranks(df, ["grp", "rater"], "v").collect()}
    assert (r["a", "x"], r["a", "y"], r["a", "z"], r["b", "x"]) == (1.5, 1.5, 3.0, 1.0)
    w = ranks.kendall_w(df, ["grp"], ["rater"], "item", "v").first()
    assert w.n_raters == 2  # the rater with one item does not vote
    R = np.array([[1.5, 1.5, 3], [1, 2, 3]])
    s = ((R.sum(0) - R.sum() / 3) ** 2).sum()
    assert w.kendall_w == pytest.approx(12 * s / (4 * 24 - 2 * 6))
    assert ranks.kendall_w(df.where("rater = 'b'"), ["grp"], ["rater"], "item", "v").first().kendall_w is None


def test_confidence_bins(spark):
    edges = [0.0, 1 / 15, 0.5, 8 * (1.0 / 15), 1.0]
    df = spark.createDataFrame([(float(e),) for e in edges], "c double")
    got = [r[0] for r in df.select(calibration.confidence_bin(F.col("c"))).collect()]
    bounds = np.linspace(0, 1, 16)
    want = [max(1, int(np.searchsorted(bounds, e, side="left"))) for e in edges]
    assert got == want


def test_ece_two_ways_agree(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=(400, 2)) * 2
    y = (rng.random(400) < 0.5).astype(int)
    df = spark.createDataFrame([("c", [float(a) for a in r], int(t)) for r, t in zip(z, y)], "cell string, z array<double>, y int")
    a = calibration.ece(df.select("cell", scores.msp(F.col("z")).alias("p"), scores.correct(F.col("z"), F.col("y")).alias("h")), ["cell"], "p", "h").first().ece
    b = calibration.binary_ece(df.select("cell", scores.softmax(F.col("z"))[1].alias("p"), "y"), ["cell"], "p", "y").first().ece
    assert a == pytest.approx(b, abs=1e-9)


def test_temperature_against_fine_grid(spark):
    rng = np.random.default_rng(7)
    z = rng.normal(size=(300, 4)) * 6
    p = np.exp(z / 3) / np.exp(z / 3).sum(1, keepdims=True)
    y = np.array([rng.choice(4, p=q) for q in p])
    df = spark.createDataFrame([("c", [float(a) for a in r], int(t)) for r, t in zip(z, y)], "cell string, logits array<double>, label int")
    t = calibration.fit_temperature(df, ["cell"]).first()
    grid = np.linspace(0.05, 10, 20_000)
    nll = [float(np.mean(np.log(np.exp(z / g - (z / g).max(1, keepdims=True)).sum(1)) + (z / g).max(1) - z[np.arange(300), y] / g)) for g in grid[::20]]
    assert t.t_star == pytest.approx(grid[::20][int(np.argmin(nll))], abs=0.02)
    assert t.nll_at_tstar <= min(nll) + 1e-6


def test_correlation_p_values():
    # two-sided Student-t values: r = 0.268 over 8 points; df 1 and df 2 have closed forms
    assert correlation.p_value(0.268, 8) == pytest.approx(0.521, abs=2e-3)
    assert correlation.p_value(0.5, 3) == pytest.approx(1 - 2 / np.pi * np.arcsin(0.5), abs=1e-9)
    assert correlation.p_value(0.5, 4) == pytest.approx(0.5, abs=1e-9)
    assert correlation.p_value(0.0, 10) == pytest.approx(1.0)
    assert correlation.p_value(0.4, 2) is None


def test_spearman_matches_numpy(spark):
    rng = np.random.default_rng(9)
    x, y = rng.integers(0, 10, 80), rng.normal(size=80)
    df = spark.createDataFrame([("c", float(a), float(b)) for a, b in zip(x, y)], "cell string, x double, y double")

    def rank(v):
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    assert correlation.spearman(df, ["cell"], "x", "y").first().rho == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])


# --- draws ---------------------------------------------------------------------------------


def test_hash_is_uniform_and_uncorrelated():
    ids = np.arange(20_000, dtype=np.int64)
    cols = []
    for rep in range(1, 21):
        u = draws.keyed_hash_np(42, rep, ids) / draws.MODULUS
        counts = np.histogram(u, 50, (0, 1))[0]
        assert ((counts - 400) ** 2 / 400).sum() < 100  # chi-square, 49 degrees of freedom
        cols.append(u)
    c = np.corrcoef(cols)
    assert np.abs(c[~np.eye(20, dtype=bool)]).max() < 0.035
    for u in cols:
        assert abs(np.corrcoef(u[:-1], u[1:])[0, 1]) < 0.035


def test_hash_three_ways(spark):
    import duckdb

    df = spark.range(0, 500).select("id", draws.keyed_hash(42, F.lit(3), F.col("id")).alias("h"))
    h = np.array([r.h for r in df.orderBy("id").collect()])
    assert (h == draws.keyed_hash_np(42, 3, np.arange(500))).all()
    q = duckdb.connect().execute(f"SELECT {draws.keyed_hash_sql(42, '3', 'id')} FROM (SELECT unnest(range(0, 500)) AS id) ORDER BY id").fetchall()
    assert (h == np.array([x[0] for x in q])).all()


def test_poisson_weights(spark):
    df = spark.range(0, 20_000).select(draws.poisson_weight(draws.keyed_hash(1, F.col("id"))).alias("w"))
    w = np.array([r.w for r in df.collect()])
    assert w.mean() == pytest.approx(1.0, abs=0.03) and w.var() == pytest.approx(1.0, abs=0.06)
    assert (w == 0).mean() == pytest.approx(np.exp(-1), abs=0.015)


def test_multinomial_draws_are_exact_and_shared(spark):
    df = spark.range(0, 200).select((F.col("id") % 2).alias("side"), (F.col("id") * 10).alias("sample_id"))
    two = df.crossJoin(spark.createDataFrame([("a",), ("b",)], "method string"))
    w = resample.multinomial_replicates(two, ["side"], "sample_id", 5, 42)
    sums = {tuple(r) for r in w.groupBy("side", "rep", "method").agg(F.sum("weight")).select("sum(weight)").collect()}
    assert sums == {(100,)}
    per = w.groupBy("rep", "sample_id").agg(F.count_distinct("weight").alias("d"), F.count(F.lit(1)).alias("n"))
    assert {tuple(r) for r in per.select("d", "n").distinct().collect()} == {(1, 2)}


def test_bootstrap_interval_covers_and_matches_normal_theory(spark):
    rng = np.random.default_rng(11)
    a, b = rng.normal(1, 1, 300), rng.normal(0, 1, 300)
    rows = score_rows(spark, a, b).withColumn("sample_id", F.monotonically_increasing_id() % 100_000)
    rows = spark.createDataFrame([("c", True, float(x), i) for i, x in enumerate(a)] + [("c", False, float(x), 1000 + i) for i, x in enumerate(b)], "cell string, is_id boolean, score double, sample_id bigint")
    point = brute_auroc(a, b)
    for w in (
        resample.poisson_replicates(rows, "sample_id", 200, 42),
        resample.multinomial_replicates(rows, ["cell", "is_id"], "sample_id", 200, 42),
    ):
        ci = resample.separability_ci(w, ["cell"]).first()
        half = (ci.auroc_ci_high - ci.auroc_ci_low) / 2
        boots = [brute_auroc(rng.choice(a, 300), rng.choice(b, 300)) for _ in range(400)]
        assert ci.auroc_ci_low < point < ci.auroc_ci_high
        assert half == pytest.approx(1.96 * np.std(boots), rel=0.25)


def test_bootstrap_paths_agree(spark, request):
    """One sort per cell, chained ranges, and replicate-as-key give the same replicates."""
    rng = np.random.default_rng(21)
    n = 700
    s = np.where(rng.random(n) < 0.35, 0.25, np.round(rng.normal(size=n), 2))
    data = [("hot" if i % 10 else "cold", bool(rng.random() < 0.4), float(s[i]), i) for i in range(n)]
    df = spark.createDataFrame(data, "cell string, is_id boolean, score double, sample_id bigint")

    def table(frame):
        return {(r.cell, r.rep): (round(r.auroc, 10), round(r.fpr95, 10)) for r in frame.select("cell", "rep", "auroc", "fpr95").collect()}

    one_sort = table(bootstrap.bootstrap_separability(df, ["cell"], "sample_id", 12, 42))
    by_key = table(separability.separability(resample.poisson_replicates(df, "sample_id", 12, 42), ["cell", "rep"], weight=F.col("weight")))
    request.getfixturevalue("tiny_tasks")
    ranged = table(bootstrap.bootstrap_separability(df, ["cell"], "sample_id", 12, 42))
    assert len(one_sort) == 24
    assert one_sort == by_key
    assert one_sort == ranged


def test_exact_n_draws_are_made_beside_the_rows(spark, monkeypatch):
    """The same replicates as from copied rows, for samples that only some methods score."""
    rng = np.random.default_rng(31)
    data = [("d", m, bool(i % 3), i, float(np.round(rng.normal(), 1))) for i in range(90) for m in ("msp", "energy") if m == "msp" or i % 7]
    df = spark.createDataFrame([*data, data[0]], "domain string, method string, is_id boolean, sample_id bigint, score double")
    keys, pool = ["domain", "method"], ["domain", "is_id"]
    copied = resample.multinomial_replicates(df, pool, "sample_id", 9, 42)
    copied = separability.separability(copied, [*keys, "rep"], weight=F.col("weight")).collect()
    monkeypatch.setattr(resample, "with_replicates", None)
    beside = bootstrap.bootstrap_separability_exact_n(df, keys, pool, "sample_id", 9, 42)
    table = lambda rows: {(r.method, r.rep): (round(r.auroc, 10), round(r.fpr95, 10)) for r in rows}
    assert table(beside.collect()) == table(copied) and len(copied) == 18
    monkeypatch.setattr(ordered, "ROWS_PER_RANGE", 50)
    assert bootstrap.bootstrap_separability_exact_n(df, keys, pool, "sample_id", 9, 42) is None


def test_rank_bootstrap_sends_no_ranks_while_its_cells_fit(spark, monkeypatch):
    rng = np.random.default_rng(33)
    data = [(f"c{i % 4}", i, float(rng.integers(0, 9)), float(rng.normal())) for i in range(160)]
    df = spark.createDataFrame(data, "cell string, sample_id bigint, x double, y double")
    monkeypatch.setattr(ordered, "ROWS_PER_RANGE", 50)  # all rows together are more
    monkeypatch.setattr(bootstrap, "_ranged_spearman", None)
    got = {(r.cell, r.rep): r.rho for r in bootstrap.bootstrap_spearman(df, ["cell"], "sample_id", "x", "y", 7, 42).collect()}
    weighted = resample.poisson_replicates(df, "sample_id", 7, 42)
    want = {(r.cell, r.rep): r.rho for r in resample.spearman_reps(weighted, ["cell"], "x", "y").collect()}
    assert got == pytest.approx(want) and len(got) == 28


def test_weights_of_large_cells_are_drawn_in_pieces(monkeypatch):
    sizes, draw = [], bootstrap.keyed_hash_np
    monkeypatch.setattr(bootstrap, "keyed_hash_np", lambda seed, reps, ids: sizes.append(reps.size * ids.size) or draw(seed, reps, ids))
    monkeypatch.setattr(bootstrap, "DRAW_BLOCK", 1000)
    assert bootstrap.REPLICATE_BLOCK <= 500_000
    w = np.concatenate([bootstrap._weights(np.arange(3500), reps, 42) for reps in bootstrap._blocks(3500, np.arange(1, 4))], axis=1)
    assert w.shape == (3500, 3) and max(sizes) <= 1000


def test_poisson_draws_are_those_of_the_hash():
    wide = [-1, 0, draws.MODULUS, draws.MODULUS + 1, 2**62, -(2**62), 2**63 - 1, -(2**63)]
    ids = np.r_[np.array(wide), np.random.default_rng(5).integers(-(2**63), 2**63 - 1, 40_000)]
    reps = np.arange(1, 6)
    for some in (ids, ids[:9], ids[:0]):
        drawn = draws.PoissonDraws(42, some)
        assert (drawn(reps) == bootstrap._weights(some, reps, 42).T).all()
        assert [*map(list, drawn.each(reps))] == drawn(reps).tolist()


def rank_rows(spark, n):
    rng = np.random.default_rng(41)
    x, y = np.where(rng.random(n) < 0.3, 7.0, np.round(rng.normal(size=n), 2)), np.round(rng.normal(size=n) * 3)
    return spark.createDataFrame([("hot" if i % 8 else "cold", int(i), float(x[i]), float(y[i])) for i in range(n)], "cell string, sample_id bigint, x double, y double")


def rho_table(df, reps):
    return {(r.cell, r.rep): r.rho for r in bootstrap.bootstrap_spearman(df, ["cell"], "sample_id", "x", "y", reps, 42).collect()}


def test_large_rank_bootstraps_write_rows_not_ranks(spark, tiny_tasks, monkeypatch):
    """What is exchanged and kept grows with rows and blocks, not with rows times replicates; nor are rows checkpointed."""
    df = rank_rows(spark, 640)
    sent, kept, pack = [], [], bootstrap._packed
    monkeypatch.setattr(bootstrap, "_packed", lambda *a: sent.append(pack(*a)) or sent[-1])
    monkeypatch.setattr(bootstrap, "cut_lineage", lambda small: kept.append(small) or small)
    monkeypatch.setattr(ordered, "cut_lineage", None)
    assert bootstrap.bootstrap_spearman(df, ["cell"], "sample_id", "x", "y", 200, 42).count() == 400
    assert sent and kept and all("sid" not in f.columns and f.count() < 300 for f in kept)
    for f in sent:
        assert sum(len(v) for r in f.collect() for v in r if isinstance(v, bytes | bytearray)) < 640 * 60


def test_rank_bootstrap_of_pairs_of_blocks_and_of_whole_cells(spark, request):
    """Cells of many blocks beside one that a task holds; -0.0 ties with 0.0, and ids and rows may come twice."""
    df = rank_rows(spark, 640)
    zeros = spark.createDataFrame([("hot", 10_000 + i % 90, -0.0 if i % 2 else 0.0, -0.0 if i % 3 else 0.0) for i in range(180)], df.schema)
    df = df.unionByName(zeros).unionByName(df.limit(30))
    plain = rho_table(df, 6)
    request.getfixturevalue("tiny_tasks")
    request.getfixturevalue("monkeypatch").setattr(bootstrap, "RANK_BLOCK", 4)
    assert rho_table(df, 6) == pytest.approx(plain, abs=1e-12) and len(plain) == 12


def test_rank_bootstrap_without_spread_or_rows(spark, request):
    one = "cell string, sample_id bigint, x double, y double"
    rows = [("flat", i, 2.0, float(i)) for i in range(260)] + [("few", 1, 1.0, 1.0)]
    df = spark.createDataFrame(rows, one)
    plain = rho_table(df, 5)
    request.getfixturevalue("tiny_tasks")
    assert rho_table(df, 5) == plain and {*plain.values()} == {None} and len(plain) == 10
    assert rho_table(spark.createDataFrame([], one), 5) == {}
    for n in (60, 260):
        with pytest.raises(Exception, match="NULL or NaN"):
            rho_table(spark.createDataFrame([("c", i, float(i), None if i == 3 else 1.0) for i in range(n)], one), 5)


def test_rank_and_dispersion_bootstraps_agree_on_both_paths(spark, request):
    rng = np.random.default_rng(23)
    data = [("c", "OOD" if i % 3 else "ID", i, float(rng.integers(0, 9)), float(rng.normal())) for i in range(300)]
    df = spark.createDataFrame(data, "cell string, side string, sample_id bigint, logit_norm double, logit_gap double")

    def both():
        rho = bootstrap.bootstrap_spearman(df, ["cell"], "sample_id", "logit_norm", "logit_gap", 8, 42)
        gap = bootstrap.bootstrap_dispersion_gap(df, ["cell"], "sample_id", 8, 42)
        a = {r.rep: r.rho for r in rho.collect()}
        return a, {r.rep: r.cvid_gap for r in gap.collect()}, {r.rep: r.logit_gap_gap for r in gap.collect()}

    plain = both()
    request.getfixturevalue("tiny_tasks")
    for a, b in zip(plain, both()):
        assert len(a) == 8 and a == pytest.approx(b)


def coverage_rows(spark, n, seed, wrong=0.4):
    """A hot and a cold cell; scores tie often, one heavy value holds a third of the rows."""
    rng = np.random.default_rng(seed)
    score = np.where(rng.random(n) < 0.33, 0.5, np.round(rng.normal(size=n), 1))
    right = rng.random(n) > wrong * (1.2 - (score > 0))
    data = [("hot" if i % 7 else "cold", int(i * 31 % n), float(score[i]), bool(right[i])) for i in range(n)]
    return spark.createDataFrame(data, "cell string, sample_id bigint, score double, correct boolean")


@pytest.mark.parametrize("target", [0.1, 0.3, 0.5, 0.9])
def test_coverage_bootstrap_paths_agree(spark, request, target):
    """Weight columns in one group, chained score ranges, and replicates as a key give the same coverage."""
    df = coverage_rows(spark, 600, 5)

    def table(frame):
        return {(r.cell, r.rep): round(r.coverage, 12) for r in frame.collect()}

    by_key = table(resample.coverage_reps(resample.poisson_replicates(df, "sample_id", 10, 42), ["cell"], target))
    one_sort = table(bootstrap.bootstrap_coverage(df, ["cell"], "sample_id", target, 10, 42))
    request.getfixturevalue("tiny_tasks")
    ranged = table(bootstrap.bootstrap_coverage(df, ["cell"], "sample_id", target, 10, 42))
    assert len(by_key) == 20 and one_sort == by_key and ranged == by_key


def test_coverage_bootstrap_extremes(spark, request):
    """No prefix meets the target, all do, a single row that is not always drawn."""
    rows = [("none", i, float(i), False) for i in range(80)] + [("all", i, float(i), True) for i in range(80)] + [("one", 3, 0.0, True)]
    df = spark.createDataFrame(rows, "cell string, sample_id bigint, score double, correct boolean")

    def table():
        found = bootstrap.bootstrap_coverage(df, ["cell"], "sample_id", 0.2, 12, 42).collect()
        return {(r.cell, r.rep): r.coverage for r in found}

    plain = table()
    assert {v for (c, _), v in plain.items() if c == "none"} == {0.0} and {v for (c, _), v in plain.items() if c == "all"} == {1.0}
    assert {v for (c, _), v in plain.items() if c == "one"} == {None, 1.0}
    request.getfixturevalue("tiny_tasks")
    assert table() == plain


def test_rank_bootstrap_with_heavy_ties_in_both_variables(spark, request):
    rng = np.random.default_rng(29)
    n = 500
    x = np.where(rng.random(n) < 0.4, 3.0, rng.integers(0, 40, n).astype(float))
    y = np.where(rng.random(n) < 0.3, -1.0, np.round(x + rng.normal(size=n) * 9))
    data = [("hot" if i % 9 else "cold", i, float(x[i]), float(y[i])) for i in range(n)]
    df = spark.createDataFrame(data, "cell string, sample_id bigint, x double, y double")

    def table():
        return {(r.cell, r.rep): r.rho for r in bootstrap.bootstrap_spearman(df, ["cell"], "sample_id", "x", "y", 6, 42).collect()}

    by_key = {(r.cell, r.rep): r.rho for r in resample.spearman_reps(resample.poisson_replicates(df, "sample_id", 6, 42), ["cell"], "x", "y").collect()}
    plain = table()
    request.getfixturevalue("tiny_tasks")
    request.getfixturevalue("monkeypatch").setattr(bootstrap, "RANK_BLOCK", 4)
    ranged = table()
    assert len(plain) == 12 and plain == pytest.approx(by_key) and ranged == pytest.approx(plain)


def test_dispersion_bootstrap_by_ranges_with_ties_and_missing_sides(spark, request):
    rng = np.random.default_rng(31)
    data = [("c", "OOD" if i % 4 else "ID", i, float(rng.integers(0, 3)), float(rng.normal())) for i in range(900)]
    data += [("only_id", "ID", i, float(rng.normal()), 1.0) for i in range(400)] + [("few", "OOD" if i else "ID", i, 1.5, 2.5) for i in range(3)]
    df = spark.createDataFrame(data, "cell string, side string, sample_id bigint, logit_norm double, logit_gap double")

    def table():
        found = bootstrap.bootstrap_dispersion_gap(df, ["cell"], "sample_id", 6, 42).collect()
        return {(r.cell, r.rep, c): r[c] for r in found for c in ("cvid_gap", "logit_gap_gap")}

    plain = table()
    request.getfixturevalue("tiny_tasks")
    ranged = table()
    assert {k for k, v in plain.items() if v is None} == {k for k, v in ranged.items() if v is None}
    for k, v in plain.items():
        assert v is None or ranged[k] == pytest.approx(v, abs=1e-9)


def test_packed_labels_are_the_shuffled_ones(spark):
    df = spark.range(40).selectExpr("'c' AS cell", "'c' AS __cell", "id AS __idx", "40L AS n_total", "13L AS n_id")
    reps = np.arange(1, 22)
    rows = sorted(silhouette._packed_labels(df, reps, 42).collect(), key=lambda r: r["__idx"])
    expected = silhouette.shuffled_labels(np.arange(40), 40, 13, reps, 42)
    for lo, hi in ((0, 21), (5, 21), (8, 16), (20, 21)):
        got = silhouette._labels(pa.array([bytes(r["__bits"]) for r in rows]), reps[lo:hi])
        assert (got == expected[:, lo:hi]).all()


def test_sweep_auroc_without_copies(spark):
    rng = np.random.default_rng(22)
    ids = spark.createDataFrame([("k", float(x)) for x in rng.integers(0, 30, 200)], "k string, score double")
    oods = spark.createDataFrame([("k", int(c), float(x)) for c, x in zip(rng.integers(0, 4, 300), rng.integers(-5, 25, 300))], "k string, c int, score double")
    got = {r.c: r.auroc for r in sweeps.auroc_against_shared_id(ids, oods, ["k"], ["c"]).collect()}
    a = [r.score for r in ids.collect()]
    for c in range(4):
        assert got[c] == pytest.approx(brute_auroc(a, [r.score for r in oods.where(f"c = {c}").collect()]))


def test_shuffled_labels_are_a_bijection():
    for n, n_id in ((1, 1), (17, 5), (230, 30)):
        lab = silhouette.shuffled_labels(np.arange(n), n, n_id, np.arange(1, 41), 42)
        assert (lab.sum(axis=0) == n_id).all()
    assert lab.mean(axis=1).std() < 0.1  # every row is ID about equally often


def test_silhouette_against_pairs(spark, monkeypatch):
    rng = np.random.default_rng(13)
    x, y = rng.normal(size=(40, 6)) + 0.4, rng.random(40) < 0.4
    df = spark.createDataFrame([("c", i, bool(t), [float(v) for v in r]) for i, (r, t) in enumerate(zip(x, y))], "cell string, sample_id bigint, is_id boolean, feats array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    s = []
    for i in range(40):
        own = (y == y[i]) & (np.arange(40) != i)
        a, b = d[i, own].mean(), d[i, y != y[i]].mean()
        s.append((b - a) / max(a, b))
    assert silhouette.silhouette(df, ["cell"]).first().feature_silhouette_cosine == pytest.approx(np.mean(s))
    t = silhouette.silhouette_test(df, ["cell"], 50).first()
    with monkeypatch.context() as m:
        m.setattr(kernels, "BROADCAST_BYTES", 8 * 6 * 20)  # 18 replicates per block
        assert tuple(silhouette.silhouette_test(df, ["cell"], 50).first())[1:] == pytest.approx(tuple(t)[1:])
    assert 1 / 51 <= t.silhouette_perm_p_value <= 1 and abs(t.silhouette_perm_null_mean) < 0.1


# --- vectors -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8)) + np.linspace(0, 1, 8)
    rows = [("a" if i % 3 else "b", i, [float(v) for v in x[i]]) for i in range(600)]
    return x, spark.createDataFrame(rows, "cell string, sample_id bigint, feats array<double>").cache()


def test_knn_blocks_and_pivots_are_exact(spark, cloud):
    x, df = cloud
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for block in (4096, 20):
        near = knn.knn_join(df.where("sample_id % 2 = 0"), df.where("sample_id % 2 = 1"), ["cell"], 5, block=block)
        for r in near.collect():
            t = np.array([i for i in range(0, 600, 2) if ("a" if i % 3 else "b") == r.cell])
            want = t[np.lexsort((t, np.round(1 - u[t] @ u[r.sample_id], 12)))[:5]]
            assert [n.id for n in r.neighbours] == list(want)


def test_knn_tiles(monkeypatch):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(30, 5)), np.repeat(rng.normal(size=(40, 5)), 2, axis=0)  # every row twice
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    block, far = knn._Block.of(np.arange(80), y), np.full(30, np.inf)
    whole = knn._nearest(x, block, 7, far)
    monkeypatch.setattr(knn, "TILE_QUERIES", 8)
    monkeypatch.setattr(knn, "TILE_ROWS", 3)
    tiled = knn._nearest(x, block, 7, far)
    assert np.allclose(whole[0], tiled[0])
    want = np.argsort(np.round(1 - x @ y.T, 12), axis=1, kind="stable")[:, :7]
    assert (np.sort(whole[1], axis=1) == np.sort(want, axis=1)).all() and (np.sort(tiled[1], axis=1) == np.sort(want, axis=1)).all()


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_knn_prefix_bounds_lose_nothing(monkeypatch, spread):
    """Rows near a plane and rows all over the sphere; limits from outside too."""
    rng = np.random.default_rng(8)
    basis = rng.normal(size=(6, 64))
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    y = unit(rng.normal(size=(500, 6)) @ basis + spread * rng.normal(size=(500, 64)))
    x = unit(rng.normal(size=(60, 6)) @ basis + spread * rng.normal(size=(60, 64)))
    dist = 1 - x @ y.T
    want = np.argsort(dist, axis=1, kind="stable")[:, :9]
    monkeypatch.setattr(knn, "TILE_QUERIES", 7)
    monkeypatch.setattr(knn, "TILE_ROWS", 40)
    block = knn._Block.of(np.arange(500), y)
    assert block.axes is not None
    best, near = knn._nearest(x, block, 9, np.full(60, np.inf))
    assert (near == want).all() and np.allclose(best, np.take_along_axis(dist, want, axis=1))
    limit = np.take_along_axis(dist, want, axis=1)[:, 4]
    best, near = knn._nearest(x, block, 9, limit)
    assert (near[:, :5] == want[:, :5]).all() and (best[:, :5] <= limit[:, None] + 1e-9).all()


def test_knn_training_rows_are_sent_once_whatever_the_queries(spark, monkeypatch):
    df = spark.createDataFrame([("c", i, [float(i % 17), float(i % 5), 1.0]) for i in range(300)], "cell string, sample_id bigint, feats array<double>")
    sent, search = [], knn._together

    def counted(t_side, q_side):
        sent.append(t_side.count())
        return search(t_side, q_side)

    monkeypatch.setattr(knn, "_together", counted)
    for copies in (1, 20):
        queries = df.select("cell", F.explode(F.array(*[(F.col("sample_id") * 100 + i) for i in range(copies)])).alias("sample_id"), "feats")
        assert knn.knn_join(df, queries, ["cell"], 3).count() == 300 * copies
    assert sent == [300, 300]


def test_knn_queries_are_sent_once_a_block_whatever_the_pivots(spark, monkeypatch):
    """Vectors without any order, so that no pivot is ruled out: once a query went to every pivot, with k rows back."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 24))
    rows = [("c", i, [float(v) for v in x[i]]) for i in range(900)]
    df = spark.createDataFrame(rows, "cell string, sample_id bigint, feats array<double>")
    train, queries = df.where("sample_id < 600"), df.where("sample_id >= 600")
    sent, search = [], knn._together

    def counted(t_side, q_side):
        sent.append((t_side.count(), q_side.count()))
        return search(t_side, q_side)

    monkeypatch.setattr(knn, "_together", counted)
    monkeypatch.setattr(knn, "PIVOT_ROWS", 100)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.argsort(1 - u[600:] @ u[:600].T, axis=1, kind="stable")[:, :5]
    for block, most in ((None, [(600, 300)]), (200, [(600, 300), (600, 4 * 300)])):
        sent.clear()
        near = {r.sample_id: [n.id for n in r.neighbours] for r in knn.knn_join(train, queries, ["cell"], 5, block=block).collect()}
        assert [near[600 + i] for i in range(300)] == want.tolist()
        assert len(sent) == len(most) and all(s[0] == m[0] and s[1] <= m[1] for s, m in zip(sent, most))


def test_knn_ties_go_to_the_smaller_id(spark):
    df = spark.createDataFrame([("c", i, [1.0, float(i % 2)]) for i in range(20)], "cell string, sample_id bigint, feats array<double>")
    q = spark.createDataFrame([("c", 100, [2.0, 0.0])], df.schema)
    for block in (4096, 3):
        assert [n.id for n in knn.knn_join(df, q, ["cell"], 4, block=block).first().neighbours] == [0, 2, 4, 6]


def test_ledoit_wolf_and_scores(spark, cloud):
    x, df = cloud
    fit = moments.ledoit_wolf(df, ["cell"])
    scored = {(r.cell, r.sample_id): r.score for r in scorer.mahalanobis_score(df, fit, ["cell"]).collect()}
    for r in fit.collect():
        at = np.array([i for i in range(600) if ("a" if i % 3 else "b") == r.cell])
        z = x[at] / (np.linalg.norm(x[at], axis=1, keepdims=True) + 1e-8)
        c = z - z.mean(0)
        n, p = c.shape
        s = c.T @ c / n
        mu = np.trace(s) / p
        beta = sum(np.sum((np.outer(k, k) - s) ** 2) for k in c) / n**2
        delta = np.sum((s - mu * np.eye(p)) ** 2)
        w = min(beta, delta) / delta
        assert r.shrinkage == pytest.approx(w)
        prec = np.linalg.inv((1 - w) * s + w * mu * np.eye(p))
        want = -np.sqrt(np.einsum("ij,jk,ik->i", c, prec, c))
        assert [scored[(r.cell, i)] for i in at] == pytest.approx(list(want))


def test_parameter_chunks_give_the_same_scores(spark, cloud, monkeypatch):
    _, df = cloud
    fit = moments.ledoit_wolf(df, ["cell"])
    whole = {r.sample_id: r.score for r in scorer.mahalanobis_score(df, fit, ["cell"]).collect()}
    lost = fit.where("cell <> 'b'") if "b" in {r.cell for r in fit.select("cell").collect()} else fit.limit(0)
    with pytest.raises(Exception):
        scorer.mahalanobis_score(df, lost, ["cell"]).collect()
    with monkeypatch.context() as m:
        m.setattr(kernels, "BROADCAST_BYTES", 600)
        assert len(scorer.parameter_chunks(fit, ["cell"], ["mean", "factor"])) == 2
        assert scorer.parameter_chunks(fit.where("cell = 'a'"), ["cell"], ["mean", "factor"]) == [None]
        parts = {r.sample_id: r.score for r in scorer.mahalanobis_score(df, fit, ["cell"]).collect()}
        strange = df.withColumn("cell", F.when(F.col("sample_id") == 0, "elsewhere").otherwise(F.col("cell")))
        with pytest.raises(Exception, match="no fit for cell elsewhere"):
            scorer.mahalanobis_score(strange, fit, ["cell"]).collect()
    assert parts == pytest.approx(whole)


def test_all_scores_against_numpy(spark):
    rng = np.random.default_rng(2)
    n, d, c = 300, 6, 3
    x = rng.normal(size=(n, d)) + 0.5
    w, b = rng.normal(size=(c, d)), rng.normal(size=c)
    df = spark.createDataFrame([("m", i, [float(v) for v in x[i]]) for i in range(n)], "backbone string, sample_id bigint, feats array<double>")
    heads = spark.createDataFrame([("m", k, [float(v) for v in w[k]], float(b[k])) for k in range(c)], "backbone string, class int, weight array<double>, bias double")
    rows = scorer.linear_logits(df, heads, ["backbone"])
    model = scorer.ShiftScorer(k_nearest=7).fit(rows.where("sample_id < 200"), heads, ["backbone"])
    got = {r.sample_id: r for r in model.wide(rows).collect()}
    z = x @ w.T + b
    lse = lambda q: np.log(np.exp(q).sum(1))
    tau = np.percentile(x[:200], 90)
    u = -np.linalg.pinv(w) @ b
    vals, vecs = np.linalg.eigh((x[:200] - u).T @ (x[:200] - u) / 200)
    keep = max(1, min(d - c, d - 1))
    res = np.linalg.norm((x - u) @ vecs[:, ::-1][:, keep:], axis=1)
    alpha = z[:200].max(1).mean() / (res[:200].mean() + 1e-12)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    dist = np.sort(1 - unit @ unit[:200].T, axis=1)[:, :7].mean(1)
    for i in range(n):
        r = got[i]
        assert r.msp == pytest.approx(np.exp(z[i].max()) / np.exp(z[i]).sum())
        assert r.energy == pytest.approx(lse(z)[i])
        assert r.logit_norm == pytest.approx(np.linalg.norm(z[i]))
        assert r.react_energy == pytest.approx(lse(np.minimum(x, tau) @ w.T + b)[i])
        assert r.vim == pytest.approx(lse(np.clip(z, -100, 100))[i] - alpha * res[i])
        assert r.knn == pytest.approx(-dist[i], abs=1e-12)


def test_binary_head_gives_two_logits(spark):
    df = spark.createDataFrame([("m", [1.0, 2.0])], "backbone string, feats array<double>")
    head = spark.createDataFrame([("m", 0, [0.5, 0.25], 1.0)], "backbone string, class int, weight array<double>, bias double")
    assert scorer.linear_logits(df, head, ["backbone"]).first().logits == [-2.0, 2.0]


def test_frechet_against_numpy(spark, cloud):
    x, df = cloud
    sided = df.withColumn("side", F.when(F.col("sample_id") < 250, "ID").otherwise("OOD")).withColumn("cell", F.lit("c"))
    got = moments.frechet_distance(sided, ["cell"]).first().fid
    a, b = x[:250], x[250:]
    s1, s2 = np.cov(a, rowvar=False), np.cov(b, rowvar=False)
    cross = np.sqrt(np.clip(np.linalg.eigvals(s1 @ s2).real, 0, None)).sum()
    want = np.sum((a.mean(0) - b.mean(0)) ** 2) + np.trace(s1) + np.trace(s2) - 2 * cross
    assert got == pytest.approx(want, abs=1e-9)


def test_refits_score_a_cell_beside_its_fits(spark, cloud, monkeypatch):
    """Scores of all fits stay in the task of their cell, and say what they say as rows."""
    _, df = cloud
    train = df.where("sample_id < 300")
    ev = df.where("sample_id >= 300").select("*", (F.col("sample_id") % 3 != 1).alias("is_id"), F.when(F.col("sample_id") < 450, "p").otherwise("q").alias("domain"))
    run = lambda: {(r.cell, r.domain): r for r in sweeps.subsample_refits(train, ev, ["cell"], 60, n_draws=4, by=("domain",)).collect()}
    monkeypatch.setattr(sweeps, "CELL_ENTRIES", 0)
    want = run()
    monkeypatch.undo()
    monkeypatch.setattr(sweeps, "mahalanobis_score", None)
    got = run()
    assert len(got) == 4 and got.keys() == want.keys()
    for k, r in got.items():
        assert [v for v in r if not isinstance(v, str)] == pytest.approx([v for v in want[k] if not isinstance(v, str)])


def test_react_threshold_exchanges_no_entries(spark, cloud, monkeypatch):
    _, df = cloud
    seen, place = [], scorer.distribution

    def planned(rows, *rest):
        seen.append(rows._jdf.queryExecution().executedPlan().toString())
        return place(rows, *rest)

    monkeypatch.setattr(scorer, "distribution", planned)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scorer.react_threshold(df, ["cell"]).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert seen and all("SortMergeJoin" not in plan for plan in seen)


def test_react_threshold_is_exact(spark, cloud):
    x, df = cloud
    got = {r.cell: r.tau for r in scorer.react_threshold(df, ["cell"]).collect()}
    for c in ("a", "b"):
        at = [i for i in range(600) if ("a" if i % 3 else "b") == c]
        assert got[c] == pytest.approx(np.percentile(x[at], 90))


# --- tables, labels, cases -----------------------------------------------------------------


def test_unknown_code_stops(spark):
    df = spark.createDataFrame([(" mel ",), ("nev",)], "c string")
    assert [r[0] for r in df.select(labels.code_label(F.col("c"))).collect()] == [1, 0]
    with pytest.raises(Exception, match="unknown code"):
        spark.createDataFrame([("XYZ",)], "c string").select(labels.code_label(F.col("c"))).collect()


def test_names_and_stems(spark):
    df = spark.createDataFrame([("a.PNG",), ("b",), ("c.jpeg",)], "n string")
    assert [r[0] for r in df.select(labels.with_extension(F.col("n"))).collect()] == ["a.PNG", "b.png", "c.jpeg"]
    stems = {
        "resnet18": "resnet18", "efficientnet_v2_s_224": "efficientnet_v2_s", "efficientnet_v2_s": None, "effb3_224": None,
        "resnet18_supcon": None, "vit_b_16": None, "convnext_tiny": "convnext_tiny", "foo_300": None, "224": None, "net224": "net224",
    }
    got = spark.createDataFrame([(s,) for s in stems], "s string").select("s", labels.official_backbone(F.col("s")).alias("b"))
    assert {r.s: r.b for r in got.collect()} == stems


def test_upsert_replaces_and_adds(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 9, "x"), ("c", 3, "y")], "k string, v int, arch string")
    assert sorted(map(str, rows_of(tables.upsert(old, new, ["k"]).select("k", "v", "arch")))) == sorted(map(str, [("a", 1, None), ("b", 9, "x"), ("c", 3, "y")]))


def test_lookup_guards(spark):
    left = spark.createDataFrame([("a",), ("b",)], "k string")
    with pytest.raises(Exception, match="expected one match"):
        tables.exactly_one(left, spark.createDataFrame([("a", 1)], "k string, v int"), ["k"]).collect()
    with pytest.raises(Exception, match="expected one match"):
        tables.exactly_one(left, spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int"), ["k"]).collect()
    a = spark.createDataFrame([(1, 0), (2, 1)], "id bigint, y int")
    with pytest.raises(Exception, match="do not match"):
        tables.aligned_join(a, spark.createDataFrame([(1, 0), (2, 0)], "id bigint, y int"), "id", "y").collect()
    with pytest.raises(ValueError, match="empty"):
        tables.require_rows(left.where("false"), "left")
    with pytest.raises(ValueError, match="need 3"):
        tables.require_rows(left, "left", ("k", 3))
    with pytest.raises(Exception, match="frac"):
        tables.guard(left, F.col("k") == "a", "bad frac").collect()


def test_channel_shift(spark):
    rows = [("m", s, l, c, v * 10, 10.0) for s, l, c, v in [("ID", "x", 0, 1.0), ("ID", "x", 1, 2.0), ("OOD", "x", 0, 2.0), ("OOD", "x", 1, 2.0), ("ID", "y", 0, 1.0)]]
    out = tables.channel_shift(spark.createDataFrame(rows, "m string, split string, layer string, channel int, sum double, n double"), ["m"]).first()
    assert out.bn_shift == pytest.approx(np.sqrt(0.5) / np.sqrt(2.5)) and out.n_bn_layers == 1


def test_behavior_priority(spark):
    base = dict(image_path="p", gt_label="benign", id_ood_flag=" ood ", ai_pred="malignant", ai_prob_malignant=0.9, reliability_flag="Low", maha_score=-1.0)
    rows = [
        {**base, "image_path": "1"},  # also fits OOD_SHOULD_DEFER: the first rule wins
        {**base, "image_path": "2", "gt_label": "malignant"},
        {**base, "image_path": "3", "id_ood_flag": "ID"},
        {**base, "image_path": "4", "id_ood_flag": "ID", "gt_label": "malignant", "reliability_flag": "High"},
        {**base, "image_path": "5", "reliability_flag": "High"},
        {**base, "image_path": "6", "reliability_flag": "High", "ai_prob_malignant": 0.55, "maha_score": -3.0},
    ]
    out = {r.image_path: r.behavior_group for r in cases.behavior_groups(spark.createDataFrame(rows)).collect()}
    assert list(out[str(i)] for i in range(1, 7)) == ["OOD_TRAP_RESCUE", "OOD_SHOULD_DEFER", "ID_UNCERTAIN", "SAFE_TRUSTED", "DANGEROUS_TRAP", "UNASSIGNED"]


def test_background_box_rules(spark):
    images = spark.createDataFrame([(1, 400, 300)], "image_id bigint, width int, height int")
    ann = spark.createDataFrame(
        [
            (1, 1, 1, 0, 0, 50, 50),  # shifted box 100..150 touches only an edge of box 2: kept
            (1, 2, 2, 150, 50, 200, 100),  # shifted 250..300: clear: kept
            (1, 3, 1, 300, 0, 350, 50),  # shifted box ends at the border x = 450 > 400: outside
            (1, 4, 1, 10, 200, 70, 260),  # not 50 x 50
            (1, 5, 1, 20, 100, 70, 150),  # shifted 120..170 x 100..150: corner on annotation 6 inside
            (1, 6, 1, 100, 90, 150, 140),  # shifted 200..250 x 90..140: corner on the edge of 2: kept
            (1, 7, 1, 250, 250, 300, 300),  # bottom edge touches the border: outside
        ],
        "image_id bigint, ann_id bigint, category_id int, x0 int, y0 int, x1 int, y1 int",
    )
    out = manifest.crop_manifest(images, ann)
    back = {r.ann_id for r in out.where("category_id = 0").collect()}

    def brute(i):
        box = {r.ann_id: (r.x0, r.y0, r.x1, r.y1) for r in ann.collect()}
        x0, y0, x1, y1 = box[i]
        x0, x1 = x0 + 100, x1 + 100
        if x1 >= 400 or y1 >= 300:
            return False
        return not any((a < x0 < c and b < y0 < d) or (a < x1 < c and b < y1 < d) for a, b, c, d in box.values())

    assert back == {i for i in (1, 2, 3, 5, 6, 7) if brute(i)}
    assert out.where("ann_id = 1 and category_id = 1").first().path == "001_1_1.tiff"


def test_decision_rules(spark):
    enc = spark.createDataFrame(
        [(0.6, 0.5, 0.9, 0.5), (0.9, 0.5, 0.6, 0.5), (0.9, 0.95, 0.9, 0.5), (0.8, 0.5, 0.8, 0.5), (0.8, 0.5, None, None)],
        "maha double, msp double, base_maha double, base_msp double",
    )
    assert [r.verdict for r in decisions.encoder_verdict(enc).collect()] == ["new_regime_collapse", "new_regime_rescue", "reverse", "replicate", "no_baseline"]
    res = spark.createDataFrame(
        [(0.8, 0.79, 0.5, 0.57), (0.8, 0.6, 0.5, 0.57), (0.8, 0.68, 0.5, 0.57), (0.8, None, 0.5, 0.57)],
        "msp_native double, msp_matched double, band_low double, band_high double",
    )
    assert [r.verdict for r in decisions.resolution_verdict(res).collect()] == ["architecture", "resolution_artifact", "mixed", "pending"]
    est = spark.createDataFrame(
        [(0.1, 0.1, 0.1, 0.1, -0.1, 0.01), (0.1, -0.1, -0.1, -0.1, -0.1, 0.01), (-0.1, 0.1, 0.1, 0.1, -0.1, 0.01)],
        "gap_trim_01 double, gap_trim_05 double, gap_trim_10 double, gap_median double, reference_gap double, frac_beyond_3iqr double",
    )
    assert [r.verdict for r in decisions.estimator_verdict(est).collect()] == ["real", "tail_artifact", "mixed"]
    shr = spark.createDataFrame([(0.3, 0.15), (0.3, 0.2)], "old_gap double, new_gap double")
    assert [r.verdict for r in decisions.shrink_verdict(shr).collect()] == ["promising", "dead"]


def test_group_split_is_disjoint_and_balanced(spark):
    df = spark.range(0, 5000).select((F.col("id") % 97).alias("g"), (F.col("id") * 7 % 10 < F.col("id") % 97 % 10).alias("y"))
    split = sampling.group_split(df, "g", "y")
    assert split.groupBy("g").count().where("count > 1").isEmpty()
    rate = {r.half: r.r for r in sampling.apply_split(df, split, "g").groupBy("half").agg(F.avg(F.col("y").cast("double")).alias("r")).collect()}
    assert rate["val"] == pytest.approx(rate["test"], abs=0.03)


def test_stratified_fraction_quota(spark):
    df = spark.range(0, 103).select((F.col("id") % 2).alias("s"), "id").unionByName(spark.createDataFrame([(9, 1000)], "s bigint, id bigint"))
    got = {r.s: r["count"] for r in sampling.stratified_fraction(df, ["s"], "id", 0.1, 42).groupBy("s").count().collect()}
    assert got == {0: 5, 1: 5, 9: 1}


# --- NULLs, lost rows, keys ------------------------------------------------------------------


def test_null_scores_are_no_votes(spark):
    rows = [("r1", m, float(i)) for i, m in enumerate("abcd")] + [("r2", m, float(i)) for i, m in enumerate("abdc")]
    holes = [("r3", "a", None), ("r3", "b", 1.0), ("r3", "c", 2.0), ("r3", "d", 3.0), ("r4", "a", float("nan")), ("r4", "b", 1.0)]
    schema = "rater string, item string, value double"
    want = ranks.kendall_w(spark.createDataFrame(rows, schema), [], ["rater"], "item", "value").first()
    got = ranks.kendall_w(spark.createDataFrame(rows + holes, schema), [], ["rater"], "item", "value").first()
    assert got.n_raters == 2 and got.kendall_w == pytest.approx(want.kendall_w)


@pytest.mark.parametrize("stat,column", [(correlation.pearson, "r"), (correlation.spearman, "rho")])
def test_correlation_takes_complete_pairs(spark, stat, column):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=60), rng.normal(size=60)
    rows = [("g", None if i % 5 == 0 else float(a), float("nan") if i % 7 == 0 else float(b)) for i, (a, b) in enumerate(zip(x, y))]
    full = [r for r in rows if r[1] is not None and r[2] == r[2]]
    df, clean = (spark.createDataFrame(r, "g string, x double, y double") for r in (rows, full))
    got, want = stat(df, ["g"], "x", "y").first(), stat(clean, ["g"], "x", "y").first()
    assert got.n == len(full) and got[column] == pytest.approx(want[column])


def test_null_value_stops_at_every_size(spark, monkeypatch):
    df = spark.createDataFrame([("g", float(i) if i else None, i) for i in range(200)], "g string, v double, i bigint")
    for limit in (50, 4_000_000):
        monkeypatch.setattr(ordered, "ROWS_PER_RANGE", limit)
        with pytest.raises(Exception, match="NULL in g, v"):
            ordered.exact_percentiles(df, ["g"], "v", {"p": 0.5}).collect()


def test_cells_do_not_share_names(spark):
    df = spark.createDataFrame([("a", "b\x1f"), ("a\x1f", "b"), ("a\x1f/b", "c"), ("a", "b\x1f/c")], "x string, y string")
    assert df.select(kernels.cell_key(["x", "y"]).alias("k")).distinct().count() == 4
    with pytest.raises(Exception, match="NULL in the grouping key y"):
        spark.createDataFrame([("a", None)], "x string, y string").select(kernels.cell_key(["x", "y"])).collect()


def test_aligned_join_stops_on_unmatched_rows(spark):
    a = spark.createDataFrame([(1, 0), (2, 0)], "id bigint, y int")
    for other in ([(1, 0)], [(1, 0), (2, 0), (3, 0)], [(1, 0), (2, 1)]):
        with pytest.raises(Exception, match="rows do not match"):
            tables.aligned_join(a, spark.createDataFrame(other, "id bigint, y int"), "id", "y").collect()
    assert tables.aligned_join(a, a, "id", "y").count() == 2


def test_queries_of_cells_without_training_rows_stay(spark, cloud):
    _, df = cloud
    other = df.limit(3).withColumn("cell", F.lit("nowhere"))
    both = df.union(other)
    near = {(r.cell, r.sample_id): r.mean_distance for r in knn.knn_distance(df, both, ["cell"], 5).collect()}
    assert len(near) == both.count()
    assert all((d is None) == (c == "nowhere") for (c, _), d in near.items())


def test_more_pivots_find_the_same_neighbours(spark, cloud):
    _, df = cloud
    want = {(r.cell, r.sample_id): r.mean_distance for r in knn.knn_distance(df, df, ["cell"], 7).collect()}
    got = {(r.cell, r.sample_id): r.mean_distance for r in knn.knn_distance(df, df, ["cell"], 7, block=16).collect()}
    assert got == pytest.approx(want)


def test_scores_are_fitted_on_request(spark, cloud):
    _, df = cloud
    train = df.withColumn("split", F.lit("train"))
    alone = scorer.ShiftScorer(k_nearest=3).fit(train, None, ["cell"])
    assert alone.methods == scorer.FEATURE_ONLY
    assert [c for c in alone.wide(train).columns if c in scorer.METHODS] == ["mahalanobis", "knn"]
    only = scorer.ShiftScorer(methods=("mahalanobis",)).fit(train, None, ["cell"])
    assert set(only.params.columns) == {"cell", "mean", "factor", "shrinkage", "condition"}
    with pytest.raises(ValueError, match="need heads"):
        scorer.ShiftScorer(methods=("vim",)).fit(train, None, ["cell"])
    with pytest.raises(ValueError, match="unknown"):
        scorer.ShiftScorer(methods=("magic",))


def test_sizes_beyond_the_table_have_no_rows(spark, cloud):
    _, df = cloud
    n = df.where("cell = 'a'").count()
    subsets = sweeps.nested_subsets(df.where("cell = 'a'"), ["cell"], (10, n, n + 1))
    assert {r.n_train: r["count"] for r in subsets.groupBy("n_train").count().collect()} == {10: 10, n: n}


def test_draws_are_the_smallest_hashes_of_each_draw(spark):
    df = spark.range(3000).selectExpr("if(id < 2900, 'large', 'small') AS cell", "id AS sample_id")
    got = {}
    for r in sweeps.repeated_draws(df, ["cell"], 40, 3).collect():
        got.setdefault((r.cell, r.draw), set()).add(r.sample_id)
    for (cell, draw), chosen in got.items():
        ids = np.arange(2900) if cell == "large" else np.arange(2900, 3000)
        hashes = draws.keyed_hash_np(42, np.int64(draw), ids)
        assert chosen == set(ids[np.lexsort((ids, hashes))[:40]].tolist())
    assert len(got) == 6


def test_refits_show_the_full_fit_and_skip_small_cells(spark, cloud):
    _, df = cloud
    sizes = {r.cell: r["count"] for r in df.groupBy("cell").count().collect()}
    limit = min(sizes.values())
    ev = df.withColumn("is_id", F.col("sample_id") % 2 == 0)
    rows = {r.cell: r for r in sweeps.subsample_refits(df, ev, ["cell"], limit, n_draws=3).collect()}
    assert set(rows) == set(sizes)
    for cell, r in rows.items():
        assert r.n_full == sizes[cell] and r.subsampled == (sizes[cell] > limit)
        if not r.subsampled:
            assert (r.n_sub, r.n_draws, r.auroc_sub_std, r.auroc_sub_mean) == (r.n_full, 0, 0.0, r.auroc_full)
        else:
            assert r.n_draws == 3 and r.n_sub == limit


def test_draws_use_all_bits_of_a_key():
    ids = np.array([5, 5 + draws.MODULUS, 5 + 2 * draws.MODULUS, 5 + (1 << 40), 40_692, draws.MODULUS], dtype=np.int64)
    reps = np.arange(400)
    h = draws.keyed_hash_np(1, reps[:, None], ids[None, :])
    same = [(h[:, i] == h[:, j]).sum() for i in range(len(ids)) for j in range(i)]
    assert max(same) <= 1
    size = 1 << 45  # a pool far beyond 31 bits is reached to its end
    target = draws.wide_hash_np(1, 3, np.arange(20_000)) % size
    assert target.max() > 0.999 * size and abs((target < size / 2).mean() - 0.5) < 0.02


def test_dispersion_gap_is_null_without_a_side(spark, monkeypatch):
    rows = [("c", i, "OOD" if i < 3 else "ID", 1.0 + i, 2.0 + i) for i in range(6)]
    df = spark.createDataFrame(rows, "cell string, sample_id bigint, side string, logit_norm double, logit_gap double")
    found = []
    for limit in (4_000_000, 2):
        monkeypatch.setattr(ordered, "ROWS_PER_RANGE", limit)
        reps = bootstrap.bootstrap_dispersion_gap(df, ["cell"], "sample_id", 60)
        found.append({r.rep: (r.cvid_gap, r.logit_gap_gap) for r in reps.collect()})
    small, large = found
    blank = {b for b, (c, _) in small.items() if c is None}
    assert blank and blank == {b for b in small if large.get(b, (None, None))[0] is None}
    for b in set(small) - blank:
        assert large[b] == pytest.approx(small[b])


def test_names_of_the_coded_table(spark):
    df = spark.createDataFrame([("photo.jpg",), ("a.PNG",), ("b",)], "n string")
    assert rows_of(df.select(labels.with_extension(F.col("n"), known=(".png",)))) == [("photo.jpg.png",), ("a.PNG",), ("b.png",)]


def plain_logistic(x, y, c, ridge, blocks):
    """Gradient descent to the optimum of the penalised loss, last coefficient unpenalised."""
    theta = np.zeros((blocks, x.shape[1]))
    for _ in range(200):
        g, h = learners.derivatives(x, y, c, theta)
        pen = np.tile(np.r_[np.full(x.shape[1] - 1, ridge), 1e-9], blocks)
        step = np.linalg.solve(h + np.diag(pen), g + pen * theta.ravel())
        theta = theta - step.reshape(theta.shape)
    return theta


@pytest.mark.parametrize("blocks", [1, 3])
def test_derivatives_against_differences(blocks):
    rng = np.random.default_rng(blocks)
    x, y, c = learners.with_ones(rng.normal(size=(30, 3))), rng.integers(0, max(2, blocks), 30), rng.random(30)
    theta = rng.normal(size=(blocks, 4))

    def loss(t):
        z = x @ t.reshape(blocks, -1).T
        if blocks == 1:
            return float((c * (np.logaddexp(0, z[:, 0]) - y * z[:, 0])).sum())
        return float((c * (np.log(np.exp(z).sum(axis=1)) - z[np.arange(30), y])).sum())

    g, h = learners.derivatives(x, y, c, theta)
    eps, flat = 1e-5, theta.ravel()
    for i in range(len(flat)):
        e = np.zeros(len(flat))
        e[i] = eps
        assert (loss(flat + e) - loss(flat - e)) / (2 * eps) == pytest.approx(g[i], rel=1e-4, abs=1e-6)
        up, down = (learners.derivatives(x, y, c, (flat + s * e).reshape(theta.shape))[0] for s in (1, -1))
        assert (up - down) / (2 * eps) == pytest.approx(h[i], rel=1e-4, abs=1e-6)


def test_probes_are_fitted_per_cell(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for cell, classes in (("two", 2), ("four", 4)):
        y = rng.integers(0, classes, 240)
        x = rng.normal(size=(240, 5)) + np.eye(5)[y] * 1.5
        rows += [(cell, i, int(t), [float(v) for v in r]) for i, (r, t) in enumerate(zip(x, y))]
        want[cell] = plain_logistic(learners.with_ones(x), y, np.ones(240), 1.0, 1 if classes == 2 else classes)
    df = spark.createDataFrame(rows, "cell string, sample_id bigint, label int, feats array<double>").repartition(5)
    heads = learners.fit_probe(df, ["cell"])
    got = {c: [] for c in want}
    for r in heads.orderBy("cell", "class").collect():
        got[r.cell].append([*r.weight, r.bias])
    for cell, theta in want.items():
        found, known = np.array(got[cell]), theta
        if len(known) > 1:  # a shift common to all intercepts changes nothing
            found[:, -1] -= found[:, -1].mean()
            known[:, -1] -= known[:, -1].mean()
        assert found == pytest.approx(known, abs=1e-5)
    logits = scorer.linear_logits(df, heads, ["cell"])
    right = logits.withColumn("ok", scores.correct(F.col("logits"), F.col("label"))).groupBy("cell").agg(F.avg("ok").alias("a")).collect()
    assert min(r.a for r in right) > 0.6


def test_domain_classifier_per_cell(spark):
    rng = np.random.default_rng(9)
    rows = []
    for cell, shift in (("far", 3.0), ("same", 0.0)):
        for i in range(200):
            ood = i % 4 == 0
            rows.append((cell, i, not ood, [float(v) for v in rng.normal(size=6) + (shift if ood else 0.0) * np.eye(6)[0]]))
    df = spark.createDataFrame(rows, "cell string, sample_id bigint, is_id boolean, feats array<double>")
    per = learners.domain_classifier(df, ["cell"]).collect()
    assert len(per) == 10
    summary = {r.cell: r.mean_auroc for r in learners.classifier_summary(spark.createDataFrame(per), ["cell"]).collect()}
    assert summary["far"] > 0.9 and 0.3 < summary["same"] < 0.7
    alone = learners.classifier_summary(learners.domain_classifier(df.where("cell = 'far'"), ["cell"]), ["cell"]).first()
    assert alone.mean_auroc == pytest.approx(summary["far"])
