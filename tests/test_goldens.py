"""Published result tables as small literal fixtures: input table in, published number out."""

import pytest
from pyspark.sql import functions as F

from driftgauge.operators import decisions, ranks, resample, selection, tables

BACKBONES = [
    "convnext_tiny", "densenet121", "effb3", "efficientnet_v2_s", "mobilenet_v3_large", "regnet_y_3_2gf", "resnet18", "resnet50",
]
# AUROC per method (rows) and backbone (columns), three domains.
AUROC = {
    "histology": {
        "energy": [0.876918, 0.877358, 0.802418, 0.786434, 0.77967, 0.800133, 0.569142, 0.512159],
        "knn": [0.916368, 0.973391, 0.933782, 0.855747, 0.903942, 0.955816, 0.935579, 0.86606],
        "logit_norm": [0.845087, 0.88267, 0.802962, 0.779083, 0.773639, 0.794098, 0.574345, 0.513364],
        "mahalanobis": [0.92834, 0.988308, 0.885193, 0.880089, 0.869687, 0.96411, 0.955776, 0.895532],
        "msp": [0.845635, 0.882671, 0.802589, 0.778282, 0.770524, 0.783574, 0.574334, 0.514974],
        "react_energy": [0.691591, 0.917871, 0.801153, 0.795992, 0.779966, 0.846998, 0.689738, 0.721813],
        "vim": [0.81227, 0.879494, 0.733945, 0.733466, 0.6955, 0.779571, 0.714827, 0.639546],
    },
    "mitosis": {
        "energy": [0.560174, 0.431455, 0.533247, 0.507899, 0.458139, 0.609159, 0.376069, 0.518401],
        "knn": [0.654938, 0.777591, 0.643303, 0.559007, 0.674377, 0.904704, 0.684022, 0.716303],
        "logit_norm": [0.602051, 0.460284, 0.577793, 0.532126, 0.483401, 0.642237, 0.376714, 0.515741],
        "mahalanobis": [0.80065, 0.910377, 0.673074, 0.580865, 0.714335, 0.944148, 0.732672, 0.838667],
        "msp": [0.520607, 0.446577, 0.485679, 0.493121, 0.469254, 0.553186, 0.437999, 0.51245],
        "react_energy": [0.522374, 0.437786, 0.552435, 0.510172, 0.466281, 0.640976, 0.41111, 0.53057],
        "vim": [0.709842, 0.553614, 0.580983, 0.510316, 0.593133, 0.655059, 0.609105, 0.661138],
    },
    "skin": {
        "energy": [0.673422, 0.69633, 0.697279, 0.74376, 0.701982, 0.69534, 0.767371, 0.693478],
        "knn": [0.915031, 0.896547, 0.896019, 0.849254, 0.906564, 0.95514, 0.861862, 0.900411],
        "logit_norm": [0.739203, 0.681104, 0.702298, 0.736498, 0.710555, 0.721887, 0.743918, 0.696756],
        "mahalanobis": [0.948128, 0.972048, 0.951021, 0.889976, 0.926221, 0.968522, 0.934751, 0.966569],
        "msp": [0.75484, 0.680181, 0.703309, 0.736729, 0.714444, 0.720269, 0.735808, 0.697568],
        "react_energy": [0.547284, 0.688195, 0.715975, 0.738967, 0.71198, 0.707331, 0.779536, 0.696409],
        "vim": [0.80381, 0.749857, 0.764339, 0.755072, 0.757536, 0.717578, 0.784451, 0.838826],
    },
}
# One backbone over seeds 43-46 (seed 42 is the table above).
DENSE_SEEDS = {
    43: {"msp": 0.865479, "energy": 0.862278, "react_energy": 0.881453, "logit_norm": 0.865506, "mahalanobis": 0.983464, "knn": 0.960773, "vim": 0.93244},
    44: {"msp": 0.867682, "energy": 0.866665, "react_energy": 0.910125, "logit_norm": 0.867657, "mahalanobis": 0.989273, "knn": 0.979561, "vim": 0.851499},
    45: {"msp": 0.845036, "energy": 0.844545, "react_energy": 0.901361, "logit_norm": 0.84504, "mahalanobis": 0.988297, "knn": 0.97334, "vim": 0.828336},
    46: {"msp": 0.826053, "energy": 0.831237, "react_energy": 0.87559, "logit_norm": 0.826073, "mahalanobis": 0.989105, "knn": 0.971071, "vim": 0.882001},
}
# MSP AUROC by seed for the jump test.
SEED_MSP = {
    42: {"resnet18": 0.574334, "resnet50": 0.514974, "densenet121": 0.882671, "effb3": 0.802589},
    43: {"resnet18": 0.712339, "resnet50": 0.620886, "densenet121": 0.865479, "effb3": 0.731093},
    44: {"resnet18": 0.600748, "resnet50": 0.619240, "densenet121": 0.867682, "effb3": 0.643415},
    45: {"resnet18": 0.523947, "resnet50": 0.515371, "densenet121": 0.845036, "effb3": 0.817575},
    46: {"resnet18": 0.581095, "resnet50": 0.661075, "densenet121": 0.826053, "effb3": 0.678096},
}
# AUROC and coverage at 10 % risk, full / validation half / test half.
HALVES = [
    ("resnet18", 0.574334, 0.144567, 0.549440, 0.184681, 0.597739, 0.109633),
    ("resnet50", 0.514974, 0.149141, 0.453378, 0.232428, 0.572890, 0.079294),
    ("densenet121", 0.882671, 0.078421, 0.854432, 0.144649, 0.909223, 0.021283),
    ("convnext_tiny", 0.845635, 0.369894, 0.877469, 0.251959, 0.815703, 0.538586),
    ("mobilenet_v3_large", 0.770524, 0.903520, 0.846153, 0.770386, 0.699416, 1.0),
    ("regnet_y_3_2gf", 0.783574, 0.440261, 0.788200, 0.444816, 0.779224, 0.436937),
    ("effb3", 0.802589, 0.106521, 0.748914, 0.159425, 0.853056, 0.054224),
    ("efficientnet_v2_s_224", 0.778282, 0.779822, 0.752861, 0.821312, 0.802183, 0.753564),
]


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(d, b, m, x) for d, ms in AUROC.items() for m, xs in ms.items() for b, x in zip(BACKBONES, xs)]
    return spark.createDataFrame(rows, "domain string, backbone string, method string, auroc double").cache()


def test_kendall_w_by_domain(cells):
    w = {r.domain: r for r in ranks.kendall_w(cells, ["domain"], ["backbone"], "method", "auroc").collect()}
    assert w["histology"].kendall_w == pytest.approx(0.694196, abs=1e-6)
    assert w["mitosis"].kendall_w == pytest.approx(0.866071, abs=1e-6)
    assert w["skin"].kendall_w == pytest.approx(0.791295, abs=1e-6)
    assert w["histology"].friedman_chi2 == pytest.approx(33.321, abs=1e-3)


def test_method_subsets(cells):
    def w(methods, domain):
        sub = cells.where((F.col("domain") == domain) & F.col("method").isin(*methods))
        return ranks.kendall_w(sub, ["domain"], ["backbone"], "method", "auroc").first().kendall_w

    assert w(ranks.FEATURE_METHODS, "histology") == pytest.approx(0.25)
    assert w(ranks.LOGIT_METHODS, "histology") == pytest.approx(0.015625)
    assert w(ranks.FEATURE_METHODS, "mitosis") == pytest.approx(1.0)
    assert w(ranks.LOGIT_METHODS, "mitosis") == pytest.approx(0.4375)


def test_jackknife(cells):
    got = {r.held_out: r.kendall_w for r in ranks.jackknife_w(cells.where("domain = 'histology'"), ["domain"], "backbone", "method", "auroc").collect()}
    want = {
        "convnext_tiny": 0.737609, "densenet121": 0.685131, "effb3": 0.715743, "efficientnet_v2_s": 0.676385,
        "mobilenet_v3_large": 0.682216, "regnet_y_3_2gf": 0.676385, "resnet18": 0.724490, "resnet50": 0.705539,
    }
    assert got == pytest.approx(want, abs=1e-6)


def test_cross_seed_w(spark):
    rows = [(42, m, AUROC["histology"][m][1]) for m in AUROC["histology"]]
    rows += [(s, m, x) for s, ms in DENSE_SEEDS.items() for m, x in ms.items()]
    df = spark.createDataFrame(rows, "seed int, method string, auroc double").withColumn("anchor", F.lit("densenet121"))
    w = ranks.kendall_w(df, ["anchor"], ["seed"], "method", "auroc").first().kendall_w
    assert w == pytest.approx(0.789, abs=6e-4)


def test_seed_jump_verdicts(spark):
    rows = [(s, b, x) for s, bs in SEED_MSP.items() for b, x in bs.items()]
    df = spark.createDataFrame(rows, "seed int, backbone string, auroc double")
    jumps = tables.baseline_jump(df, ["seed"], "backbone", ["resnet18", "resnet50"], "auroc")
    out = {r.backbone: r for r in decisions.seed_verdict(jumps, ["backbone"]).collect()}
    dense, eff = out["densenet121"], out["effb3"]
    assert (round(dense.mean_jump, 3), round(dense.sd_jump, 3), dense.n_hit, dense.verdict) == (0.265, 0.065, 5, "robust")
    assert (round(eff.mean_jump, 3), round(eff.sd_jump, 3), eff.n_hit, eff.verdict) == (0.142, 0.125, 2, "seed_fragile")


def test_scenario(cells):
    family = ["effb3", "efficientnet_v2_s"]
    out = decisions.scenario(cells, ["domain"], ["resnet18", "resnet50"], family, ["resnet18", "resnet50", "effb3"], 8)
    by = {r.domain: r.scenario for r in out.collect()}
    assert by["histology"] == "A"
    few = cells.where("backbone <> 'effb3'")
    assert {r.scenario for r in decisions.scenario(few, ["domain"], ["resnet18", "resnet50"], family, ["resnet18"], 8).collect()} == {"pending_n"}


def test_selection_pipelines(spark):
    cols = "backbone string, auroc_full double, cov10_full double, auroc_val double, cov10_val double, auroc_test double, cov10_test double"
    out = {r.rule: r for r in selection.selection_report(spark.createDataFrame(HALVES, cols), "backbone").collect()}
    assert out["auroc_on_val"].picked == "convnext_tiny"
    assert out["coverage_on_val"].picked == "efficientnet_v2_s_224"
    gain = out["coverage_on_val"].cov10_test - out["auroc_on_val"].cov10_test
    assert gain == pytest.approx(0.215, abs=5e-4)
    assert out["oracle_auroc_full"].picked == "densenet121"
    assert out["oracle_coverage_full"].picked == "mobilenet_v3_large"


def test_locked_permutation_null(cells):
    """Published: most of W on this domain is the feature methods' lock (p about 0.22)."""
    order = F.create_map(*[F.lit(x) for i, m in enumerate(AUROC["histology"]) for x in (m, i)])
    place = F.create_map(*[F.lit(x) for i, b in enumerate(BACKBONES) for x in (b, i)])
    df = cells.where("domain = 'histology'").withColumns({"rater_no": place[F.col("backbone")], "item_no": order[F.col("method")]})
    free = resample.w_permutation_test(df, ["domain"], "backbone", "method", "auroc", 1000).first()
    locked = resample.w_permutation_test(df, ["domain"], "backbone", "method", "auroc", 1000, locked=ranks.FEATURE_METHODS).first()
    assert free.p_greater == pytest.approx(1 / 1001)
    assert 0.15 < locked.p_greater < 0.30
    assert 0.70 < locked.p_less < 0.87


def test_rank_disagreement_order_strings(spark):
    rows = [  # one published block: AUROC, coverage (all tied), AURC; input order breaks ties
        (0, "resnet18", 0.574334, 1.0, 7.638e-05), (1, "resnet50", 0.514974, 1.0, 8.247e-05),
        (2, "effb3", 0.802589, 1.0, 6.309e-05), (3, "effb3_224", 0.787140, 1.0, 7.586e-05),
    ]
    df = spark.createDataFrame(rows, "ord int, model string, ood_auroc double, coverage_at_risk10 double, aurc double").withColumn("domain", F.lit("d"))
    r = tables.rank_disagreement(df, ["domain"], "model", "ord").first()
    assert r.rank_by_ood_auroc == "effb3>effb3_224>resnet18>resnet50"
    assert r.rank_by_coverage_at_risk10 == "resnet18>resnet50>effb3>effb3_224"
    assert r.rank_by_aurc == "effb3>effb3_224>resnet18>resnet50"
    assert r.auroc_vs_coverage10_disagree and not r.auroc_vs_aurc_disagree
