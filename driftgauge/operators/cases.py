"""Reader-study case selection: behaviour groups, quotas, fill, trim and case ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftgauge.functions.draws import keyed_hash
from driftgauge.functions.scores import predicted_confidence
from driftgauge.operators.decisions import first_rule
from driftgauge.operators.ordered import exact_percentiles
from driftgauge.operators.sampling import top_n
from driftgauge.operators.tables import first_wins

# Fixed values of the case-selection protocol.
HIGH_CONFIDENCE, MID_CONFIDENCE = 0.80, 0.60
OOD_NAMES = ("OOD", "PAD", "PAD-UFES", "PAD-UFES-20")
QUOTAS = {"SAFE_TRUSTED": 24, "ID_UNCERTAIN": 0, "DANGEROUS_TRAP": 24, "OOD_SHOULD_DEFER": 24, "OOD_TRAP_RESCUE": 24}
TARGET_TOTAL = 96
DANGER_SORTED = ("DANGEROUS_TRAP", "OOD_TRAP_RESCUE")
FILL_ORDER = ("DANGEROUS_TRAP", "OOD_TRAP_RESCUE", "OOD_SHOULD_DEFER", "SAFE_TRUSTED", "ID_UNCERTAIN", "UNASSIGNED")
TRIM_PRIORITY = {
    "OOD_TRAP_RESCUE": 5,
    "DANGEROUS_TRAP": 4,
    "OOD_SHOULD_DEFER": 3,
    "ID_UNCERTAIN": 2,
    "SAFE_TRUSTED": 1,
    "UNASSIGNED": 0,
}
DANGER_WEIGHTS = (0.7, 0.3, 0.5)
MINMAX_EPS = 1e-8
LOW_READER_GROUPS = ("OOD_low_maha", "ID_low_reliability_error")
SPLIT_READER_GROUP = "OOD_high_confident_wrong"


def min_max(df: DataFrame, value: str, out: str) -> DataFrame:
    """(x - min) / (max - min + eps); the range is a scalar subquery."""
    span = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    return df.withColumn(out, (F.col(value) - span["lo"]) / (span["hi"] - span["lo"] + F.lit(MINMAX_EPS)))


def behavior_groups(df: DataFrame) -> DataFrame:
    """Confidence, correctness, one behaviour group per case (first rule wins) and danger score."""
    out = (
        df.withColumn("ai_prob_pred", predicted_confidence(F.col("ai_pred"), F.col("ai_prob_malignant"), "malignant"))
        .withColumn("ai_correct", (F.col("ai_pred") == F.col("gt_label")).cast("int"))
        .withColumn("id_ood_flag", F.upper(F.trim("id_ood_flag")))
    )
    is_ood = F.col("id_ood_flag").isin(*OOD_NAMES)
    wrong, low = F.col("ai_correct") == 0, F.col("reliability_flag") == "Low"
    sure, fairly = F.col("ai_prob_pred") >= HIGH_CONFIDENCE, F.col("ai_prob_pred") >= MID_CONFIDENCE
    group = first_rule(
        [
            (is_ood & wrong & fairly & low, "OOD_TRAP_RESCUE"),
            (is_ood & low, "OOD_SHOULD_DEFER"),
            (~is_ood & low, "ID_UNCERTAIN"),
            (~is_ood & ~wrong & sure & (F.col("reliability_flag") == "High"), "SAFE_TRUSTED"),
            (wrong & fairly, "DANGEROUS_TRAP"),
        ],
        "UNASSIGNED",
    )
    a, b, c = DANGER_WEIGHTS
    scaled = min_max(out.withColumn("behavior_group", group), "maha_score", "__m")
    return scaled.withColumn(
        "danger_score", F.lit(a) * F.col("ai_prob_pred") + F.lit(b) * F.col("__m") - F.lit(c) * F.col("ai_correct")
    ).drop("__m")


def select_cases(df: DataFrame, sample_no: str, seed: int = 42, target: int = TARGET_TOTAL) -> DataFrame:
    """The case set: quotas per group, fill by priority then danger, trim, numbered ids.

    ``sample_no`` is a numeric row key that feeds the seeded draw and breaks ties. Every
    step keeps at most ``target`` rows, so the final numbering is over a fixed few.
    """
    name, danger = F.col("behavior_group"), F.col("danger_score")
    draw = keyed_hash(seed, F.col(sample_no)).cast("double")
    keyed = df.withColumn("__k", F.when(name.isin(*DANGER_SORTED), -danger).otherwise(draw))
    quota = F.create_map(*[F.lit(x) for kv in QUOTAS.items() for x in kv])
    place = F.create_map(*[F.lit(x) for i, g in enumerate(QUOTAS) for x in (g, i)])
    wanted = [g for g, n in QUOTAS.items() if n > 0]
    # the constant bound is the largest quota; each group's own quota filters what is left
    most = top_n(
        keyed.where(name.isin(*wanted)).withColumn("__pos", F.lit(0)),
        ["behavior_group"],
        [F.col("__k"), F.col(sample_no)],
        max(QUOTAS.values()),
    )
    w = Window.partitionBy("behavior_group").orderBy("__k", sample_no)
    quotas = (
        most.withColumn("__pos", F.row_number().over(w))
        .where(F.col("__pos") <= quota[name])
        .withColumn("__stage", place[name])
    )
    picked = first_wins([quotas], ["image_path"], [F.col("__stage"), F.col("__pos")])
    order = F.create_map(*[F.lit(x) for i, g in enumerate(FILL_ORDER) for x in (g, i + len(QUOTAS))])
    rest = (
        df.join(picked.select("image_path"), "image_path", "left_anti")
        .withColumn("__stage", order[name])
        .orderBy("__stage", danger.desc(), sample_no)
        .limit(target)
        .withColumn("__pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("__stage", danger.desc(), F.col(sample_no))))
    )
    have = picked.agg(F.count(F.lit(1))).scalar()
    filled = rest.where(F.col("__pos") <= F.lit(target) - have)
    both = picked.drop("__k").unionByName(filled)
    return number_cases(trim_cases(both, sample_no, target), ["__stage", "__pos"]).drop("__stage", "__pos")


def trim_cases(df: DataFrame, sample_no: str, target: int = TARGET_TOTAL) -> DataFrame:
    """Keep the target count by (priority desc, danger desc)."""
    priority = F.create_map(*[F.lit(x) for kv in TRIM_PRIORITY.items() for x in kv])
    rank = F.coalesce(priority[F.col("behavior_group")], F.lit(0))
    return df.orderBy(rank.desc(), F.col("danger_score").desc(), F.col(sample_no)).limit(target)


def number_cases(df: DataFrame, order: list[str]) -> DataFrame:
    """RS_001, RS_002, ... over the few selected rows."""
    w = Window.partitionBy(F.lit(0)).orderBy(*order)
    return df.withColumn("case_id", F.format_string("RS_%03d", F.row_number().over(w)))


def showcase(df: DataFrame, sample_no: str, n: int = 2) -> DataFrame:
    """Top-n per group with the group's own sort columns and directions."""
    g = F.col("behavior_group")
    conf, maha, danger = F.col("ai_prob_pred"), F.col("maha_score"), F.col("danger_score")
    first = F.when(g == "SAFE_TRUSTED", -conf).when(g == "OOD_SHOULD_DEFER", maha).otherwise(-danger)
    second = F.when(g == "SAFE_TRUSTED", -maha).when(g == "OOD_TRAP_RESCUE", maha).otherwise(-conf)
    wanted = df.where(g.isin("SAFE_TRUSTED", "DANGEROUS_TRAP", "OOD_SHOULD_DEFER", "OOD_TRAP_RESCUE"))
    return top_n(wanted, ["behavior_group"], [first, second, F.col(sample_no)], n)


def reader_reliability(df: DataFrame) -> DataFrame:
    """Flag per reader group: two groups are Low, one splits at its median, the rest High."""
    split = F.col("reader_group") == SPLIT_READER_GROUP
    median = exact_percentiles(df.where(split).select("reader_group", "maha_score"), ["reader_group"], "maha_score", {"__med": 0.5})
    flag = (
        F.when(F.col("reader_group").isin(*LOW_READER_GROUPS), "Low")
        .when(split & (F.col("maha_score") < F.col("__med")), "Low")
        .otherwise("High")
    )
    return df.join(F.broadcast(median), "reader_group", "left").withColumn("reader_reliability_flag", flag).drop("__med")
