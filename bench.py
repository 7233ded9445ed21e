"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from driftgauge.session import local_session

HEADLINE = [
    "msp_separability",
    "score_family_separability",
    "bulk_separability",
    "operating_point",
    "dispersion_table",
    "robust_profile",
    "spearman_by_group",
    "kendall_w",
    "kendall_w_jackknife",
    "risk_curve",
    "selective_report",
    "selection_report",
    "severity_sweep",
    "react_energy",
    "ledoit_wolf_shrinkage",
    "knn_score",
    "all_method_separability",
    "cosine_silhouette",
    "silhouette_permutation",
    "bootstrap_separability",
    "bootstrap_coverage",
    "w_permutation_locked",
    "stratified_fraction",
    "case_selection",
    "crop_manifest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("driftgauge-bench", cpus, os.environ.get("BENCH_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="driftgauge-bench-"))
    spark.sparkContext.setLogLevel("ERROR")
    from driftgauge.plans.catalog import QUERIES

    # start the engine and the Python workers outside the timings
    QUERIES[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
