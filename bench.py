"""Benchmark: headline analysis queries on $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS]; prints one JSON line. Every query runs to completion (noop sink for per-row
tables, so nothing is collected to the driver)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "e1_ols_full_adjustment",      # Gram job, 4 coefficients with inference
    "e2_diff_in_means",
    "e6_did_ols_adjusted",
    "e3_logit_adjusted",           # Spark ML IRLS
    "u1_bootstrap_ols",            # 50 replicates, one job
    "u1_bootstrap_logit",          # 50 replicates, Newton steps for all replicates per job
    "u6_estimate_record",
    "g1_g5_g7_hte_table",          # all features from one shared Gram job
    "e9_propensity_logistic",
    "e10_psm_logistic",            # distributed 1-D nearest neighbour
    "e11_iptw_stratified",
    "e14_dml_residuals_cell_mean",
    "e15_linear_dml_cell_mean",
    "e16_causal_forest",
    "e13_t_learner_forest",
    "r1_r2_r3_refutation",         # 2 x 100 simulations, one job each
    "f1_describe",
    "f3_correlation",
    "f13_box_stats_by_group",
    "c14_step_chain",
    "c12_qcut",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from causeway.plans.catalog import QUERIES
    from causeway.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=max(8, int(cpus) if cpus.isdigit() else 8), app="causeway-bench")
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in QUERIES]
    # warm-up: JVM, parquet footers, codegen caches
    QUERIES["e2_diff_in_means"](spark, sf_dir).collect()
    times = {}
    for n in names:
        t0 = time.time()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
