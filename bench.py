"""Benchmark: the headline risk-transition queries at one scale factor.

Stage 1 builds the verified panel from the raw tables and writes it as a
month-partitioned Parquet table (timed as ``build_verified_panel``); the
headline queries then run against it, each timed end to end (plan + execute
+ collect of a small result or a count for large ones).

Before timing, the same build and queries run once, untimed, on the smallest
test scale (``BENCH_WARMUP_DIR``, default /root/testdata/sf0.001; set it to
an empty string to skip): JVM JIT and codegen caches are warm, so the timed
numbers measure steady-state work at the benchmark scale.

Prints ONE JSON line: {"metric": "total_sec", "value": N, "unit": "sec",
"queries": {...}, "sf": ...}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskflow.plans import queries as Q  # noqa: E402
from riskflow.session import get_session  # noqa: E402

HEADLINE = [
    "transition_matrix", "segment_transition_matrices", "lifecycle_transition_matrices", "key_rates",
    "rule_report", "panel_shape", "risk_trend", "portfolio_snapshot", "forecast", "power_table",
    "portfolio_evolution", "portfolio_forecast_table", "within_term_watchlist", "critical_accounts",
    "absorption_summary", "fundamental_matrix", "segment_forecast", "scored_snapshot", "watchlist_page",
    "prediction_summary", "trajectory_features", "class_report", "model_comparison",
    "account_profile", "account_history",
]
# Large outputs are counted instead of collected to the driver.
COUNT_ONLY = {"trajectory_features", "account_history", "scored_snapshot"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=max(8, cpus),
                        app="riskflow-bench")
    spark.range(1000).selectExpr("sum(id)").collect()  # JVM warm-up, not timed
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if warm and os.path.isdir(warm) and os.path.abspath(warm) != os.path.abspath(sf_dir):
        run_all(spark, warm)

    times = run_all(spark, sf_dir)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}
    print(json.dumps(out))
    spark.stop()


def run_all(spark, sf_dir: str) -> dict[str, float]:
    times: dict[str, float] = {}
    t0 = time.time()
    port = Q.pf(spark, sf_dir)
    mat = port.materialize()
    times["build_verified_panel"] = round(time.time() - t0, 3)
    Q._PORTFOLIOS[(id(spark), sf_dir)] = mat

    for name in HEADLINE:
        t = time.time()
        df = Q.QUERIES[name](spark, sf_dir)
        if name in COUNT_ONLY:
            df.count()
        else:
            df.collect()
        times[name] = round(time.time() - t, 3)
    return times


if __name__ == "__main__":
    main()
