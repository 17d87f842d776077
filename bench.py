"""Time the headline queries: one JSON line on stdout."""
from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from augury.plans import catalog  # noqa: E402
from augury.session import local_session  # noqa: E402

HEADLINE = ["scored_latest", "performance_windows", "metric_bundle", "brier_parts", "slice_metrics", "prior_mean", "prior_ewm", "causal_effect",
            "pair_features", "roster_strength", "quantile_report", "roc_curve", "asof_snapshot", "asof_forecast", "best_prices", "consensus_line",
            "decide", "settled_bets", "replay", "standings", "q_forecast_board"]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{d}/orders.parquet").count()
    times = {}
    for name in (sys.argv[1:] or HEADLINE):
        t0 = time.perf_counter()
        catalog.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(d.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
