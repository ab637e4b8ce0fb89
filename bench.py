"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once to warm up and then timed over a full write to the noop sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from queuetide.registry import QUERIES
from queuetide.session import build_session

HEADLINE = [
    "expected_vs_observed", "clean_obs", "normalise_feeds", "grid_average_15min", "seasonal_profiles_local",
    "profile_lookup", "lag_lookup", "asof_nearest", "asof_backward", "match_within", "historical_comparison",
    "last_n_per_key", "resample_ffill_5min", "seasonal_fill", "context_stats", "prepare_context", "batch_forecast",
    "profiles_asof_origin", "quantile_profile_model", "training_frame", "run_backtest", "success_rate_10min",
    "duration_quantiles_10min", "status_table", "effective_queue", "merge_past_future", "daily_features_5min",
    "flatten_offers", "dedup_offers", "report_lines",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(cpus), "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("grid_average_15min")
    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(run(name), 3)
    print(json.dumps({"metric": "headline queries, sum of seconds", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
