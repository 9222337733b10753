"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR   folder of the Parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names, or "all" (default: the headline list)
BENCH_RUNS     timed runs after one warm-up, median reported (default 2)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from weighbridge.catalogue import QUERIES  # noqa: E402
from weighbridge.session import local_session  # noqa: E402
from weighbridge.sources import release  # noqa: E402

HEADLINE = [
    "weighted_trend", "weighted_mean_global", "participation_full_join", "missingness", "key_audit", "cleaning",
    "score_summary", "country_harmonise", "entities_per_country", "sector_audit", "both_periods_change", "coverage",
    "quantile_cuts", "quantile_band", "banded_mobility", "gap_segments", "gap_latest", "spend_vs_score",
    "gdp_vs_score_log", "ratio_vs_score", "fit_band", "sector_gap", "sector_gap_fanout", "gender_gap", "parity_band",
    "latest_with_ties", "latest_one", "groups_of_size", "anti_all_columns", "histogram30", "enriched", "corr_long",
    "split_assign", "rmse_mean_baseline", "linear",
    "linear_one_feature", "forest", "boosted", "scorecard",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")

    def timed(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - start
        release(spark)
        return took

    seconds: dict[str, float] = {}
    for name in names:
        timed(name)
        seconds[name] = round(statistics.median(timed(name) for _ in range(runs)), 4)
    print(json.dumps({
        "metric": "total seconds over headline queries, median of runs after warm-up",
        "value": round(sum(seconds.values()), 4),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
