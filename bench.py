"""Headline benchmark: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Seconds include planning and a
full evaluation of every output row (noop sink).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from barlab.catalog import load_all
from barlab.registry import QUERIES
from barlab.session import local_session

HEADLINE = (
    "metrics_basic", "sma", "market_panel", "rolling_moments", "feature_matrix", "examples_weekly", "spec_catalog_weekly", "eval_rule_candidates",
    "grid_sweep", "eval_weekly_rotation", "bars_validate", "leaderboard_merge", "state_merge", "parallelism_sweep", "block_bootstrap", "robust_verdict",
    "duplicates_near_corr", "permutation_pvalue", "ml_sweep_eval",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    QUERIES["sma"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
