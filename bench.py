"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "slice_daily_load_flags", "prj_cardio_columns", "scan_power_rides", "join_near_power", "join_as_of", "join_active_phase", "agg_week_strength", "agg_pivot_metrics", "agg_session_days", "win_cardio_load", "win_baselines", "win_z_scores",
    "win_ewma", "win_lagged_correlation", "win_streaks", "win_top_exercises", "win_mean_maximal", "ded_training_load", "fea_daily", "sco_sleep", "rul_flags", "snk_sparse_upsert",
]


def main() -> None:
    from pulseframe.plans import catalog
    from pulseframe.session import get_spark

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("bench", **{"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):  # the first compiles
            t = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        took[name] = round(min(runs[1:]), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
