"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the local threads.
Each query runs once to warm up and is then timed from building the plan to having produced every row.
"""

from __future__ import annotations

import json
import os
import time

from cardwatch.plans.registry import QUERIES
from cardwatch.session import local_session
from cardwatch.sources.events_view import read_events

HEADLINE = [
    "features_matrix",
    "decisions",
    "decision_counts",
    "rule_hit_counts",
    "contract_error_counts",
    "contract_json_valid",
    "velocity_windows",
    "velocity_sweep",
    "asof_profile",
    "card_bursts",
    "time_split",
    "training_stats",
    "metrics_report",
    "threshold_sweep",
    "psi_features",
    "correlation",
    "rule_activity",
    "stream_scores",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    rows = read_events(spark, folder).count()
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "rows": rows,
        "rows_per_sec_scored": round(rows / seconds["decisions"]),
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
