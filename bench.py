"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one warm-up, then the median of $BENCH_REPEATS runs each (2).

Prints one JSON line. Every query is run whole into the noop sink, so all rows are computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wardline.plans.registry import Tables, load_all  # noqa: E402
from wardline.session import build_session  # noqa: E402

HEADLINE = [
    "gate_summary", "detect_secrets", "evasion_views", "hot_windows", "duplicate_blocks", "shared_with", "churn", "collapse_candidates",
    "collision_map", "sequential_admission", "retention", "traffic_days", "session_weight", "scope_violations", "dataset_digest",
    "verdict", "sarif_documents", "summary_plan", "upsert_savepoints", "sanitize_markdown", "summary_markdown", "stream_gate", "stream_retention",
    "policy_state", "glob_table", "denied_terms",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8, app="wardline-bench")
    spark.sparkContext.setLogLevel("ERROR")
    registry, tables = load_all(), Tables(spark, folder)
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        runs = []
        for _ in range(repeats + 1):
            start = time.perf_counter()
            registry[name].run(tables).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "median seconds, sum over headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cores": cores, "repeats": repeats,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
