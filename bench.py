"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is built and fully executed into Spark's ``noop`` sink (no driver collect); one warm-up
pass over all queries, then the median of $BENCH_RUNS timed passes (build + execute, checkpoints
included).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "event_summary",          # flagship: gap fill → events → summary
    "master_dataset",         # J1 J2 J5 P3-P5 P10 W1 P8
    "prepare_scaled",         # W1 P5 P6 P9 A3
    "coverage",               # A1 A2 P19
    "ranking_scores",         # J3 P13 S6 K1 W11
    "lookback_windows",       # A4 W6
    "encoder_decoder_windows",  # W8
    "monthly_window_grid",    # W7 A9
    "persistence_metrics",    # M2 J10 A5
    "hydro_metrics",          # A5
    "best_so_far",            # W10
    "lognse_boxplot",         # P18 A15
    "importance_pivot",       # S8 A16
    "attention_smoothed",     # A19 W12
]


def main() -> None:
    from hydroframe.session import local_session
    from hydroframe.plans.queries import REGISTRY

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(cores=cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "8")),
                          app="hydroframe-bench")
    times = {n: [] for n in names}
    # pass 0 warms the JVM (JIT, codegen caches) over all queries; passes 1..runs are timed
    for i in range(runs + 1):
        for name in names:
            t0 = time.perf_counter()
            REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                times[name].append(time.perf_counter() - t0)
    out = {n: round(statistics.median(t), 3) for n, t in times.items()}
    for n, v in out.items():
        print(f"{n}: {v}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(out.values()), 3), "unit": "sec",
                      "queries": out, "sf": sf, "cpus": cpus, "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
