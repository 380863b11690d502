"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed with a ``noop`` write (the full plan runs, nothing is
gathered on the driver); one warm-up run, then the median of three timed runs.
Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tickwise.plans.registry import QUERIES, load_all  # noqa: E402
from tickwise.session import get_session  # noqa: E402

HEADLINE = [
    "p6_naive_mape",          # flagship: bars + index -> scale -> windows -> forecasts -> MAPE
    "f_daily_features",       # scored news -> daily features (ranked decay sum)
    "t5_window_news",         # calendar range join of news into bar windows
    "w4_concat_features",     # 40-step x 11-feature training windows
    "p10_backtest",           # rolling-origin backtest
    "n5_parse_scores",        # scorer responses -> typed scores
    "a2_page_body",           # html -> article text
    "a_clean_text",           # noise blocks / lines / collapse over whole texts
    "l10_dedup_across_sources",
    "d5_fuzzy_dedup",         # fuzzy title dedup (blocks by length + LCS + greedy rounds)
]


def run(spark, name, sf_dir):
    t0 = time.perf_counter()  # building may run eager steps (checkpointed rounds), so it is timed too
    df = QUERIES[name](spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    spark = get_session(cores=cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    load_all()
    times = {}
    for name in HEADLINE:
        run(spark, name, sf_dir)  # warm-up
        times[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(reps)), 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "reps": reps,
    }))


if __name__ == "__main__":
    main()
