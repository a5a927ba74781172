"""Headline queries on one node: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, default: the list below).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark import plans, session

HEADLINE = [
    "flagship_top10_vs_base", "w6_volatility20", "w16_spread_ar", "w19_squeeze_danger", "w17_consensus_rank", "f1_board_filters",
    "o1_board_sort", "j1_record_merge", "j5_asof_bar", "j7_borrow_asof", "j12_lookalikes", "x7_plan_basket", "a8_auc", "a11_rank_band_record",
    "a12_event_study", "a18_timing_table", "a33_survivorship_gap", "a25_event_counts", "t1_live_tape", "l3_prob_cap",
]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = session.build("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.log.level": "ERROR"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = plans.load()
    queries[names[0]](spark, d).write.format("noop").mode("overwrite").save()      # warm the JVM once
    times = {}
    for n in names:
        t = time.perf_counter()
        queries[n](spark, d).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "headline queries, total wall-clock", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
