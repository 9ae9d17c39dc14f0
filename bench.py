"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default all)
choose the tables and cores; ``BENCH_ALL=1`` runs every registered query.  The
packet tables are numbered and written once, reported as ``ingest``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "packet_copy_verdict", "packet_copy_inferred", "frame_timeline_compare", "clock_rescale_join", "timeline_match", "monotonic_audit", "running_clock",
    "keyframe_pairs", "slice_alignment", "window_bytes", "band_match_unique", "track_fingerprint", "score_pool", "candidate_eligibility", "choose_candidate",
    "size_forecast", "latest_attempt", "outcome_counts", "history_anti", "stage_time_report", "owner_reachability", "inventory_classify", "yield_states",
    "cpu_yield", "content_dedup",
)


def main() -> None:
    from framesleuth.plans import tables
    from framesleuth.plans.catalog import queries
    from framesleuth.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": str(cores), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    registered = queries()
    names = list(registered) if os.environ.get("BENCH_ALL") else HEADLINE
    start = time.time()
    tables.packets(spark, folder)
    tables.damaged_packets(spark, folder)
    tables.samples(spark, folder)
    ingest = time.time() - start
    times = {}
    for name in names:
        runs = []
        for _ in range(int(os.environ.get("BENCH_RUNS", "1"))):
            start = time.time()
            registered[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        times[name] = round(sorted(runs)[len(runs) // 2], 3)
    print(json.dumps({
        "metric": "headline query time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "ingest": round(ingest, 3),
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
