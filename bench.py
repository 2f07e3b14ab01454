"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

Each query is run once to warm up and then three times into the ``noop`` sink
(every row is computed, none is kept); the median counts. ``BENCH_QUERIES``
(comma-separated names, or ``all``) picks others.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = [
    # read, map, payload
    "scan_full", "incremental_delta_pushed", "watermark_next", "map_contacts", "activate_orders",
    "preset_trim", "preset_to_number", "preset_parse_date", "preset_to_string", "profile_table",
    # select
    "select_scoring", "select_rule", "selection_summary", "score_fill_missing", "score_batches", "row_index", "prompt_batches",
    # replies and suggestions
    "reply_parse_scores", "reply_parse_plan", "reply_classify", "suggest_validate", "suggest_by_name",
    # write
    "upsert_split_record", "upsert_collapse", "payload_record", "payload_batches", "upsert_counts",
    # history and schedule
    "runs_recent", "runs_daily", "runs_with_name", "late_runs", "run_reports", "spec_integrity",
    "schedule_skip_forward", "upcoming_runs", "upcoming_calendar",
    # whole runs
    "run_sync_files", "run_agent_files", "stream_upsert", "stream_late_versions", "deliver_records", "deliver_lists_partial",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

    from rowferry.queries import QUERIES
    from rowferry.session import local_session

    chosen = os.environ.get("BENCH_QUERIES")
    names = sorted(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    seconds = {}
    for name in names:
        times = []
        for _ in range(4):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 4)
    spark.stop()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "sum of median seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
