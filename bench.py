"""Times the registered queries and prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (comma separated) choose data, cores and
queries; every query is run in full and every output row is produced. The total is that of
the headline queries; the streams are timed beside them. The session is the library's own,
with as many shuffle partitions as cores.
"""

from __future__ import annotations

import json
import os
import time

from barledger.session import build_session
from barledger.plans.queries import QUERIES

HEADLINE = (
    "ab_final_equity", "bars_15m", "bars_1d", "rollup_2h", "rollup_1w", "rebuild_complete",
    "window_summary", "integrity_audit", "gap_totals", "parity_summary", "patched_bars",
    "coverage_audit", "overall_gate", "event_violations", "campaign_states_a", "ab_trace",
    "ab_trace_users", "asof_states", "next_open_ledger", "exec_ledger", "paired_close",
    "segments_exec", "cost_stress", "perf_summary", "information_floor", "campaign_summary",
    "risk_allocation", "seed_root", "artifact_profile", "journal_verify",
)
STREAMS = ("stream_ab_trace", "stream_bars_15m", "stream_ledger")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else (*HEADLINE, *STREAMS)
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["bars_15m"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # JVM warm-up
    timings = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(t for n, t in timings.items() if chosen or n in HEADLINE), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
