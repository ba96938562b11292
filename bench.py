"""Headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from tracewarden import build_session
from tracewarden.plans.catalog import CATALOG

HEADLINE = [
    "apply_rules", "classify", "evaluate_mcp", "taint_leaks", "tool_risk", "agent_activity", "category_counts",
    "counterparty_risk", "action_histogram", "window_metrics", "rate_spikes", "novel_peers", "suppress_repeats",
    "task_transitions", "peer_risk", "apply_quarantine", "resolve_policy", "extract_fields", "chain_ledger", "verify_chain",
    "merkle_root", "query_events",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", master=f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus})
    spark.sparkContext.setLogLevel("ERROR")
    CATALOG["event_counters"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the executors
    times: dict[str, float] = {}
    for name in names:
        begin = time.perf_counter()
        CATALOG[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_wall_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
