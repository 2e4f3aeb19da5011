"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is executed in full (noop sink: every row is produced, none is kept).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "T01_priority_queue", "D01_dedup_findings", "J01_route_auth", "J02_second_order", "J03_affected_versions", "J09_neighbours", "J19_implicit_edges",
    "J25_memory_tiers", "E03_stuck_detection", "E09_down_sampling", "E12_call_stacks", "F01_F24_full_scan", "F26_all_families", "F27_secrets",
    "S05_cvss31", "S06_attack_surface", "D20_response_differential", "B02_price_mismatch", "B10_overdrawn", "W01_sarif_shards",
]


def main() -> None:
    from vulnlake import build_session
    from vulnlake.plans.catalog import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("T01_priority_queue")  # start-up and code generation of the first job are not measured
    took = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        run(name)
        took[name] = round(time.perf_counter() - start, 3)
    found = re.search(r"sf([0-9.]+)/?$", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": float(found.group(1)) if found else None}))
    spark.stop()


if __name__ == "__main__":
    main()
