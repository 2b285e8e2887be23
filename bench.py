"""Benchmark: run the headline queries on $BENCH_SF_DIR and print one JSON line.

Each query is executed in full with the ``noop`` sink (every row computed, nothing
collected to the driver).  Usage: ``python bench.py [--all]``.
"""

from __future__ import annotations

import json
import os
import sys
import time

from meshlens.plans import catalog
from meshlens.session import get_spark

HEADLINE = (
    "v04_hybrid_search",     # flagship: keyword + vector + rank fusion
    "v01_keyword_search",
    "v02_vector_search",
    "j02_symbol_edges",      # edge build (self-join of lineitem) + neighbour names
    "j07_unused_symbols",
    "a02_repository_stats",
    "a14_module_stats",
    "a17_module_hash",
    "s04_snapshot_diff",
    "e02_extract_http_calls",
    "e08_doc_sections",
    "x27_flatten_json",
    "e06_extract_config",
    "dq03_scan_secrets",
    "dq08_exact_duplicates",
    "v06_chunk_words",
    "j12_link_calls_to_endpoints",
    "j15_link_events",
    "g01_traverse",
    "g07_cycles_3",
    "p11_pattern_report",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    run_all = "--all" in sys.argv
    spark = get_spark()
    qs = catalog.queries()
    names = list(qs) if run_all else [n for n in HEADLINE if n in qs]
    # warm-up: JVM class loading and parquet footer caches, not timed
    qs[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.perf_counter()
        qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_headline_query_time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
