"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the scale folder, ``BENCH_CPUS`` the number of cores. Every query
computes all its rows and columns into Spark's noop sink.
"""

from __future__ import annotations

import json
import os
import time

from pagelake.plans import catalog
from pagelake.session import local_session

HEADLINES = [
    "host_frontier",
    "frontier_requests",
    "extract_links",
    "remove_entities",
    "listing_requests",
    "extract_detail",
    "url_parts",
    "file_name",
    "dedup_requests",
    "enqueue",
    "order_priority",
    "next_batch",
    "politeness_slots",
    "crawl_reach",
    "candidate_urls",
    "first_success",
    "attempts",
    "fetch_plan",
    "classify_fetch",
    "attach_cover",
    "staged_records",
    "insert_unique",
    "write_book_detail_sharded",
    "blob_round_trip",
    "archive_round_trip",
    "inverted_index_lookup",
    "inc",
    "fold_ops_mixed",
    "merge_spiders",
    "rollup",
    "metric_lines",
    "stats_stream",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "pagelake-bench")
    spark.sparkContext.setLogLevel("ERROR")
    known = catalog.queries()
    spark.read.parquet(f"{folder}/pages.parquet").count()
    seconds = {}
    for name in HEADLINES:
        started = time.perf_counter()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
