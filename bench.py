"""Headline benchmark: page report, keyword density, technology detection and the crawl.

Runs at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and prints one
JSON line. Each query is forced to completion with a no-op write (every row computed, nothing
collected on the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["page_report", "keyword_density", "technologies", "crawl_bfs", "link_counts", "robots_filter"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from pagelens.catalog import QUERIES
    from pagelens.session import local_session

    spark = local_session(cpus)
    # untimed warm-up: one pass of every headline query on the smallest data set, so JVM start-up
    # and JIT compilation are not charged to the first timed query
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm_dir):
        for name in HEADLINE:
            QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        t = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    pages = spark.read.parquet(os.path.join(sf_dir, "pages.parquet")).count()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf,
        "pages_per_sec_report": round(pages / times["page_report"], 1) if times["page_report"] else None,
        "warmup": "one untimed pass at sf0.001",
    }))


if __name__ == "__main__":
    main()
