"""Headline queries on one machine; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from storyledger.catalog.queries import QUERIES
from storyledger.session import build_session

HEADLINE = (
    "canonical_pages",
    "dedup_within_pull",
    "insert_if_absent",
    "published_confidence",
    "wire_detect",
    "claim_types",
    "independent_sources",
    "primary_links",
    "source_health",
    "feed_all",
    "throttle_history",
    "resolve_errors",
    "audit_run",
    "harvest_links",
    "rss_items",
    "lead_image",
    "page_signals",
    "article_text",
    "build_documents",
    "stream_ingest",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    wanted = os.environ.get("BENCH_QUERIES")
    seconds = {}
    for name in wanted.split(",") if wanted else HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
