"""Time the headline queries on one machine; prints one line of JSON.

BENCH_SF_DIR   folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS     cores (default 8)
BENCH_QUERIES  comma-separated names instead of the headline list, or "all"
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trawlspark.plans.queries import registered  # noqa: E402
from trawlspark.session import local_session  # noqa: E402

HEADLINE = [
    "url_canonical",
    "url_duplicates",
    "url_resolve",
    "filter_first_match",
    "config_test",
    "robots_allow",
    "robots_rules",
    "links_html",
    "link_targets",
    "doc_links",
    "page_degree",
    "frontier_decisions",
    "decision_counts",
    "crawl_levels",
    "crawl_budget",
    "crawl_chain",
    "fetch_counters",
    "media_counters",
    "job_summary",
    "fetch_log_running",
    "job_outcome",
    "politeness_gap",
    "jobs_latest",
    "document_tables",
    "journal_log",
    "outcome_stream",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES")
    queries = registered()
    names = HEADLINE if not wanted else list(queries) if wanted == "all" else wanted.split(",")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(os.path.normpath(sf)).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
