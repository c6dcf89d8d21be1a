"""Wall time of the headline queries, one JSON line.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]. Every
query runs to the end into a sink that keeps nothing; the best of two runs
counts, after one warm-up query.
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from harrow.session import local_session  # noqa: E402
from registry import QUERIES  # noqa: E402

HEADLINE = (
    "catalog_search",
    "catalog_search_wildcards",
    "sorted_by_country_top",
    "practice_cards",
    "programs_with_documents",
    "order_lines",
    "nested_export",
    "deadline_calendar",
    "fill_profile",
    "crawl_metrics",
    "canonical_urls",
    "clean_html",
    "iso_dates",
    "funding_amounts",
    "primary_keys",
    "check_eligibility",
    "classify_applicants",
    "route_alerts",
    "open_latest",
    "opportunities",
    "import_territory_rows",
    "validate_spec",
    "cascade_lines",
    "keep_latest",
    "diff_history",
    "rolling_failure_rate",
    "link_documents",
    "contained_passages",
    "similar_titles_by_host",
    "search_words",
    "search_index",
    "navigation_links",
    "survive_by_precedence",
    "title_clusters",
    "merge_sources",
    "stream_daily_counts",
)


def seconds(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = local_session(cpus, "bench", tempfile.mkdtemp(prefix="run-harrow-"))
    spark.sparkContext.setLogLevel("ERROR")
    seconds(spark, "stats_by_lang", folder)
    times = {n: round(min(seconds(spark, n, folder) for _ in range(2)), 3) for n in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
