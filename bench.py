"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the cores.
Each query runs once to warm up and then BENCH_RUNS times; the median counts. Every
row is produced and dropped, nothing is collected.
"""

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from feedlake.plans.driver_queries import QUERIES

HEADLINE = [
    "content_hash",
    "strip_html",
    "article_projection",
    "parse_pubdate",
    "dedup_first_wins",
    "new_vs_history",
    "assign_ids",
    "new_articles_by_source",
    "sources_ranked",
    "count_by_source",
    "article_stats",
    "articles_page",
    "articles_page_deep",
    "articles_by_source_page",
    "articles_by_date",
    "articles_recent",
    "search_title",
    "pagination_totals",
    "freshness_report",
    "parse_access_log",
    "request_durations",
    "feed_file_ingest",
    "feed_stream_ingest",
]
# Whole ingest runs land, read and write files, so they run once after warming up.
ONCE = {"feed_file_ingest", "feed_stream_ingest"}


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("feedlake-bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="feedlake-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(spark, sf_dir, name) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def shuffled_bytes(spark) -> int:
    """Shuffle bytes written so far, as the status page counts them."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = session(cpus)
    seconds, shuffled = {}, {}
    for name in names:
        before = shuffled_bytes(spark)
        timed(spark, sf_dir, name)
        shuffled[name] = shuffled_bytes(spark) - before
        times = [timed(spark, sf_dir, name) for _ in range(1 if name in ONCE else runs)]
        seconds[name] = round(statistics.median(times), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of median query seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "shuffle_write_bytes": shuffled,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
