"""Operational reports: is the table fresh, and what does each source hold."""

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.functions import dates
from feedlake.operators import stats
from feedlake.sources.registry import items_per_source

# Fixed value: the hourly schedule.
SCHEDULE = "0 * * * *"


def freshness_report(articles: DataFrame, runs: DataFrame, as_of: dt.datetime) -> DataFrame:
    """One row: articleCount, lastRun and nextRun as UTC text; lastRun NULL before any run."""
    now = dates.time_literal(as_of)
    return stats.total_articles(articles).select(
        dates.iso_text(now).alias("timestamp"),
        F.col("total").alias("articleCount"),
        dates.iso_text(stats.last_run(runs).scalar()).alias("lastRun"),
        dates.iso_text(dates.next_hour(now)).alias("nextRun"),
    )


def status_by_source(articles: DataFrame, registry: DataFrame) -> DataFrame:
    """Articles per registered source in reading order, 0 where there are none."""
    return (
        items_per_source(articles, registry)
        .withColumnRenamed("items", "articles")
        .orderBy("source_ord")
        .select("source", "articles")
    )


def scraping_status_rows(
    articles: DataFrame, runs: DataFrame, registry: DataFrame, as_of: dt.datetime
) -> DataFrame:
    """Rows (schedule, lastRun, nextRun, source_ord, source, articles): every registered source
    in reading order, and every other one that has articles, without a place."""
    counts = stats.count_by_source(articles).withColumnRenamed("count", "articles")
    names = registry.select("source", "source_ord")
    rows = names.join(counts, names["source"].eqNullSafe(counts["source"]), "full")
    return rows.select(
        F.lit(SCHEDULE).alias("schedule"),
        dates.iso_text(stats.last_run(runs).scalar()).alias("lastRun"),
        dates.iso_text(dates.next_hour(dates.time_literal(as_of))).alias("nextRun"),
        "source_ord",
        F.coalesce(names["source"], counts["source"]).alias("source"),
        F.coalesce("articles", F.lit(0).cast("long")).alias("articles"),
    ).orderBy(F.asc_nulls_last("source_ord"), "source")


def scraping_status(
    articles: DataFrame, runs: DataFrame, registry: DataFrame, as_of: dt.datetime
) -> DataFrame:
    """The same as one row, for feed lists that fit one: schedule, lastRun, nextRun, sources,
    totalArticles, articlesBySource, withoutSource."""
    # The registry goes into a row under the same bound as the counts.
    some = registry.limit(stats.MAX_MAP_SOURCES + 1)
    names = F.transform(
        F.array_sort(F.collect_list(F.struct("source_ord", "source"))), lambda e: e["source"]
    )
    refused = F.raise_error(F.lit(f"more than {stats.MAX_MAP_SOURCES} sources; use the rows"))
    names = F.when(F.count("*") > stats.MAX_MAP_SOURCES, refused.cast("array<string>")).otherwise(names)
    return stats.ingest_stats(articles, runs, as_of).select(
        F.lit(SCHEDULE).alias("schedule"),
        dates.iso_text(F.col("lastRun")).alias("lastRun"),
        dates.iso_text(F.col("nextRun")).alias("nextRun"),
        some.agg(names).scalar().alias("sources"),
        "totalArticles",
        "articlesBySource",
        "withoutSource",
    )
