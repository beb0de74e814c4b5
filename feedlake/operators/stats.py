"""Counts over the article table and the ingest runs."""

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions import dates
from feedlake.schema import CREATED_DATE


def total_articles(articles: DataFrame) -> DataFrame:
    return articles.agg(F.count("*").alias("total"))


def count_by_source(articles: DataFrame) -> DataFrame:
    return articles.groupBy("source").agg(F.count("*").alias("count"))


def sources_ranked(articles: DataFrame) -> DataFrame:
    """Sources by falling count; equal counts in order of their first article."""
    return (
        articles.groupBy("source")
        .agg(F.count("*").alias("count"), F.min("id").alias("first_id"))
        .orderBy(F.desc("count"), F.asc("first_id"))
        .select("source", "count")
    )


def is_today(articles: DataFrame, as_of: dt.datetime) -> Column:
    created = articles.schema["createdAt"].dataType
    today = dates.session_time(articles.sparkSession, as_of).date()
    return (F.col("createdAt") >= dates.day_start(today, created)) & (
        F.col("createdAt") < dates.day_start(today + dt.timedelta(days=1), created)
    )


def _per_source(articles: DataFrame, as_of: dt.datetime) -> DataFrame:
    return articles.groupBy("source").agg(
        F.count("*").alias("total"), F.count_if(is_today(articles, as_of)).alias("today")
    )


def article_stats(articles: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Rows (source, total, today); the row with source NULL covers all sources.

    One scan counts per source, and only those few rows are rolled up, so all
    numbers come from the same snapshot.
    """
    return (
        _per_source(articles, as_of)
        .rollup("source")
        .agg(F.sum("total").alias("total"), F.sum("today").alias("today"))
    )


# A map is one value of one row, so it is for source lists up to this size only.
MAX_MAP_SOURCES = 10_000


def as_map(counts: DataFrame, value: str = "count") -> DataFrame:
    """One row (bySource, withoutSource) of one row per source, for source lists that fit a row.

    A map takes no NULL key, so rows without a source are counted beside it. More sources
    than MAX_MAP_SOURCES raise; the row forms have no such limit and are the ones to use at size.
    """
    without = F.col("source").isNull()
    # No more rows than are allowed come together, and one that tells there are more.
    some = counts.limit(MAX_MAP_SOURCES + 2)
    named = F.collect_list(F.when(~without, F.struct("source", value)))
    refused = F.raise_error(F.lit(f"more than {MAX_MAP_SOURCES} sources do not go into a map; use the rows"))
    too_many = F.when(F.count("source") > MAX_MAP_SOURCES, refused.cast("map<string,bigint>"))
    return some.agg(
        too_many.otherwise(F.map_from_entries(named)).alias("bySource"),
        F.coalesce(F.sum(F.when(without, F.col(value))), F.lit(0)).alias("withoutSource"),
    )


def article_stats_record(articles: DataFrame, as_of: dt.datetime) -> DataFrame:
    """The same numbers as one row (total, today, bySource, withoutSource)."""
    per_source = _per_source(articles, as_of)
    totals = per_source.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("today"), F.lit(0)).alias("today"),
    )
    return totals.crossJoin(F.broadcast(as_map(per_source, "total")))


def last_run(runs: DataFrame) -> DataFrame:
    return runs.agg(F.max("started_at").alias("lastRun"))


def ingest_stats_rows(articles: DataFrame, runs: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Rows (source, articles, totalArticles, lastRun, nextRun), one per source; articles without
    a source have a row of their own. No articles, no rows."""
    counts = count_by_source(articles).withColumnRenamed("count", "articles")
    total = counts.agg(F.sum("articles").alias("totalArticles"))
    return counts.crossJoin(F.broadcast(total)).select(
        "*",
        last_run(runs).scalar().alias("lastRun"),
        dates.next_hour(dates.time_literal(as_of)).alias("nextRun"),
    )


def ingest_stats(articles: DataFrame, runs: DataFrame, as_of: dt.datetime) -> DataFrame:
    """The same as one row: totalArticles, articlesBySource, withoutSource, lastRun, nextRun."""
    counts = count_by_source(articles)
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("totalArticles"))
    return total.crossJoin(F.broadcast(as_map(counts))).select(
        "totalArticles",
        F.col("bySource").alias("articlesBySource"),
        "withoutSource",
        last_run(runs).scalar().alias("lastRun"),
        dates.next_hour(dates.time_literal(as_of)).alias("nextRun"),
    )


# --- from the counts kept with the store: no article file is read -------------


def stored_total(counts: DataFrame) -> DataFrame:
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def stored_by_source(counts: DataFrame) -> DataFrame:
    """Rows (source, count), most first; equal counts in order of their first article."""
    return (
        counts.groupBy("source")
        .agg(F.sum("n").alias("count"), F.min("first_id").alias("first_id"))
        .orderBy(F.desc("count"), F.asc("first_id"))
        .select("source", "count")
    )


def stored_by_day(counts: DataFrame) -> DataFrame:
    """Rows (day, count) by UTC day of ingest."""
    return counts.groupBy(F.col(CREATED_DATE).alias("day")).agg(F.sum("n").alias("count"))


def stored_stats(counts: DataFrame, day: dt.date) -> DataFrame:
    """Rows (source, total, today): all articles and those of one UTC day, per source."""
    today = F.when(F.col(CREATED_DATE) == F.lit(day), F.col("n")).otherwise(0)
    return counts.groupBy("source").agg(F.sum("n").alias("total"), F.sum(today).alias("today"))
