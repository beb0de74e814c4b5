"""Queries on the article table: look-up, filters, search and newest-first pages."""

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedlake.functions import dates, text
from feedlake.schema import CREATED_DATE
from feedlake.sources.store import Store

# Paging defaults, the span of recent days and the messages.
DEFAULT_PAGE = 1
DEFAULT_LIMIT = 20
MAX_DAYS = 365
NOT_FOUND = "Article not found"
BAD_DAYS = "Days must be between 1 and 365"

# Ids per span that is counted to find a page: one row per span passes through one task.
SPAN_BITS = 16


@dataclass(frozen=True)
class Page:
    """Rows of one page, newest first, and one row (page, limit, total, pages)."""

    rows: DataFrame
    pagination: DataFrame
    info: dict = field(default_factory=dict)


def find_article(articles: DataFrame, article_id: int) -> DataFrame:
    return articles.filter(F.col("id") == article_id).limit(1)


def article_by_id(articles: DataFrame, article_id: int):
    """The row with this id; LookupError when there is none."""
    row = find_article(articles, article_id).first()
    if row is None:
        raise LookupError(NOT_FOUND)
    return row


def by_source(articles: DataFrame, source: str | None) -> DataFrame:
    """Articles of one source; an empty name filters nothing."""
    return articles.filter(F.col("source") == source) if source else articles


def search_title(articles: DataFrame, search: str | None) -> DataFrame:
    """Articles whose title contains the text; an empty text filters nothing."""
    return articles.filter(text.contains_pattern(F.col("title"), search)) if search else articles


def _created(articles: DataFrame, start: dt.date, end: dt.date | None = None) -> DataFrame:
    """Articles created from start on, before end, in the session time zone.

    A stored table is also cut by its day partitions, which Spark does not derive
    from the time range by itself. Those are UTC days.
    """
    created = articles.schema["createdAt"].dataType
    spark = articles.sparkSession
    kept = articles.filter(F.col("createdAt") >= dates.day_start(start, created))
    if end is not None:
        kept = kept.filter(F.col("createdAt") < dates.day_start(end, created))
    if CREATED_DATE in articles.columns:
        midnight = dt.datetime.combine(start, dt.time())
        kept = kept.filter(F.col(CREATED_DATE) >= F.lit(dates.in_utc(spark, midnight).date()))
        if end is not None:
            last = dt.datetime.combine(end, dt.time()) - dt.timedelta(microseconds=1)
            kept = kept.filter(F.col(CREATED_DATE) <= F.lit(dates.in_utc(spark, last).date()))
    return kept


def created_on(articles: DataFrame, day: str) -> DataFrame:
    """Articles of one yyyy-MM-dd day, in the session time zone."""
    start = dates.parse_day(day)
    return _created(articles, start, start + dt.timedelta(days=1))


def first_recent_day(days: int, as_of: dt.datetime) -> dt.date:
    if not 1 <= days <= MAX_DAYS:
        raise ValueError(BAD_DAYS)
    return as_of.date() - dt.timedelta(days=days)


def created_recently(articles: DataFrame, days: int, as_of: dt.datetime) -> DataFrame:
    """Articles of the last full days and of the day of as_of so far, no upper bound."""
    as_of = dates.session_time(articles.sparkSession, as_of)
    return _created(articles, first_recent_day(days, as_of))


def created_today(articles: DataFrame, as_of: dt.datetime) -> DataFrame:
    as_of = dates.session_time(articles.sparkSession, as_of)
    return _created(articles, as_of.date(), as_of.date() + dt.timedelta(days=1))


def _check_paging(page: int, limit: int) -> None:
    if page < 1 or limit < 1:
        raise ValueError("page and limit must be at least 1")


def pagination(articles: DataFrame, page: int = DEFAULT_PAGE, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Totals of the unpaged rows: page, limit, total, pages."""
    _check_paging(page, limit)
    total = F.count("*")
    return articles.agg(
        F.lit(page).alias("page"),
        F.lit(limit).alias("limit"),
        total.alias("total"),
        F.ceil(total / F.lit(limit)).cast("long").alias("pages"),
    )


@dataclass(frozen=True)
class _Span:
    """Ids that hold a page, how many rows above them to skip, and the number of all rows."""

    low: int | None
    high: int | None
    skip: int
    total: int


def counts_per_span(articles: DataFrame) -> DataFrame:
    """(span, n): how many rows have ids in each span of 2^SPAN_BITS."""
    span = F.shiftright("id", SPAN_BITS).alias("span")
    return articles.groupBy(span).agg(F.count("*").alias("n"))


def _find_page(articles: DataFrame, offset: int, limit: int) -> _Span:
    """Where a page lies, from one pass that counts the rows of each span of ids."""
    counts = counts_per_span(articles)
    newer = W.orderBy(F.desc("span")).rowsBetween(W.unboundedPreceding, -1)
    placed = counts.withColumn("before", F.coalesce(F.sum("n").over(newer), F.lit(0)))
    holds = (F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)
    low, high, before, total = placed.agg(
        F.min(F.when(holds, F.col("span"))),
        F.max(F.when(holds, F.col("span"))),
        F.min(F.when(holds, F.col("before"))),
        F.coalesce(F.sum("n"), F.lit(0)),
    ).first()
    if low is None:
        return _Span(None, None, 0, total)
    return _Span(low << SPAN_BITS, (high + 1 << SPAN_BITS) - 1, offset - before, total)


def _rows_at(articles: DataFrame, at: _Span, limit: int) -> DataFrame:
    if at.low is None:
        return articles.limit(0)
    held = articles.filter(F.col("id").between(at.low, at.high))
    return held.orderBy(F.desc("id")).offset(at.skip).limit(limit)


def page_rows(articles: DataFrame, page: int = DEFAULT_PAGE, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """One page by descending id; ids must be unique.

    Shallow or deep, a page is found by counting: one pass over the rows the filters
    leave counts them per span of 65,536 ids, the running sum names the spans that hold
    the page, and only those are read again, through bounds that reach the scan. The
    count runs when the page is asked for, so later appends do not move the page.
    """
    _check_paging(page, limit)
    return _rows_at(articles, _find_page(articles, (page - 1) * limit, limit), limit)


def keyset_page(articles: DataFrame, last_id: int | None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The page after last_id in descending order; no offset to skip over, nothing to count."""
    _check_paging(1, limit)
    older = articles if last_id is None else articles.filter(F.col("id") < last_id)
    return older.orderBy(F.desc("id")).limit(limit)


def _page(articles: DataFrame, page: int, limit: int, **info) -> Page:
    """A page and its totals, from the same counts."""
    _check_paging(page, limit)
    at = _find_page(articles, (page - 1) * limit, limit)
    totals = articles.sparkSession.range(1).select(
        F.lit(page).alias("page"),
        F.lit(limit).alias("limit"),
        F.lit(at.total).cast("long").alias("total"),
        F.lit(-(-at.total // limit)).cast("long").alias("pages"),
    )
    return Page(_rows_at(articles, at, limit), totals, info)


def list_articles(
    articles: DataFrame,
    page: int = DEFAULT_PAGE,
    limit: int = DEFAULT_LIMIT,
    source: str | None = None,
    search: str | None = None,
) -> Page:
    return _page(search_title(by_source(articles, source), search), page, limit)


def articles_by_source(
    articles: DataFrame, source: str, page: int = DEFAULT_PAGE, limit: int = DEFAULT_LIMIT
) -> Page:
    return _page(articles.filter(F.col("source") == source), page, limit)


def articles_by_date(
    articles: DataFrame, day: str, page: int = DEFAULT_PAGE, limit: int = DEFAULT_LIMIT
) -> Page:
    return _page(created_on(articles, day), page, limit, date=day)


def recent_articles(
    articles: DataFrame,
    days: int,
    as_of: dt.datetime | None = None,
    page: int = DEFAULT_PAGE,
    limit: int = DEFAULT_LIMIT,
) -> Page:
    spark = articles.sparkSession
    as_of = dates.session_time(spark, as_of)
    midnight = dt.datetime.combine(first_recent_day(days, as_of), dt.time())
    return _page(
        created_recently(articles, days, as_of),
        page,
        limit,
        days=days,
        fromDate=dates.utc_text(spark, midnight),
    )


def stored_page(
    spark: SparkSession,
    store: Store,
    page: int = DEFAULT_PAGE,
    limit: int = DEFAULT_LIMIT,
    source: str | None = None,
) -> Page:
    """A page of all stored articles, or of one source, found by the counts kept with the store.

    Nothing is counted and no article file is opened but those of the spans that hold the page, at most
    as many as the page has rows.
    """
    _check_paging(page, limit)
    offset = (page - 1) * limit
    spans = store.spans(spark, source).filter("n > 0")
    # One row per file goes through one task.
    newer = W.orderBy(F.desc("first_id")).rowsBetween(W.unboundedPreceding, -1)
    placed = spans.withColumn("before", F.coalesce(F.sum("n").over(newer), F.lit(0)))
    holds = (F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)
    total, held = placed.agg(
        F.coalesce(F.sum("n"), F.lit(0)),
        F.collect_list(F.when(holds, F.struct("before", "batch", "span"))),
    ).first()
    rows = by_source(store.articles_in(spark, [(h["batch"], h["span"]) for h in held]), source)
    skip = offset - min((h["before"] for h in held), default=offset)
    totals = spark.range(1).select(
        F.lit(page).alias("page"),
        F.lit(limit).alias("limit"),
        F.lit(total).cast("long").alias("total"),
        F.lit(-(-total // limit)).cast("long").alias("pages"),
    )
    return Page(rows.orderBy(F.desc("id")).offset(skip).limit(limit), totals)


def stored_article(spark: SparkSession, store: Store, article_id: int):
    """The stored row with this id, from the one file that holds it; LookupError when there is none."""
    row = store.article(spark, article_id).first()
    if row is None:
        raise LookupError(NOT_FOUND)
    return row
