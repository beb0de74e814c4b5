"""One ingest run: items in, new articles appended, run rows written."""

import datetime as dt
import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.functions import dates
from feedlake.operators import dedup, items as item_ops, positions
from feedlake.schema import CREATED_DATE, RUN
from feedlake.sources import feeds
from feedlake.sources.batches import Manifest
from feedlake.sources.hash_index import HashIndex
from feedlake.sources.registry import (
    check_source,
    feed_registry,
    with_registry,
)
from feedlake.sources.store import BYTES, SPAN, STORED_ARTICLE, Store
from feedlake.staging import broadcast_if_small, run_folder, stage

# States and wording of run rows.
SCHEDULED = "scheduled"
COMPLETED = "completed"
EMPTY = "empty"
FAILED = "failed"
ALL_SOURCES = "all"
NO_ITEMS = "No valid feed items found"
SCRAPE_FAILED = "Failed to scrape"
UNREGISTERED = "unregistered"
NOT_REGISTERED = "Not in the registry"


# Files that could not be read.
FAILED_FILES = "source string, error string"
# Column that tells staged rows apart, whatever order they come with.
ROW = "_staged_row"


def run_record(
    spark: SparkSession,
    source: str | None = None,
    started_at: dt.datetime | None = None,
    registry: DataFrame | None = None,
    status: str = SCHEDULED,
    message: str | None = None,
) -> DataFrame:
    """One run row for one source, or for all; rejects names the registry lacks."""
    check_source(source, feed_registry(spark) if registry is None else registry)
    started = dates.time_literal(dates.session_time(spark, started_at))
    if message is None:
        message = f"Scraping scheduled for {source or 'all sources'}"
    no_count = F.lit(None).cast("long")
    return spark.range(1).select(
        dates.run_id(started).alias("run_id"),
        F.lit(status).alias("status"),
        F.lit(source or ALL_SOURCES).alias("source"),
        started.alias("started_at"),
        no_count.alias("items"),
        no_count.alias("malformed"),
        no_count.alias("unparsed_dates"),
        no_count.alias("invalid"),
        no_count.alias("new_articles"),
        F.lit(message).alias("message"),
    )


def text_bytes(*columns: str) -> Column:
    """About how many bytes a row takes in the store."""
    sizes = [F.coalesce(F.octet_length(F.col(c)), F.lit(0)).cast("long") for c in columns]
    total = F.lit(100).cast("long")
    for size in sizes:
        total += size
    return total


def new_keys(firsts: DataFrame, index: HashIndex, order: list[str], last_id: int) -> tuple:
    """(numbered, count, bytes): those first of their hash that are not stored yet, with
    ids that run on from last_id.

    Works on hashes and places only; the texts stay where they are. The firsts are
    written, as they are counted and held against the index.
    """
    firsts = stage(firsts, "first-keys")
    keys = index.new_against(firsts, firsts.count())
    numbered = positions.assign_ids(keys, *order, last_id=last_id)
    count, size = numbered.agg(F.count("*"), F.coalesce(F.sum(BYTES), F.lit(0))).first()
    return numbered, count, size


def source_report(
    items: DataFrame,
    new: DataFrame,
    registry: DataFrame,
    with_empty: bool = True,
    failed: DataFrame | None = None,
) -> DataFrame:
    """Per source: items read, malformed parts, bad dates, items without title or link,
    new articles, what failed, and whether it is registered.

    Registered sources without any item appear only with_empty, or where a file failed. All
    counts come from one pass over the items and one over the new articles.
    """
    counts = ("items", "malformed", "unparsed_dates", "invalid")
    read = items.groupBy("source").agg(
        F.count_if(~F.col("malformed")).alias("items"),
        F.count_if("malformed").alias("malformed"),
        F.count_if(F.col("valid") & F.col("dateError")).alias("unparsed_dates"),
        F.count_if(~F.col("malformed") & ~F.col("valid")).alias("invalid"),
    )
    added = new.groupBy("source").agg(F.count("*").alias("new_articles"))
    known = registry.select("source", F.lit(True).alias("registered"))
    if failed is None:
        failed = items.sparkSession.createDataFrame([], FAILED_FILES)
    errors = failed.groupBy("source").agg(F.min("error").alias("error"))
    rows = known.join(read, "source", "full").join(added, "source", "left").join(errors, "source", "full")
    zero = F.lit(0).cast("long")
    out = rows.select(
        F.coalesce("source", F.lit("")).alias("source"),
        *[F.coalesce(c, zero).alias(c) for c in (*counts, "new_articles")],
        "error",
        F.coalesce("registered", F.lit(False)).alias("registered"),
    )
    if not with_empty:
        out = out.filter("items > 0 OR malformed > 0 OR error IS NOT NULL")
    return out


def _run_rows(report: DataFrame, started: dt.datetime) -> DataFrame:
    at = dates.time_literal(started)
    none = F.col("items") == 0
    lost = F.col("error").isNotNull()
    found = F.concat(
        F.lit("Found "), F.col("new_articles"), F.lit(" new articles from "), "source", F.lit(".")
    )
    return report.select(
        dates.run_id(at).alias("run_id"),
        F.when(~F.col("registered"), UNREGISTERED)
        .when(lost | (none & (F.col("malformed") > 0)), FAILED)
        .when(none, EMPTY)
        .otherwise(COMPLETED)
        .alias("status"),
        "source",
        at.alias("started_at"),
        "items",
        "malformed",
        "unparsed_dates",
        "invalid",
        "new_articles",
        F.when(~F.col("registered"), NOT_REGISTERED)
        .when(lost, F.concat(F.lit(f"{SCRAPE_FAILED}: "), "error"))
        .when(none, F.concat(F.lit(f"{NO_ITEMS} for "), "source"))
        .otherwise(found)
        .alias("message"),
    ).to(RUN)


def empty_rows(sources: DataFrame, started: dt.datetime) -> DataFrame:
    """Run rows of sources that had no items at all."""
    zero = F.lit(0).cast("long")
    counts = [
        zero.alias(c) for c in ("items", "malformed", "unparsed_dates", "invalid", "new_articles")
    ]
    error = F.lit(None).cast("string").alias("error")
    rows = sources.select("source", *counts, error, F.lit(True).alias("registered"))
    return _run_rows(rows, started)


def ingest_items(
    items: DataFrame,
    store: Store,
    registry: DataFrame,
    started_at: dt.datetime | None = None,
    empty_content: str = "collapse",
    report_empty: bool = True,
    failed: DataFrame | None = None,
    batch_key: str | None = None,
) -> DataFrame:
    """Append the new articles among items and return the run rows per source.

    Items carry source, fetch, file_name, malformed and an item_ord that is unique in
    the batch. They are written once, with their hash, because deduplication, the
    report and the projection all read them; these copies go when the run ends.
    failed holds (source, error) of files that could not be read; their sources are
    reported as failed. Items of sources that the registry lacks are
    not stored; each such source gets a run row with their number.

    Articles, quarantine, run rows, hashes and counts become visible together or not at all. A batch
    with a key counts once: what broke off is done again from the same store and
    gives the same ids and counters, and what is closed is not done again. Other batches
    never count an article twice, because stored hashes win.
    """
    spark = items.sparkSession
    started = dates.session_time(spark, started_at)
    run_id = ingest_batch(
        items, store, registry, started, empty_content, report_empty, failed, batch_key
    )
    return store.runs(spark).filter(
        (F.col("run_id") == run_id) & (F.col("source") != ALL_SOURCES)
    )


def ingest_batch(
    items: DataFrame,
    store: Store,
    registry: DataFrame,
    started: dt.datetime,
    empty_content: str = "collapse",
    report_empty: bool = True,
    failed: DataFrame | None = None,
    batch_key: str | None = None,
) -> str:
    """As ingest_items; returns the id of the run that the batch was closed in."""
    spark = items.sparkSession

    def id_of(moment: dt.datetime) -> str:
        return spark.range(1).select(dates.run_id(dates.time_literal(moment))).first()[0]

    run_id = id_of(started)
    begun = store.begin(spark, batch_key or f"{run_id}-{uuid.uuid4().hex}", started)
    if begun is None:
        closed = store.batches(spark).closed(batch_key)
        return id_of(dt.datetime.fromisoformat(closed.started_at))
    with run_folder(spark, "ingest"):
        _ingest(items, store, registry, run_id, started, empty_content, report_empty, failed, *begun)
    return run_id


def _ingest(
    items: DataFrame,
    store: Store,
    registry: DataFrame,
    run_id: str,
    started: dt.datetime,
    empty_content: str,
    report_empty: bool,
    failed: DataFrame | None,
    batch: Manifest,
    index: HashIndex,
) -> None:
    at = dates.time_literal(started)
    hashed = item_ops.with_content_hash(with_registry(items, registry, "left"), empty_content)
    landed = stage(
        dates.with_published(hashed).withColumns(
            {
                "valid": item_ops.is_valid_item() & ~F.col("malformed"),
                "fetch_ord": feeds.fetch_order(F.col("fetch")),
            }
        ),
        "items",
    )
    staged = landed.filter("source_ord IS NOT NULL")
    size = text_bytes("title", "link", "content", "summary", "description").alias(BYTES)
    keys = staged.filter("valid").select(dedup.HASH, "source", *feeds.POSITION, size)
    firsts = dedup.first_wins(keys, feeds.POSITION)
    # Ids rest on written tables, so neither the join nor the report sees the append.
    numbered, count, total = new_keys(firsts, index, feeds.POSITION, batch.first_id - 1)
    batch = replace(batch, last_id=batch.first_id - 1 + count)
    day = dates.utc_date(at).alias(CREATED_DATE)
    numbered = store.with_spans(numbered, batch, total).select("*", day)
    ids = broadcast_if_small(numbered.select("item_ord", "id", SPAN), dedup.BROADCAST_ROWS, count)
    articles = item_ops.article_projection(staged.join(ids, "item_ord"), "id", SPAN).select(
        "*", at.alias("createdAt"), day
    )
    report = stage(source_report(landed, numbered, registry, report_empty, failed), "report")
    rows = _run_rows(report, started)
    malformed = report.agg(F.sum("malformed")).first()[0]
    bad = feeds.malformed_items(staged).select(F.lit(run_id).alias("run_id"), "*") if malformed else None
    store.append(batch, index, articles, numbered, rows, bad)


def save_articles(
    rows: DataFrame, store: Store, *order: str, as_of: dt.datetime | None = None
) -> None:
    """Append ready article rows without ids, keeping a createdAt they already carry.

    Of rows with one content hash the first in the given order is kept, unless the
    hash is stored already. The order may tie and hold nulls, which come first; ties go
    by the place a row is staged at.
    """
    spark = rows.sparkSession
    given = F.col("createdAt") if "createdAt" in rows.columns else F.lit(None)
    created = dates.created_or(given, dates.session_time(spark, as_of))
    with run_folder(spark, "save"):
        placed = rows.withColumn("createdAt", created).withColumn(
            ROW, F.monotonically_increasing_id()
        )
        dated = stage(placed.withColumn(CREATED_DATE, dates.utc_date(F.col("createdAt"))), "rows")
        place = [*order, ROW]
        size = text_bytes(*[c for c in ("title", "url", "description") if c in rows.columns])
        keys = dated.select(dedup.HASH, "source", CREATED_DATE, *place, size.alias(BYTES))
        firsts = dedup.first_wins(keys, place)
        begun = store.begin(spark, f"save-{uuid.uuid4().hex}", dates.session_time(spark, as_of))
        batch, index = begun
        numbered, count, total = new_keys(firsts, index, place, batch.first_id - 1)
        batch = replace(batch, last_id=batch.first_id - 1 + count)
        numbered = store.with_spans(numbered, batch, total)
        ids = broadcast_if_small(numbered.select(ROW, "id", SPAN), dedup.BROADCAST_ROWS, count)
        wanted = dated.join(ids, ROW)
        columns = [f.name for f in STORED_ARTICLE.fields if f.name in wanted.columns]
        no_runs = spark.createDataFrame([], RUN)
        store.append(batch, index, wanted.select(*columns, SPAN), numbered, no_runs)


def run_ingest(
    spark: SparkSession,
    landing: str,
    store: Store,
    source: str | None = None,
    registry: DataFrame | None = None,
    started_at: dt.datetime | None = None,
    empty_content: str = "collapse",
    row_tag: str = "item",
    charset: str = "UTF-8",
    fetch: str | None = None,
) -> DataFrame:
    """Ingest the landed files of one source, or of all, and return the run record.

    Without a fetch every landed file is read again; name one to read its files only,
    or let stream_ingest remember what it has read. The run is on record before it
    starts and after it ends. A file that cannot be read, or holds no feed, fails its own source
    alone, which still gets what its other files hold; a failure of the whole run is recorded and raised.
    """
    registry = feed_registry(spark) if registry is None else registry
    started = dates.session_time(spark, started_at)
    store.append_runs(run_record(spark, source, started, registry))
    asked = registry.filter(F.col("source") == source) if source else registry
    try:
        with run_folder(spark, "files"):
            checked = feeds.checked_files(feeds.landed_files(spark, landing, source, fetch), charset)
            failed = feeds.failed_files(checked)
            # Only what differs from most files is listed: broken ones, and Atom documents.
            bad, atom = feeds.set_apart(checked)
            items = feeds.read_feeds(spark, landing, source, row_tag, charset, fetch, without=bad, atom=atom)
            ingest_items(items, store, asked, started, empty_content, failed=failed)
    except Exception as e:
        message = f"{SCRAPE_FAILED}: {e}"
        store.append_runs(run_record(spark, source, started, registry, FAILED, message))
        raise
    done = f"Scraping completed for {source or 'all sources'}"
    record = run_record(spark, source, started, registry, COMPLETED, done)
    store.append_runs(record)
    return record
