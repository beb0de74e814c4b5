"""Incremental ingest: newly landed files only, deduplicated against the store."""

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedlake.functions import dates
from feedlake.plans import ingest
from feedlake.sources import feeds
from feedlake.sources.batches import read_text
from feedlake.sources.registry import feed_registry, sources_without_items
from feedlake.sources.store import Store
from feedlake.staging import run_folder


class Trigger:
    """A started stream run. awaitTermination ends it and puts it on record."""

    def __init__(self, spark, store: Store, registry: DataFrame, started: dt.datetime):
        self.spark, self.store, self.registry, self.started = spark, store, registry, started
        self.batches: list[str] = []
        self.query: StreamingQuery | None = None

    def awaitTermination(self) -> None:
        """Wait for all batches; then report the sources without items and the end of the run.

        A run without new files and a failed run leave their rows as well.
        """
        try:
            self.query.awaitTermination()
        except Exception as e:
            self._record(ingest.FAILED, f"{ingest.SCRAPE_FAILED}: {e}")
            raise
        runs = self.store.runs(self.spark).filter(F.col("run_id").isin(self.batches))
        # Each batch reported what it had items or failures of.
        seen = runs.filter(F.col("source") != ingest.ALL_SOURCES).select("source")
        self.store.append_runs(
            ingest.empty_rows(sources_without_items(seen, self.registry), self.started)
        )
        self._record(ingest.COMPLETED, "Scraping completed for all sources")

    def _record(self, status: str, message: str) -> None:
        self.store.append_runs(
            ingest.run_record(self.spark, None, self.started, self.registry, status, message)
        )


def stream_ingest(
    spark: SparkSession,
    landing: str,
    store: Store,
    checkpoint: str,
    registry: DataFrame | None = None,
    empty_content: str = "collapse",
    row_tag: str = "item",
    charset: str = "UTF-8",
    max_files_per_batch: int | None = None,
) -> Trigger:
    """Start a query that ingests all files landed since the last one, then stops.

    The store is the deduplication state, so it neither grows in the stream nor
    expires. The stream hands over files: each is checked by itself, and one that cannot be
    read is reported for its source and does not stop the others. A micro-batch has a key in the store,
    so one that is replayed after it was closed is left out, and one that broke off
    is done again and gives the same ids and counters. Each batch reports the sources it has
    items of; what is empty is known, and reported, at the end of the run.
    """
    registry = feed_registry(spark) if registry is None else registry
    files = feeds.stream_files(spark, landing, max_files_per_batch)
    trigger = Trigger(spark, store, registry, dates.session_time(spark))
    store.append_runs(ingest.run_record(spark, None, trigger.started, registry))

    def ingest_files(batch: DataFrame, number: int) -> None:
        # The query's own id: a new checkpoint in the same place is another query.
        query = json.loads(read_text(spark, f"{checkpoint}/metadata"))["id"]
        with run_folder(spark, "files"):
            checked = feeds.checked_files(batch, charset)
            # The files of one micro-batch, which its own log lists on the driver as well.
            good = checked.filter("error IS NULL").select("path")
            paths = [r["path"] for r in good.toLocalIterator()]
            _, atom = feeds.set_apart(checked)
            items = feeds.read_feeds(spark, landing, None, row_tag, charset, paths=paths, atom=atom)
            run_id = ingest.ingest_batch(
                items,
                store,
                registry,
                dates.session_time(spark),
                empty_content,
                report_empty=False,
                failed=feeds.failed_files(checked),
                batch_key=f"{query}/{number}",
            )
        trigger.batches.append(run_id)

    trigger.query = (
        files.writeStream.foreachBatch(ingest_files)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    return trigger
