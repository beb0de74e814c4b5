"""First-wins deduplication by content hash, inside a batch and against history."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HASH = "contentHash"

# Hashes above this are not broadcast: about 100 bytes each, so 100 MB.
BROADCAST_ROWS = 1_000_000


def first_wins(rows: DataFrame, order: list[str], key: str = HASH) -> DataFrame:
    """The first row of each key in the given total order.

    The rank filter is planned as a group limit before the shuffle, so every task
    sends at most one row per key, however many copies it holds.
    """
    first = W.partitionBy(key).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")


def new_against(
    batch: DataFrame, history: DataFrame, key: str = HASH, batch_rows: int | None = None
) -> DataFrame:
    """Rows of batch whose key history lacks.

    With a known small batch its keys are broadcast to the history scan, so the
    history is never shuffled; beyond the bound both sides shuffle on the key.
    """
    known = history.select(key)
    if batch_rows is not None and batch_rows <= BROADCAST_ROWS:
        keys = batch.select(key).distinct()
        known = known.join(F.broadcast(keys), key, "left_semi")
    # History copies collapse in partial aggregation before they travel.
    return batch.join(known.distinct(), key, "left_anti")


def hash_uniqueness_audit(rows: DataFrame, key: str = HASH) -> DataFrame:
    """Keys held by more than one row; none in a sound store."""
    return rows.groupBy(key).agg(F.count("*").alias("copies")).filter("copies > 1")
