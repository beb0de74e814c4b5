"""Dense positions in a global order without bringing the rows to one task."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedlake.staging import stage

# monotonically_increasing_id keeps the row number of a partition in its low 33 bits.
ROW_MASK = (1 << 33) - 1


def with_positions(rows: DataFrame, *order, name: str = "position") -> DataFrame:
    """Adds name: 0, 1, 2, ... over all rows in the given total order.

    Rows are ranged and sorted, numbered inside each range, and written; only then
    are the ranges counted, so both passes see the same ranges. What goes through
    one task is one count per range. Pass narrow rows.
    """
    ranged = (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_MASK)))
    )
    staged = stage(ranged, "positions")
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        staged.groupBy("_range")
        .agg(F.count("*").alias("_n"))
        .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    return (
        staged.join(F.broadcast(starts), "_range")
        .withColumn(name, F.col("_start") + F.col("_row"))
        .drop("_range", "_row", "_start")
    )


def assign_ids(rows: DataFrame, *order, last_id: int = 0) -> DataFrame:
    """Adds id: last_id + 1, last_id + 2, ... in the given total order."""
    numbered = with_positions(rows, *order, name="_pos")
    return numbered.withColumn("id", F.col("_pos") + F.lit(last_id + 1)).drop("_pos")
