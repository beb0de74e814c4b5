"""Request log: JSON lines with a text message, as columns."""

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedlake.schema import ACCESS_LOG_LINE

# The message forms and the status of a failure without one.
#   Incoming <method> <url> - <ip> - <agent>
#   Completed <method> <url> - <status> - <n>ms
#   Failed <method> <url> - <status> - <n>ms - <error>
INCOMING, COMPLETED, FAILED = "Incoming", "Completed", "Failed"
SEPARATOR = " - "
DURATION_UNIT = "ms"
BEFORE_ERROR = "^[0-9]+ms( - )?"
DEFAULT_STATUS = 500
ERROR_LEVEL = "error"


def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ACCESS_LOG_LINE).json(path)


def parse_access_log(lines: DataFrame) -> DataFrame:
    """Adds outcome, method, url, ip, user_agent, status, duration_ms, error.

    Lines of other kinds are dropped. Fields a line does not have are NULL, but the
    agent of a request is '' and the status of a failure is 500 when missing.
    """
    kept = [c for c in lines.columns if c != "message"]
    message = F.col("message")
    kinds = [F.startswith(message, F.lit(f"{k} ")) for k in (INCOMING, COMPLETED, FAILED)]
    words = (
        lines.filter(kinds[0] | kinds[1] | kinds[2])
        .select(*kept, F.split(message, SEPARATOR, 3).alias("_parts"))
        .withColumn("_head", F.split(F.get("_parts", F.lit(0)), " ", 3))
    )
    outcome = F.get("_head", F.lit(0))
    incoming, failed = outcome == INCOMING, outcome == FAILED
    second = F.get("_parts", F.lit(1))
    rest = F.coalesce(F.get("_parts", F.lit(2)), F.lit(""))
    status = second.try_cast("int")
    duration = F.substring_index(rest, DURATION_UNIT, 1).try_cast("long")
    return words.select(
        *kept,
        outcome.alias("outcome"),
        F.get("_head", F.lit(1)).alias("method"),
        F.get("_head", F.lit(2)).alias("url"),
        F.when(incoming, second).alias("ip"),
        F.when(incoming, rest).alias("user_agent"),
        F.when(failed, F.coalesce(status, F.lit(DEFAULT_STATUS)))
        .when(~incoming, status)
        .alias("status"),
        F.when(~incoming, duration).alias("duration_ms"),
        F.when(failed, F.regexp_replace(rest, BEFORE_ERROR, "")).alias("error"),
    )


def error_events(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("level") == ERROR_LEVEL)


def request_durations(requests: DataFrame) -> DataFrame:
    """Count and durations of finished requests by method, url and outcome.

    p95_ms is exact: the smallest duration that 95 of 100 requests do not exceed.
    """
    took = "duration_ms"
    return (
        requests.filter(F.col("outcome") != INCOMING)
        .groupBy("method", "url", "outcome")
        .agg(
            F.count("*").alias("requests"),
            F.avg(took).alias("avg_ms"),
            F.max(took).alias("max_ms"),
            F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {took})")
            .cast("long")
            .alias("p95_ms"),
        )
    )


# Buckets of durations: each is 2 % wider than the one before.
BUCKET_GROWTH = 1.02
# What a quantile read from buckets may be off, as a share of the exact one.
BUCKET_ERROR = (BUCKET_GROWTH - 1) / 2


def duration_bucket(duration: Column) -> Column:
    """Number of the bucket of a duration: 0 from 1 ms on, -1 for none at all."""
    scaled = F.floor(F.ln(duration.cast("double")) / F.lit(math.log(BUCKET_GROWTH)))
    return F.when(duration >= 1, scaled.cast("int")).when(duration.isNotNull(), F.lit(-1))


def duration_histogram(requests: DataFrame, *by: str) -> DataFrame:
    """(method, url, outcome, *by, bucket, n): finished requests per bucket of duration.

    Histograms of parts add up to that of the whole: keep one per hour, named in by, and merge what
    is asked for. A group has some 1,400 buckets at most, whatever its number of requests. Requests
    without a duration have bucket NULL.
    """
    return (
        requests.filter(F.col("outcome") != INCOMING)
        .groupBy("method", "url", "outcome", *by, duration_bucket(F.col("duration_ms")).alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def merged_histogram(histogram: DataFrame, *by: str) -> DataFrame:
    """The histogram over all other columns than method, url, outcome and by."""
    return histogram.groupBy("method", "url", "outcome", *by, "bucket").agg(F.sum("n").alias("n"))


def histogram_durations(histogram: DataFrame, *by: str, share: float = 0.95) -> DataFrame:
    """(method, url, outcome, *by, requests, quantile_ms): the duration that share of the timed
    requests do not exceed, off by no more than BUCKET_ERROR of its exact value, and half a millisecond."""
    keys = ["method", "url", "outcome", *by]
    up = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys)
    timed = merged_histogram(histogram, *by).withColumns(
        {
            "_below": F.sum(F.when(F.col("bucket").isNotNull(), F.col("n"))).over(up),
            "_timed": F.sum(F.when(F.col("bucket").isNotNull(), F.col("n"))).over(whole),
        }
    )
    # The middle of a bucket, which lies between its bounds by the same share.
    middle = F.pow(F.lit(BUCKET_GROWTH), F.col("bucket")) * F.lit((1 + BUCKET_GROWTH) / 2)
    reached = F.col("_below") >= F.col("_timed") * F.lit(share)
    at = F.when(reached, F.when(F.col("bucket") < 0, F.lit(0.0)).otherwise(middle))
    return timed.groupBy(*keys).agg(F.sum("n").alias("requests"), F.min(at).alias("quantile_ms"))
