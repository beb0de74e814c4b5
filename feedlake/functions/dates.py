"""Column expressions over dates and times; zones follow the session time zone."""

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake.functions.text import field, null_if_empty, trim_white_space

# The weekday before a feed date, the offset after it, and the forms
# in between; then the day format of arguments, its message and the prefix of run ids.
WEEKDAY_PATTERN = "^(?i:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*)(?:[,.] *| +)"
OFFSET_PATTERN = "(?:GMT|UTC)?([+-][0-9]{2}):?([0-9]{2})$"
OFFSET_FORMAT = "d MMM yyyy HH:mm[:ss] Z"
ZONE_FORMAT = "d MMM yyyy HH:mm[:ss] z"
LOCAL_FORMAT = "d MMM yyyy HH:mm[:ss]"
FRACTION_FORMATS = (
    ("[+-][0-9]{4}$", "d MMM yyyy HH:mm:ss.SSSSSS Z"),
    ("[A-Za-z]$", "d MMM yyyy HH:mm:ss.SSSSSS z"),
    ("[0-9]$", "d MMM yyyy HH:mm:ss.SSSSSS"),
)
HALF_DAY_FORMAT = "d MMM yyyy hh:mm[:ss] a"
DATE_FORMAT = "d MMM yyyy"
SLASH_FORMAT = "M/d/yyyy[ HH:mm[:ss]]"
SLASH_HALF_DAY_FORMAT = "M/d/yyyy hh:mm[:ss] a"
DAY_FORMAT = "yyyy-MM-dd"
BAD_DAY = "Invalid date format. Use YYYY-MM-DD"

# The usual form of feed dates, which needs nothing but its weekday removed.
PLAIN_PATTERN = (
    "^(?:[A-Z][a-z]{2}, )?[0-9]{1,2} [A-Z][a-z]{2} [0-9]{4} "
    "(?:[01][0-9]|2[0-3]):[0-9]{2}(?::[0-9]{2})? (?:[+-][0-9]{4}|[A-Z]{3,4})$"
)
ISO_PATTERN = "^[0-9]{4}"
DATED_PATTERN = "^[0-9]{1,2} [A-Za-z]{3} [0-9]{4}(?: |$)"
SLASH_PATTERN = "^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"
# The hour 24 is midnight of the next day.
MIDNIGHT_PATTERN = "[ T]24:00(?::00(?:[.]0+)?)?(?![:0-9])"

# Other spellings of feed dates, each brought to one of the forms above: what stands there,
# and what it becomes. The year of two digits turns at 50.
ISO_SPELLINGS = (
    ("([ T])24:00", "$100:00"),
    ("^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})", "$1-$2-$3"),
    ("^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[T ][0-9]{2}:[0-9]{2})(?![:0-9])", "$1:00"),
)
# Spellings that are seldom; then, after the weekday, the month in front; what is not yet
# day, month and year; and the offset.
ODD_SPELLINGS = (
    (r"\s*\([^)]*\)$", ""),
    ("(?<![0-9])([0-9]{1,2})-([A-Za-z]{3})[a-z]*-([0-9]{2,4})(?![0-9])", "$1 $2 $3"),
    (" ([0-9]:[0-9]{2})", " 0$1"),
    (" 24:00", " 00:00"),
    ("([.][0-9]{6})[0-9]+", "$1"),
    (" ?[Aa][Mm]$", " AM"),
    (" ?[Pp][Mm]$", " PM"),
)
MONTH_FIRST_SPELLINGS = (("^([A-Za-z]{3})[a-z]*[.]? ([0-9]{1,2}),? ([0-9]{4}),?", "$2 $1 $3"),)
DAY_SPELLINGS = (
    ("^([0-9]{1,2} [A-Za-z]{3})[a-z]*[.]?(?= )", "$1"),
    ("^([0-9]{1,2} [A-Za-z]{3}) ([0-4][0-9])(?= |$)", "$1 20$2"),
    ("^([0-9]{1,2} [A-Za-z]{3}) ([5-9][0-9])(?= |$)", "$1 19$2"),
)
OFFSET_SPELLINGS = ((OFFSET_PATTERN, "$1$2"),)
RUN_ID_PREFIX = "scrape_"


def published_text() -> Column:
    """First set date field of an item, NULL when it is empty."""
    return null_if_empty(F.coalesce(F.col("pubDate"), F.col("published"), field("dc:date")))


def with_published(items: DataFrame) -> DataFrame:
    """Adds publishedAt, the item's date, and dateError, true when a given date is none.

    Dates may be ISO-8601 or RFC-822, with the usual variations: minutes without seconds,
    hours of one digit, parts of seconds, AM and PM, midnight as 24:00, slashes (year or month in
    front), dashes, full or shortened month names, years of two digits, the month in front, a
    zone's name in brackets. The shape picks the one form to try, because a failed parse is dear,
    and only unusual shapes are respelled. The cleaned texts are columns of their own, as they are used
    several times and would otherwise be cleaned each time.
    """
    text = F.col("_date_text")
    dated = F.col("_dated")
    is_iso, is_slashed = text.rlike(ISO_PATTERN), text.rlike(SLASH_PATTERN)

    def as_format(form: str) -> Column:
        return F.try_to_timestamp(dated, F.lit(form))

    # A plain cast would read "12:30" as today, so ISO needs its year in front.
    half_day = F.endswith(dated, F.lit(" AM")) | F.endswith(dated, F.lit(" PM"))
    fraction = F.contains(dated, F.lit("."))
    fractions = F.coalesce(*[F.when(fraction & dated.rlike(end), as_format(form)) for end, form in FRACTION_FORMATS])
    published = (
        F.when(is_iso, F.try_to_timestamp(dated))
        .when(is_slashed & half_day, as_format(SLASH_HALF_DAY_FORMAT))
        .when(is_slashed, as_format(SLASH_FORMAT))
        # What has not the shape of a date is not tried.
        .when(~dated.rlike(DATED_PATTERN), F.lit(None).cast("timestamp"))
        .when(half_day, as_format(HALF_DAY_FORMAT))
        .when(fraction, fractions)
        .when(dated.rlike("[+-][0-9]{4}$"), as_format(OFFSET_FORMAT))
        .when(dated.rlike("[A-Za-z]$"), as_format(ZONE_FORMAT))
        .when(F.contains(dated, F.lit(":")), as_format(LOCAL_FORMAT))
        .otherwise(as_format(DATE_FORMAT))
    )
    midnight = F.when(F.contains(text, F.lit("24:00")) & text.rlike(MIDNIGHT_PATTERN), F.col("publishedAt") + F.expr("INTERVAL 1 DAY"))
    named = items.withColumn("_date_text", trim_white_space(published_text()))
    return (
        named.withColumn("_dated", _respelled(text))
        .withColumn("publishedAt", published)
        .withColumn("publishedAt", midnight.otherwise(F.col("publishedAt")))
        .withColumn("dateError", text.isNotNull() & F.col("publishedAt").isNull())
        .drop("_date_text", "_dated")
    )


def _bound(value: Column, use) -> Column:
    """use(value) with value worked out once. Evaluated outside of generated code, whose methods
    would grow past what the JVM compiles."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _respelled(text: Column) -> Column:
    """The text in one of the forms above. Plain tests on it decide which replacements are tried."""

    def apply(spelled: Column, spellings) -> Column:
        for pattern, by in spellings:
            spelled = F.regexp_replace(spelled, pattern, by)
        return spelled

    def respell(text: Column) -> Column:
        def has(part: str) -> Column:
            return F.contains(text, F.lit(part))

        last = F.lower(F.right(text, F.lit(1)))
        hour = F.substring(F.substring_index(text, ":", 1), -2, 1)
        odd = has("(") | has("-") | has(" 24:") | has(".") | (last == "m") | (hour == " ")
        offset = has("GMT+") | has("GMT-") | has("UTC+") | has("UTC-") | has("(") | (F.substring(text, -3, 1) == ":")
        steps = (
            (lambda t: odd, ODD_SPELLINGS),
            (lambda t: F.lit(True), ((WEEKDAY_PATTERN, ""),)),
            (lambda t: F.substring(t, 1, 1) > "9", MONTH_FIRST_SPELLINGS),
            (lambda t: ~t.rlike(DATED_PATTERN), DAY_SPELLINGS),
            (lambda t: offset, OFFSET_SPELLINGS),
        )

        def step(needed, spellings):
            return lambda t: F.when(needed(t), apply(t, spellings)).otherwise(t)

        out = text
        for needed, spellings in steps:
            out = _bound(out, step(needed, spellings))
        return (
            F.when(text.rlike(PLAIN_PATTERN), F.substring_index(text, ", ", -1))
            .when(text.rlike(ISO_PATTERN), apply(text, ISO_SPELLINGS))
            .otherwise(out)
        )

    return _bound(text, respell)


def start_of_day(moment: Column) -> Column:
    return F.date_trunc("day", moment)


def days_before(moment: Column, days: int) -> Column:
    return start_of_day(moment) - F.make_dt_interval(F.lit(days))


def next_hour(moment: Column) -> Column:
    return F.date_trunc("hour", moment) + F.expr("INTERVAL '1' HOUR")


def utc_date(moment: Column) -> Column:
    """Calendar day in UTC, whatever the session time zone is."""
    days = F.floor(F.unix_seconds(moment.cast("timestamp")) / F.lit(86_400))
    return F.date_from_unix_date(days.cast("int"))


def iso_text(moment: Column) -> Column:
    """UTC text form with milliseconds, whatever the session time zone is.

    Built from the count of milliseconds, because a detour over local time would be
    ambiguous where clocks change.
    """
    millis = F.unix_millis(moment.cast("timestamp"))
    of_day = F.pmod(millis, F.lit(86_400_000))

    def part(unit: int, modulus: int, width: int) -> Column:
        return F.lpad((F.floor(of_day / unit) % modulus).cast("string"), width, "0")

    return F.concat(
        utc_date(moment).cast("string"),
        F.lit("T"),
        part(3_600_000, 24, 2),
        F.lit(":"),
        part(60_000, 60, 2),
        F.lit(":"),
        part(1_000, 60, 2),
        F.lit("."),
        part(1, 1_000, 3),
        F.lit("Z"),
    )


def run_id(moment: Column) -> Column:
    return F.concat(F.lit(RUN_ID_PREFIX), F.unix_millis(moment).cast("string"))


def is_invalid_day(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit(DAY_FORMAT)).isNull()


def parse_day(text: str) -> dt.date:
    """Strict yyyy-MM-dd, for arguments."""
    if not (isinstance(text, str) and len(text) == 10):
        raise ValueError(BAD_DAY)
    try:
        return dt.datetime.strptime(text, "%Y-%m-%d").date()
    except ValueError:
        raise ValueError(BAD_DAY) from None


def session_zone(spark: SparkSession) -> dt.tzinfo:
    name = spark.conf.get("spark.sql.session.timeZone")
    if name in ("UTC", "Etc/UTC", "GMT", "Z"):
        return dt.timezone.utc
    if name[0] in "+-":
        return dt.datetime.strptime(name, "%z").tzinfo
    return ZoneInfo(name)


def session_time(spark: SparkSession, moment: dt.datetime | None = None) -> dt.datetime:
    """A moment, by default now, as wall-clock time of the session time zone."""
    if moment is None:
        moment = dt.datetime.now(dt.timezone.utc)
    if moment.tzinfo is None:
        return moment
    return moment.astimezone(session_zone(spark)).replace(tzinfo=None)


def in_utc(spark: SparkSession, moment: dt.datetime) -> dt.datetime:
    """A wall-clock time of the session time zone as one of UTC."""
    zoned = moment.replace(tzinfo=session_zone(spark))
    return zoned.astimezone(dt.timezone.utc).replace(tzinfo=None)


def utc_text(spark: SparkSession, moment: dt.datetime) -> str:
    """UTC text form of a wall-clock time of the session time zone."""
    return in_utc(spark, moment).isoformat(timespec="milliseconds") + "Z"


def time_literal(moment: dt.datetime) -> Column:
    """Wall-clock time as a timestamp of the session, not of the Python process."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp")


def created_or(created: Column, now: dt.datetime) -> Column:
    """A given creation time, or the time of the run."""
    return F.coalesce(created.cast("timestamp"), time_literal(now))


def day_start(day: dt.date, like: T.DataType) -> Column:
    """Midnight of a day as a constant of the compared column's own type.

    Casting the constant, not the column, keeps the comparison in the scan.
    """
    return F.lit(f"{day.isoformat()} 00:00:00").cast(like)
