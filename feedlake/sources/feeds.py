"""Landed RSS files as rows of feed items, in batch or as a stream.

Files lie under <landing>/fetch=<time>/feed=<source name>/<file>.xml; the fetch
level may be left out. Both levels prune: reading one source opens its files only.
"""

import bz2
import codecs
import gzip
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake.functions.text import default_if_empty, field
from feedlake.schema import ATOM_FILE, CORRUPT, FEED_FILE, ITEM
from feedlake.staging import stage

# Where an item stands: run order of fetches, then feeds, then files, then items.
POSITION = ["fetch_ord", "source_ord", "file_name", "item_ord"]


# The root elements of a feed document, and what a file without one is called.
FEED_ROOTS = ("rss", "RDF", "feed", "channel")
NO_FEED = "Feed not recognized as RSS 1 or 2."
# The root and the item element of Atom documents.
ATOM_ROOT, ATOM_TAG = "feed", "entry"
# Bytes of a file that its root element is looked for in.
HEAD_BYTES = 65_536

BINARY_FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def _options(reader, row_tag: str, charset: str, schema: T.StructType = FEED_FILE):
    return (
        reader.format("xml")
        .schema(schema)
        .option("rowTag", row_tag)
        .option("charset", charset)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        # The hash is over the raw content, so no trimming while reading.
        .option("ignoreSurroundingSpaces", "false")
    )


def _places(malformed: Column) -> list[Column]:
    return [
        F.col("feed").alias("source"),
        default_if_empty(F.col("fetch"), "").alias("fetch"),
        F.col("_metadata.file_name").alias("file_name"),
        malformed.alias("malformed"),
    ]


def _first(name: str) -> Column:
    return F.get(field(name), F.lit(0))


def _items(files: DataFrame) -> DataFrame:
    """One row per item: first of each element, its source and its file.

    The text of a malformed file is not carried along, its name is enough.
    """
    firsts = [_first(f.name).alias(f.name) for f in ITEM.fields]
    # A part that broke off may hold its first fields; none of it counts. Naming a
    # field lets the flag be queried alone, which Spark refuses for the corrupt column.
    malformed = F.col(CORRUPT).isNotNull() & (F.coalesce(F.size("title"), F.lit(-1)) >= -1)
    return files.select(*firsts, *_places(malformed))


def _entries(files: DataFrame) -> DataFrame:
    """One row per Atom entry, in the fields of an item.

    The link is the one marked as alternate, else one without a mark, else the first; an
    enclosure link becomes the enclosure. The date is that of publication, else of the last change.
    """
    def linked(rel: str) -> Column:
        return F.get(F.filter("link", lambda k: k["_rel"] == rel), F.lit(0))

    unmarked = F.get(F.filter("link", lambda k: k["_rel"].isNull()), F.lit(0))
    enclosure = linked("enclosure")
    fields = {
        "title": _first("title"),
        "link": F.coalesce(linked("alternate")["_href"], unmarked["_href"], _first("link")["_href"]),
        "content": _first("content"),
        "summary": _first("summary"),
        "author": _first("author")["name"],
        "pubDate": F.coalesce(_first("published"), _first("updated")),
        "media:content": _first("media:content"),
        "enclosure": F.when(
            enclosure.isNotNull(), F.struct(enclosure["_href"].alias("_url"), enclosure["_type"].alias("_type"))
        ),
    }
    columns = [fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ITEM.fields]
    malformed = F.col(CORRUPT).isNotNull() & (F.coalesce(F.size("title"), F.lit(-1)) >= -1)
    return files.select(*columns, *_places(malformed))


def fetch_order(fetch: Column) -> Column:
    """A fetch as text that sorts in run order: numbers by value, times as they are.

    Runs of digits are padded to a width of 39, so 2 comes before 10.
    """
    digits = F.regexp_replace(fetch, "([0-9]+)", "0" * 38 + "$1")
    return F.regexp_replace(digits, "0+([0-9]{39})(?![0-9])", "$1")


def _path_value(path: Column, name: str) -> Column:
    """The value of a folder name=value on a path, as Spark writes such names."""
    value = F.regexp_extract(path, f"/{name}=([^/]*)/", 1)
    return F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B")))


def landed_files(
    spark: SparkSession, landing: str, source: str | None = None, fetch: str | None = None
) -> DataFrame:
    """(path, feed, content) of all landed files, or of one source or one fetch."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(landing)
    files = with_feed(files)
    if source:
        files = files.filter(F.col("feed") == source)
    if fetch:
        files = files.filter(_path_value(F.col("path"), "fetch") == fetch)
    return files


def with_feed(files: DataFrame) -> DataFrame:
    return files.select(
        F.col("_metadata.file_path").alias("path"), _path_value(F.col("path"), "feed").alias("feed"), "content"
    )


def _file_error(charset: str):
    """A function (path, content) -> (root element, why the file cannot be read as a feed), each
    None where there is none.

    Made here, so that it travels with its names and executors need no copy of this package.
    """
    openers = {".gz": (gzip.decompress, None), ".bz2": (bz2.decompress, None)}
    roots, no_feed, head_bytes = FEED_ROOTS, NO_FEED, HEAD_BYTES
    root_pattern = re.compile(r"<([A-Za-z_][^\s/>]*)")
    skipped = re.compile(r"<\?.*?\?>|<!--.*?-->|<![^>\[]*(\[.*?\])?[^>]*>", re.S)
    codec = codecs.lookup(charset).name

    def check(path: str, content: bytes) -> tuple[str | None, str | None]:
        for suffix, (decompress, _) in openers.items():
            if path.endswith(suffix):
                try:
                    content = decompress(content)
                except Exception as e:
                    return None, f"{type(e).__name__}: {e}"
        head = bytes(content[:head_bytes]).decode(codec, "replace")
        root = root_pattern.search(skipped.sub("", head))
        # Without any element the file is left to the scan, which sets it aside.
        name = root and root[1].rsplit(":", 1)[-1]
        return name, no_feed if name and name not in roots else None

    return check


def checked_files(files: DataFrame, charset: str = "UTF-8") -> DataFrame:
    """(path, feed, root, error) of files, written: each is decompressed and looked into by itself.

    A file that cannot be decompressed or whose root element is not that of a feed
    has an error, and does not stop the others. Only the head of a plain file is looked at.
    """
    packed = F.lower("path").rlike("[.](gz|bz2)$")
    head = F.when(packed, F.col("content")).otherwise(F.substring("content", 1, HEAD_BYTES))
    # One row is a file here, and few go to a worker at a time, however large they are.
    look = F.udf(_file_error(charset), "root string, error string", useArrow=False)
    looked = files.select("path", "feed", look("path", head).alias("seen"))
    return stage(looked.select("path", "feed", "seen.root", "seen.error"), "files")


def with_item_order(items: DataFrame) -> DataFrame:
    """Adds item_ord, unique in the batch and counting up inside each file.

    That holds straight after the scan only, before any shuffle. A stream cannot
    number its rows, so it does this inside each micro-batch.
    """
    return items.withColumn("item_ord", F.monotonically_increasing_id())


def read_feeds(
    spark: SparkSession,
    landing: str,
    source: str | None = None,
    row_tag: str = "item",
    charset: str = "UTF-8",
    fetch: str | None = None,
    paths: list[str] | None = None,
    without: list[str] | None = None,
    atom: list[str] | None = None,
) -> DataFrame:
    """Items of all landed files, or of one source or one fetch, or of the files at paths.

    Files in without are not opened. Files in atom are read as Atom documents, by their entries.
    """
    def scan(row_tag: str, schema: T.StructType, paths: list[str] | None) -> DataFrame:
        reader = _options(spark.read, row_tag, charset, schema)
        files = reader.load(landing) if paths is None else reader.option("basePath", landing).load(paths)
        if source:
            files = files.filter(F.col("feed") == source)
        if fetch:
            files = files.filter(F.col("fetch") == fetch)
        return files

    left_out = [*(without or []), *(atom or [])]
    if paths is not None:
        # The few left out are gone from the list already.
        paths = sorted(set(paths) - set(left_out))
    if paths == [] and atom:
        return with_item_order(_entries(scan(ATOM_TAG, ATOM_FILE, atom)))
    files = scan(row_tag, FEED_FILE, paths)
    if left_out and paths is None:
        # A filter on the path of files keeps them out of the scan.
        files = files.filter(~F.col("_metadata.file_path").isin(left_out))
    items = _items(files)
    if atom:
        items = items.unionByName(_entries(scan(ATOM_TAG, ATOM_FILE, atom)))
    return with_item_order(items)


def failed_files(checked: DataFrame) -> DataFrame:
    """(source, error) of the files that cannot be read."""
    name = F.element_at(F.split("path", "/"), -1)
    return checked.filter("error IS NOT NULL").select(
        F.col("feed").alias("source"), F.concat_ws(": ", name, "error").alias("error")
    )


def set_apart(checked: DataFrame) -> tuple[list[str], list[str]]:
    """Paths of the files that cannot be read, and of those that are Atom documents."""
    odd = checked.filter(F.col("error").isNotNull() | (F.col("root") == ATOM_ROOT))
    rows = odd.select("path", F.col("error").isNotNull().alias("bad")).collect()
    return [r["path"] for r in rows if r["bad"]], [r["path"] for r in rows if not r["bad"]]


def stream_files(
    spark: SparkSession, landing: str, max_files_per_batch: int | None = None
) -> DataFrame:
    """Newly landed files as a stream of (path, feed, content)."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE)
    reader = reader.option("recursiveFileLookup", "true")
    if max_files_per_batch:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)
    return with_feed(reader.load(landing))


def good_items(items: DataFrame) -> DataFrame:
    return items.filter(~F.col("malformed"))


def malformed_items(items: DataFrame) -> DataFrame:
    """Places of unreadable items: (source, fetch, file_name, item_ord), without their text."""
    return items.filter("malformed").select("source", "fetch", "file_name", "item_ord")


def malformed_files(items: DataFrame) -> DataFrame:
    """Files with unreadable parts, to look at later: (source, fetch, file_name, parts)."""
    return (
        items.filter("malformed")
        .groupBy("source", "fetch", "file_name")
        .agg(F.count("*").alias("parts"))
    )
