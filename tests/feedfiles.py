"""Helpers that write feed files and build item rows for the tests."""

import datetime as dt
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import functions as F

from feedlake.schema import ITEM

NAMESPACES = 'xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:media="http://search.yahoo.com/mrss/"'


def element(name, value):
    if isinstance(value, list):
        return "".join(element(name, v) for v in value)
    if isinstance(value, dict):
        return f"<{name} " + " ".join(f"{k}={quoteattr(v)}" for k, v in value.items()) + "/>"
    return f"<{name}>{escape(value)}</{name}>"


def rss(items):
    body = "".join(
        "<item>" + "".join(element(k, v) for k, v in item.items()) + "</item>" for item in items
    )
    return f'<?xml version="1.0"?><rss {NAMESPACES}><channel><title>feed</title>{body}</channel></rss>'


def land(landing, feed, items, fetch="1", name="feed.xml"):
    """items is a list of dicts, or the raw text of a file."""
    folder = Path(landing) / f"fetch={fetch}" / f"feed={feed}"
    folder.mkdir(parents=True, exist_ok=True)
    text = items if isinstance(items, str) else rss(items)
    (folder / name).write_text(text, encoding="utf-8")


def items_frame(spark, items):
    """Items given as dicts; nested fields as dicts with _url and _type."""
    rows = [tuple(item.get(f.name) for f in ITEM.fields) for item in items]
    return spark.createDataFrame(rows, ITEM)


def article(spark, rows, columns="id long, title string, source string"):
    return spark.createDataFrame(rows, columns)


def utc(text):
    return dt.datetime.fromisoformat(text)


def plain_time(column):
    """Timestamps as UTC text, so that the zone of the test machine plays no part."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")
