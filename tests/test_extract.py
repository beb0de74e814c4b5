import hashlib
import re

import pytest
from feedfiles import items_frame, plain_time
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from feedlake.functions import dates, text
from feedlake.operators import items as item_ops


def value(spark, item, expression):
    return items_frame(spark, [item]).select(expression.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "item, expected",
    [
        ({"content": "<p>Test content</p>"}, "Test content"),
        ({"summary": "<div>Test summary</div>"}, "Test summary"),
        ({"description": "<p>Test description</p>"}, "Test description"),
        ({"content": "a", "summary": "b", "description": "c"}, "a"),
        ({}, None),
        ({"content": "", "summary": "b"}, None),
        ({"content": "<p><br/></p>"}, None),
        ({"content": "\n\t x  ﻿"}, "x"),
        ({"content": "a &amp; <script>b</script>"}, "a &amp; b"),
        ({"content": "1 < 2 and 3 > 2"}, "1  2"),
        ({"content": "<p\nclass='x'>multi\nline</p>"}, "multi\nline"),
    ],
)
def test_description(spark, item, expected):
    assert value(spark, item, text.description()) == expected


def test_nested_html_keeps_its_text(spark):
    html = "<section><h2>Head</h2><p>One <b>bold</b>, <i>two</i></p><ol><li>x</li></ol></section>"
    assert value(spark, {"content": html}, text.description()) == "HeadOne bold, twox"


@pytest.mark.parametrize(
    "item, expected",
    [
        ({"creator": "Eva"}, "Eva"),
        ({"author": "Petr"}, "Petr"),
        ({"dc:creator": "Olga"}, "Olga"),
        ({"creator": "C", "author": "A", "dc:creator": "D"}, "C"),
        ({"creator": "", "author": "A"}, None),
        ({}, None),
    ],
)
def test_author(spark, item, expected):
    assert value(spark, item, text.author()) == expected


@pytest.mark.parametrize(
    "item, expected",
    [
        ({"pubDate": "2024-01-01T00:00:00Z"}, "2024-01-01 00:00:00"),
        ({"published": "2024-01-02T00:00:00Z"}, "2024-01-02 00:00:00"),
        ({"dc:date": "2024-01-02T01:00:00+01:00"}, "2024-01-02 00:00:00"),
        ({"pubDate": "Mon, 01 Jan 2024 12:00:00 GMT"}, "2024-01-01 12:00:00"),
        ({"pubDate": "Mon, 1 Jan 2024 12:00:00 +0100"}, "2024-01-01 11:00:00"),
        ({"pubDate": "1 Jan 2024 12:00:00 -05:00"}, "2024-01-01 17:00:00"),
        ({"pubDate": "Mon, 01 Jan 2024 12:00 EST"}, "2024-01-01 17:00:00"),
        ({"pubDate": "Sat, 01 Jun 2024 12:00:00 UT"}, "2024-06-01 12:00:00"),
        ({"pubDate": " 01 JAN 2024 "}, "2024-01-01 00:00:00"),
        ({"pubDate": "1 Jan 2024 12:30:00 GMT+0100"}, "2024-01-01 11:30:00"),
        ({"pubDate": "1 Jan 2024 12:30"}, "2024-01-01 12:30:00"),
        ({"pubDate": "31 Feb 2024 12:30"}, None),
        ({"pubDate": "12:30 CET"}, None),
        ({"pubDate": "2024-01-01"}, "2024-01-01 00:00:00"),
        ({"pubDate": "invalid-date"}, None),
        ({"pubDate": "12:30"}, None),
        ({"pubDate": "", "published": "2024-01-02T00:00:00Z"}, None),
        ({}, None),
    ],
)
def test_published(spark, item, expected):
    dated = dates.with_published(items_frame(spark, [item]))
    assert dated.select(plain_time("publishedAt")).first()[0] == expected


def test_parse_error_only_for_given_dates(spark):
    items = [{"pubDate": "invalid-date"}, {"pubDate": "2024-01-01"}, {"pubDate": ""}, {}]
    flags = dates.with_published(items_frame(spark, items)).select("dateError").collect()
    assert [f[0] for f in flags] == [True, False, False, False]


MEDIA = {"media:content": {"_url": "m"}}
PNG = {"enclosure": {"_url": "e", "_type": "image/png"}}


@pytest.mark.parametrize(
    "item, expected",
    [
        (MEDIA | PNG, "m"),
        (PNG, "e"),
        ({"media:content": {"_url": ""}} | PNG, "e"),
        ({"enclosure": {"_url": "e", "_type": "audio/mpeg"}}, None),
        ({"enclosure": {"_url": "e", "_type": "IMAGE/png"}}, None),
        ({"enclosure": {"_url": "e", "_type": None}}, None),
        ({"description": '<p>t <img src="https://x/i.jpg" alt="t" /></p>'}, "https://x/i.jpg"),
        ({"content": '<img src="u1" data-src="u2">'}, "u2"),
        ({"content": "<img src='u1'>"}, None),
        ({"content": '<img src="u1"><img src="u2">'}, "u1"),
        ({"content": "", "description": '<img src="u"/>'}, None),
        ({}, None),
    ],
)
def test_image(spark, item, expected):
    assert value(spark, item, text.image_url()) == expected


def test_content_hash(spark):
    items = [{"content": "<p>x</p>"}, {"summary": "ž"}, {"link": "l"}, {"content": "", "link": "l"}]
    frame = items_frame(spark, items)

    def hashes(mode):
        return [r[0] for r in frame.select(text.content_hash(mode)).collect()]

    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    assert hashes("collapse") == [sha("<p>x</p>"), sha("ž"), sha(""), sha("")]
    assert hashes("key_by_url") == [sha("<p>x</p>"), sha("ž"), sha("l"), sha("l")]
    with pytest.raises(ValueError):
        text.content_hash("other")


def test_required_fields_are_not_trimmed(spark):
    items = [
        {"title": "t", "link": "l"},
        {"title": "", "link": "l"},
        {"title": "t", "link": ""},
        {"title": None, "link": "l"},
        {"title": " ", "link": "l"},
    ]
    frame = items_frame(spark, items)
    assert [r["title"] for r in item_ops.valid_items(frame).collect()] == ["t", " "]
    flags = [r[0] for r in frame.select(item_ops.is_valid_item()).collect()]
    assert flags == [True, False, False, False, True]


JS_SPACE = text.WHITE_SPACE
HTML = st.text(alphabet="<>ab/\"= \n  ", max_size=30)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(HTML, min_size=1, max_size=40))
def test_strip_html_against_plain_python(spark, values):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = {r["i"]: r["d"] for r in frame.select("i", text.strip_html(F.col("v")).alias("d")).collect()}
    for i, v in enumerate(values):
        assert got[i] == (re.sub("<[^>]*>", "", v).strip(JS_SPACE) or None)


def _like(value, search):
    """Substring match with % and _ as wildcards, ASCII letters folded."""

    def fold(s):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)

    pattern = "".join(
        ".*" if c == "%" else "." if c == "_" else re.escape(c) for c in fold(search)
    )
    return re.fullmatch(f".*{pattern}.*", fold(value), re.DOTALL) is not None


TITLE = st.text(alphabet="aAbBčČ%_\\.x", max_size=8)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TITLE, min_size=1, max_size=40), TITLE.filter(bool))
def test_search_against_plain_python(spark, titles, search):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string")
    kept = frame.filter(text.contains_pattern(F.col("t"), search)).select("i").collect()
    assert {r["i"] for r in kept} == {i for i, t in enumerate(titles) if _like(t, search)}


def test_time_expressions(spark):
    frame = spark.sql("SELECT TIMESTAMP '2024-03-05 23:59:59.9876' AS t")
    row = frame.select(
        plain_time(dates.next_hour(F.col("t"))),
        dates.iso_text(F.col("t")),
        dates.run_id(F.col("t")),
        plain_time(dates.days_before(F.col("t"), 7)),
        plain_time(dates.start_of_day(F.col("t"))),
        text.default_if_empty(F.lit(""), "all"),
    ).first()
    assert tuple(row) == (
        "2024-03-06 00:00:00",
        "2024-03-05T23:59:59.987Z",
        "scrape_1709683199987",
        "2024-02-27 00:00:00",
        "2024-03-05 00:00:00",
        "all",
    )
