import datetime as dt

import pytest
from feedfiles import article, utc

from pyspark.sql import functions as F

from feedlake.functions import dates
from feedlake.operators import catalog, stats
from feedlake.plans import ingest
from feedlake.sources.store import Store

THREE = [
    (1, "Test one", "idnes.cz"),
    (2, "Test two", "hn.cz"),
    (3, "Search Result here", "idnes.cz"),
]
DATED = "id long, title string, source string, createdAt timestamp"


def ids(df):
    return [r["id"] for r in df.collect()]


def totals(page):
    return tuple(page.pagination.first())


@pytest.fixture
def three(spark):
    return article(spark, THREE)


def test_all_articles_newest_first(three):
    page = catalog.list_articles(three, 1, 10)
    assert ids(page.rows) == [3, 2, 1]
    assert totals(page) == (1, 10, 3, 1)


def test_filters_combine(three):
    def found(**kwargs):
        return ids(catalog.list_articles(three, 1, 10, **kwargs).rows)

    assert found(source="idnes.cz") == [3, 1]
    assert found(search="Search Result") == [3]
    assert found(search="sEARCH r%LT") == [3]
    assert found(source="idnes.cz", search="Test") == [1]
    assert found(source="", search="") == [3, 2, 1]
    assert found(search="no such title") == []


def test_accented_letters_are_not_folded(spark):
    titles = article(spark, [(1, "ČESKÁ zpráva", "a"), (2, "česká zpráva", "a")])
    assert ids(catalog.search_title(titles, "česk")) == [2]
    assert ids(catalog.search_title(titles, "ZPR")) == [1, 2]


def test_backslash_is_plain_text(spark):
    titles = article(spark, [(1, r"a\b", "a"), (2, "ab", "a")])
    assert ids(catalog.search_title(titles, "a\\b")) == [1]


def test_pages(three):
    first, second, beyond = (catalog.list_articles(three, p, 2) for p in (1, 2, 3))
    assert ids(first.rows) == [3, 2] and totals(first) == (1, 2, 3, 2)
    assert ids(second.rows) == [1] and totals(second) == (2, 2, 3, 2)
    assert ids(beyond.rows) == [] and totals(beyond) == (3, 2, 3, 2)


@pytest.mark.parametrize("bits", [0, 3, 16])
def test_pages_are_found_whatever_the_spans(spark, monkeypatch, bits):
    monkeypatch.setattr(catalog, "SPAN_BITS", bits)
    known = [*range(1, 40, 3), 1000, 70_000, 70_001, 200_000]
    rows = article(spark, [(i, "t", "a") for i in known])
    newest = sorted(known, reverse=True)
    for limit in (1, 4, 100):
        for page in (1, 2, 5, 30):
            at = (page - 1) * limit
            assert ids(catalog.page_rows(rows, page, limit)) == newest[at : at + limit]


def test_a_page_reads_all_rows_once_and_writes_nothing(spark, tmp_path):
    path = str(tmp_path / "articles")
    article(spark, [(i, f"t{i}", "a") for i in range(1, 300_001, 100)]).write.parquet(path)
    page = catalog.list_articles(spark.read.parquet(path), 2, 5, search="t")
    plan = page.rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id," in plan and "LessThanOrEqual(id," in plan
    assert totals(page) == (2, 5, 3000, 600)


def test_today_is_the_sessions_day_whatever_zone_the_moment_comes_in(spark):
    rows = spark.sql("SELECT 1L AS id, 's' AS source, timestamp '2024-01-16 04:00:00Z' AS createdAt")
    late = dt.datetime(2024, 1, 15, 23, 30, tzinfo=dt.timezone(dt.timedelta(hours=-5)))
    assert ids(catalog.created_today(rows, late)) == [1]
    assert ids(catalog.created_recently(rows, 1, late)) == [1]
    assert stats.article_stats_record(rows, late).first()["today"] == 1


def test_rows_without_a_source_are_counted(spark):
    rows = article(spark, [(1, "t", None), (2, "t", "a"), (3, "t", None)])
    counts = stats.as_map(stats.count_by_source(rows)).first()
    assert (counts["bySource"], counts["withoutSource"]) == ({"a": 1}, 2)


def test_keyset_equals_offset(three):
    assert ids(catalog.keyset_page(three, None, 2)) == [3, 2]
    assert ids(catalog.keyset_page(three, 2, 2)) == [1]


def test_empty_table(spark):
    page = catalog.list_articles(article(spark, []), 1, 10)
    assert ids(page.rows) == [] and totals(page) == (1, 10, 0, 0)


@pytest.mark.parametrize("page, limit", [(0, 10), (1, 0), (-1, 10)])
def test_bad_paging(three, page, limit):
    with pytest.raises(ValueError):
        catalog.list_articles(three, page, limit)


def test_by_id(three):
    assert tuple(catalog.article_by_id(three, 2)) == THREE[1]
    with pytest.raises(LookupError, match="Article not found"):
        catalog.article_by_id(three, 999)


def test_by_source(three):
    page = catalog.articles_by_source(three, "idnes.cz", 1, 10)
    assert ids(page.rows) == [3, 1] and totals(page) == (1, 10, 2, 1)
    none = catalog.articles_by_source(three, "non-existent", 1, 10)
    assert ids(none.rows) == [] and totals(none) == (1, 10, 0, 0)


def dated(spark, *times):
    rows = [(i, f"t{i}", "s", t) for i, t in enumerate(times, 1)]
    return spark.createDataFrame(
        rows, "id long, title string, source string, text_time string"
    ).selectExpr("id", "title", "source", "cast(text_time as timestamp) AS createdAt")


def test_by_date(spark):
    rows = dated(
        spark,
        "2024-01-01 12:00:00",
        "2024-01-01 23:59:59.999999",
        "2024-01-02 00:00:00",
        "2023-12-31 23:59:59.999999",
    )
    page = catalog.articles_by_date(rows, "2024-01-01", 1, 10)
    assert ids(page.rows) == [2, 1] and totals(page) == (1, 10, 2, 1)
    assert page.info == {"date": "2024-01-01"}


@pytest.mark.parametrize("day", ["invalid-date", "2024-02-30", "2024-1-1", "2024-01-01x", ""])
def test_bad_date(spark, day):
    with pytest.raises(ValueError, match="Invalid date format. Use YYYY-MM-DD"):
        catalog.articles_by_date(dated(spark), day)


def test_recent(spark):
    as_of = utc("2024-03-10T15:00:00")
    rows = dated(
        spark,
        "2024-03-10 15:00:00",
        "2024-03-09 15:00:00",
        "2024-02-29 15:00:00",
        "2024-03-03 00:00:00",
        "2024-03-02 23:59:59.999",
        "2024-04-01 00:00:00",
    )
    page = catalog.recent_articles(rows, 7, as_of, 1, 10)
    assert ids(page.rows) == [6, 4, 2, 1]
    assert page.info == {"days": 7, "fromDate": "2024-03-03T00:00:00.000Z"}
    assert ids(catalog.created_today(rows, as_of)) == [1]


def test_recent_defaults_to_now(spark):
    now = dt.datetime.now(dt.timezone.utc)
    rows = dated(spark, f"{now:%Y-%m-%d %H:%M:%S}", f"{now - dt.timedelta(days=10):%Y-%m-%d %H:%M:%S}")
    assert ids(catalog.recent_articles(rows, 7).rows) == [1]


@pytest.mark.parametrize("days", [0, 366, -1])
def test_bad_days(spark, days):
    with pytest.raises(ValueError, match="Days must be between 1 and 365"):
        catalog.recent_articles(dated(spark), days)


def test_sources_ranked_ties_by_first_article(spark):
    rows = article(
        spark, [(1, "1", "idnes.cz"), (2, "2", "idnes.cz"), (3, "3", "hn.cz"), (4, "4", "aktualne.cz")]
    )
    ranked = [tuple(r) for r in stats.sources_ranked(rows).collect()]
    assert ranked == [("idnes.cz", 2), ("hn.cz", 1), ("aktualne.cz", 1)]
    assert stats.sources_ranked(article(spark, [])).collect() == []


def test_stats(spark):
    rows = spark.sql(
        """
        SELECT id, source, cast(t AS timestamp) AS createdAt FROM VALUES
          (1L, 'idnes.cz', '2024-05-01 00:00:00'), (2L, 'idnes.cz', '2024-05-01 10:00:00'),
          (3L, 'hn.cz', '2024-04-30 23:59:59.999'), (4L, 'aktualne.cz', '2024-01-01 00:00:00')
          AS v(id, source, t)
        """
    )
    as_of = utc("2024-05-01T12:00:00")
    record = stats.article_stats_record(rows, as_of).first()
    assert (record["total"], record["today"]) == (4, 2)
    assert record["bySource"] == {"idnes.cz": 2, "hn.cz": 1, "aktualne.cz": 1}
    long = {r["source"]: (r["total"], r["today"]) for r in stats.article_stats(rows, as_of).collect()}
    assert long == {None: (4, 2), "idnes.cz": (2, 2), "hn.cz": (1, 0), "aktualne.cz": (1, 0)}
    empty = stats.article_stats_record(rows.limit(0), as_of).first()
    assert (empty["total"], empty["today"], empty["bySource"]) == (0, 0, {})


@pytest.fixture
def prague(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Prague")
    yield spark
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_days_follow_the_session_zone_of_a_stored_table(prague, tmp_path):
    spark = prague
    rows = spark.sql(
        """
        SELECT ord, 't' AS title, 'u' AS url, concat('h', ord) AS contentHash, 's' AS source,
               cast(t AS timestamp) AS createdAt
        FROM VALUES (1, '2024-01-14 22:59:59Z'), (2, '2024-01-14 23:00:00Z'),
          (3, '2024-01-15 22:59:59Z'), (4, '2024-01-15 23:00:00Z') AS v(ord, t)
        """
    )
    store = Store(str(tmp_path / "store"))
    ingest.save_articles(rows, store, "ord")
    articles = store.articles(spark)
    assert ids(catalog.articles_by_date(articles, "2024-01-15").rows) == [3, 2]
    page = catalog.recent_articles(articles, 1, utc("2024-01-16T00:30:00"))
    assert ids(page.rows) == [4, 3, 2]
    assert page.info["fromDate"] == "2024-01-14T23:00:00.000Z"
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert ids(catalog.articles_by_date(articles, "2024-01-15").rows) == [4, 3]
    spark.conf.set("spark.sql.session.timeZone", "+01:00")
    assert ids(catalog.articles_by_date(articles, "2024-01-15").rows) == [3, 2]


def test_iso_text_is_utc_in_any_zone(prague):
    # Local clocks change in both hours: one is repeated, the other skipped.
    texts = ["2024-10-27T00:30:00.001Z", "2024-10-27T01:30:00.999Z", "2024-03-31T02:30:00.000Z",
             "1969-12-31T23:59:59.500Z"]
    frame = prague.createDataFrame([(t,) for t in texts], "t string")
    got = frame.select(dates.iso_text(F.col("t").cast("timestamp"))).collect()
    assert [r[0] for r in got] == texts
