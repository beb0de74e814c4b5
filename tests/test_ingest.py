import datetime as dt
from pathlib import Path

import pytest
from feedfiles import land, plain_time, utc
from pyspark.sql import functions as F

from feedlake.operators import dedup
from feedlake.plans import ingest, reports
from feedlake.sources import feeds
from feedlake.sources.registry import feed_registry
from feedlake.sources.store import Store
from feedlake.streaming.ingest import stream_ingest

# One item with a media image, one with an image enclosure.
TWO_FULL = [
    {
        "title": "Vlak stojí",
        "link": "https://news.example/train",
        "content": "<p>Na trati <b>spadl</b> strom.</p>",
        "creator": "Eva Malá",
        "pubDate": "2024-01-01T12:00:00Z",
        "media:content": {"url": "https://news.example/train.jpg"},
    },
    {
        "title": "Sníh v horách",
        "link": "https://news.example/snow",
        "content": "<p>Napadlo půl metru.</p>",
        "creator": "Petr Velký",
        "pubDate": "2024-01-01T13:00:00Z",
        "enclosure": {"url": "https://news.example/snow.png", "type": "image/png"},
    },
]
# All fields at once, content only, no content, and neither title nor link.
COMPLEX = [
    {
        "title": "Everything",
        "link": "https://news.example/all",
        "content": "<p>from content</p>",
        "summary": "<p>from summary</p>",
        "description": "<p>from description</p>",
        "creator": "from creator",
        "author": "from author",
        "dc:creator": "from dc:creator",
        "pubDate": "2024-01-03T00:00:00Z",
        "published": "2024-01-02T00:00:00Z",
        "dc:date": "2024-01-01T00:00:00Z",
        "media:content": {"url": "https://news.example/media.jpg"},
        "enclosure": {"url": "https://news.example/enclosure.png", "type": "image/png"},
    },
    {"title": "Content only", "link": "https://news.example/content", "content": "<p>c</p>"},
    {"title": "No content", "link": "https://news.example/none"},
    {"content": "<p>neither title nor link</p>"},
]


def item(n, content=None, **more):
    return {"title": f"T{n}", "link": f"l{n}", "content": content or f"content {n}"} | more


@pytest.fixture
def place(tmp_path):
    (tmp_path / "landing").mkdir()
    return str(tmp_path / "landing"), Store(str(tmp_path / "store"))


def run(spark, place, source=None, **kwargs):
    landing, store = place
    ingest.run_ingest(spark, landing, store, source, **kwargs)
    return store.articles(spark).orderBy("id").collect()


def titles(rows):
    return [r["title"] for r in rows]


def test_two_full_items(spark, place):
    land(place[0], "idnes.cz", TWO_FULL)
    rows = run(spark, place, started_at=utc("2024-02-03T04:05:06"))
    assert [(r["id"], r["title"], r["author"], r["imageUrl"]) for r in rows] == [
        (1, "Vlak stojí", "Eva Malá", "https://news.example/train.jpg"),
        (2, "Sníh v horách", "Petr Velký", "https://news.example/snow.png"),
    ]
    assert rows[0]["description"] == "Na trati spadl strom."
    assert rows[0]["created_date"] == dt.date(2024, 2, 3)
    times = place[1].articles(spark).select(plain_time("publishedAt"), plain_time("createdAt"))
    assert tuple(times.orderBy(F.col("id")).first()) == ("2024-01-01 12:00:00", "2024-02-03 04:05:06")


def test_same_feed_twice(spark, place):
    land(place[0], "idnes.cz", TWO_FULL[:1])
    assert len(run(spark, place)) == 1
    assert len(run(spark, place)) == 1


def test_complex_feed(spark, place):
    land(place[0], "idnes.cz", COMPLEX)
    rows = run(spark, place)
    assert titles(rows) == ["Everything", "Content only", "No content"]
    assert (rows[0]["author"], rows[0]["description"]) == ("from creator", "from content")
    assert rows[0]["imageUrl"] == "https://news.example/media.jpg"
    first = place[1].articles(spark).filter("id = 1").select(plain_time("publishedAt")).first()
    assert first[0] == "2024-01-03 00:00:00"
    assert rows[2]["description"] is None


def test_empty_content_and_bad_date(spark, place):
    empty = {"content": "", "summary": "", "description": ""}
    land(
        place[0],
        "idnes.cz",
        [
            {"title": "E", "link": "e"} | empty,
            {"title": "None", "link": "n"},
            item(1, pubDate="invalid-date-string"),
        ],
    )
    rows = run(spark, place)
    assert titles(rows) == ["E", "T1"]
    assert rows[0]["description"] is None and rows[1]["publishedAt"] is None
    report = place[1].runs(spark).filter("source = 'idnes.cz'").first()
    assert (report["items"], report["unparsed_dates"], report["new_articles"]) == (3, 1, 2)


def test_empty_content_keyed_by_url(spark, place):
    land(place[0], "idnes.cz", [{"title": "E", "link": "e"}, {"title": "F", "link": "f"}])
    assert len(run(spark, place, empty_content="key_by_url")) == 2


def test_first_wins_across_sources_and_fetches(spark, place):
    # Registry order is idnes.cz before novinky.cz, but an earlier fetch comes first.
    land(place[0], "novinky.cz", [item(1, "same"), item(2, "early")], fetch="1")
    land(place[0], "idnes.cz", [item(3, "same"), item(4, "x"), item(5, "x")], fetch="1")
    land(place[0], "idnes.cz", [item(6, "early")], fetch="2")
    rows = run(spark, place)
    assert [(r["id"], r["title"], r["source"]) for r in rows] == [
        (1, "T3", "idnes.cz"),
        (2, "T4", "idnes.cz"),
        (3, "T2", "novinky.cz"),
    ]


def test_failing_and_empty_feeds_do_not_stop_others(spark, place):
    land(place[0], "idnes.cz", "this is no feed")
    land(place[0], "novinky.cz", "<rss><channel><item><title>broken</title><link>z</item></channel></rss>")
    land(place[0], "blesk.cz", [])
    land(place[0], "e15.cz", [item(1)])
    land(place[0], "not-registered", [item(2)])
    assert titles(run(spark, place)) == ["T1"]
    runs = {r["source"]: r for r in place[1].runs(spark).filter("source <> 'all'").collect()}
    assert len(runs) == 29
    assert (runs["not-registered"]["status"], runs["not-registered"]["items"]) == ("unregistered", 1)
    assert runs["idnes.cz"]["status"] == "failed" and runs["idnes.cz"]["malformed"] == 1
    assert runs["blesk.cz"]["status"] == "empty"
    assert runs["blesk.cz"]["message"] == "No valid feed items found for blesk.cz"
    assert runs["e15.cz"]["status"] == "completed"
    assert runs["e15.cz"]["message"] == "Found 1 new articles from e15.cz."
    items = feeds.read_feeds(spark, place[0])
    assert {r["source"] for r in feeds.malformed_files(items).collect()} == {"idnes.cz", "novinky.cz"}
    assert feeds.good_items(items).count() == 2


def test_read_details(spark, place):
    land(
        place[0],
        "idnes.cz",
        [
            {
                "title": [" first ", "second"],
                "link": "l",
                "description": "\n <p>raw</p> ",
                "dc:creator": ["A", "B"],
                "media:content": [{"url": "u1"}, {"url": "u2"}],
                "summary": "",
            }
        ],
    )
    row = feeds.read_feeds(spark, place[0]).first()
    assert (row["title"], row["description"], row["dc:creator"]) == (" first ", "\n <p>raw</p> ", "A")
    assert row["media:content"]["_url"] == "u1"
    assert row["summary"] == "" and row["content"] is None
    assert (row["source"], row["fetch"], row["file_name"]) == ("idnes.cz", "1", "feed.xml")


def test_flat_landing_without_fetch_level(spark, place, tmp_path):
    folder = tmp_path / "landing" / "feed=idnes.cz"
    folder.mkdir()
    from feedfiles import rss

    (folder / "a.xml").write_text(rss([item(1)]))
    assert titles(run(spark, place)) == ["T1"]


def test_one_source(spark, place):
    land(place[0], "idnes.cz", [item(1)])
    land(place[0], "novinky.cz", [item(2)])
    assert titles(run(spark, place, "novinky.cz")) == ["T2"]
    assert titles(run(spark, place)) == ["T2", "T1"]
    with pytest.raises(ValueError, match="Invalid source: invalid-source. Valid sources are: idnes.cz, hn"):
        run(spark, place, "invalid-source")


def test_one_fetch(spark, place):
    land(place[0], "idnes.cz", [item(1)], fetch="2024-01-01T00")
    land(place[0], "idnes.cz", [item(2)], fetch="2024-01-01T01")
    assert titles(run(spark, place, fetch="2024-01-01T01")) == ["T2"]
    assert titles(run(spark, place)) == ["T2", "T1"]


def test_stream_in_small_batches(spark, place, tmp_path):
    landing, store = place
    for n, source in enumerate(["idnes.cz", "novinky.cz", "blesk.cz"]):
        land(landing, source, [item(n), item(9)])
    query = stream_ingest(spark, landing, store, str(tmp_path / "cp"), max_files_per_batch=2)
    query.awaitTermination()
    rows = store.articles(spark).orderBy("id").collect()
    assert [r["id"] for r in rows] == [1, 2, 3, 4]
    assert {r["title"] for r in rows} == {"T0", "T1", "T2", "T9"}
    runs = [r for r in store.runs(spark).collect() if r["source"] != "all"]
    # Two batches with items, and the sources without any at the end of the run.
    assert len({r["run_id"] for r in runs}) == 3
    assert sorted(r["status"] for r in runs) == ["completed"] * 3 + ["empty"] * 25


def test_every_stream_run_leaves_its_rows(spark, place, tmp_path):
    landing, store = place
    land(landing, "idnes.cz", [item(1)])
    for _ in range(2):
        stream_ingest(spark, landing, store, str(tmp_path / "cp")).awaitTermination()
    rows = store.runs(spark).collect()
    assert sorted(r["status"] for r in rows if r["source"] == "all") == ["completed"] * 2 + ["scheduled"] * 2
    assert sum(r["status"] == "empty" for r in rows) == 27 + 28


def test_half_parsed_items_are_set_aside_and_their_cure_is_taken(spark, place):
    def feed(*descriptions):
        body = "".join(
            f"<item><title>T{i}</title><link>l{i}</link><description>{d}</description></item>"
            for i, d in enumerate(descriptions)
        )
        return f"<rss><channel>{body}</channel></rss>"

    landing, store = place
    land(landing, "idnes.cz", feed("good", "a&nbsp;b", "x & y", "fine", "and so on&hellip;"))
    assert titles(run(spark, place)) == ["T0", "T3"]
    row = store.runs(spark).filter("source = 'idnes.cz'").first()
    assert (row["items"], row["malformed"], row["new_articles"]) == (2, 3, 2)
    held = store.quarantine(spark).orderBy("item_ord").collect()
    assert [(r["source"], r["file_name"]) for r in held] == [("idnes.cz", "feed.xml")] * 3
    assert [r["item_ord"] - held[0]["item_ord"] for r in held] == [0, 1, 3]
    land(landing, "idnes.cz", feed("good", "a b", "x &amp; y", "fine", "and so on..."), fetch="2")
    assert titles(run(spark, place, fetch="2")) == ["T0", "T3", "T1", "T2", "T4"]


def test_an_unreadable_file_fails_its_own_source_only(spark, place):
    landing, store = place
    land(landing, "idnes.cz", [item(1)])
    land(landing, "novinky.cz", [item(2)])
    folder = Path(landing) / "fetch=1" / "feed=blesk.cz"
    folder.mkdir(parents=True)
    (folder / "feed.xml.gz").write_bytes(b"\x1f\x8b\x08\x00 no gzip at all")
    assert titles(run(spark, place)) == ["T1", "T2"]
    rows = {r["source"]: r for r in store.runs(spark).collect() if r["status"] != "scheduled"}
    assert rows["blesk.cz"]["status"] == "failed"
    assert rows["blesk.cz"]["message"].startswith("Failed to scrape: ")
    assert rows["idnes.cz"]["status"] == rows["all"]["status"] == "completed"


def test_a_failure_is_told_in_full(spark, place, monkeypatch):
    def fail(*_, **__):
        raise RuntimeError("x" * 5000)

    monkeypatch.setattr(ingest.feeds, "read_feeds", fail)
    with pytest.raises(RuntimeError):
        ingest.run_ingest(spark, place[0], place[1])
    failed = place[1].runs(spark).filter("status = 'failed'").first()
    assert failed["message"] == "Failed to scrape: " + "x" * 5000


def test_a_run_leaves_nothing_staged(spark, place):
    from feedlake.staging import shared_dir

    land(place[0], "idnes.cz", [item(1), item(2)])
    before = set(Path(shared_dir(spark)).iterdir())
    assert len(run(spark, place)) == 2
    assert set(Path(shared_dir(spark)).iterdir()) == before


def test_one_source_opens_its_files_only(spark, place):
    land(place[0], "idnes.cz", [item(1)])
    land(place[0], "novinky.cz", [item(2)])
    plan = feeds.read_feeds(spark, place[0], "novinky.cz")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(feed" in plan


def test_run_records(spark, place):
    land(place[0], "idnes.cz", [item(1)])
    at = utc("2024-01-01T12:34:56")
    scheduled = ingest.run_record(spark, started_at=at).first()
    assert scheduled["run_id"] == f"scrape_{int(at.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)}"
    assert (scheduled["status"], scheduled["source"]) == ("scheduled", "all")
    assert scheduled["message"] == "Scraping scheduled for all sources"
    assert ingest.run_record(spark, "idnes.cz").first()["message"] == "Scraping scheduled for idnes.cz"
    done = ingest.run_ingest(spark, *place, source="idnes.cz", started_at=at).first()
    assert (done["status"], done["source"]) == ("completed", "idnes.cz")
    states = [r["status"] for r in place[1].runs(spark).filter("items IS NULL").collect()]
    assert sorted(states) == ["completed", "scheduled"]


def test_failure_is_recorded_and_raised(spark, place, tmp_path):
    with pytest.raises(Exception):
        ingest.run_ingest(spark, str(tmp_path / "missing"), place[1])
    states = sorted(r["status"] for r in place[1].runs(spark).collect())
    assert states == ["failed", "scheduled"]


def test_stream_takes_new_files_only_and_dedups_against_store(spark, place, tmp_path):
    landing, store = place
    checkpoint = str(tmp_path / "checkpoint")

    def stream(at=checkpoint):
        query = stream_ingest(spark, landing, store, at)
        query.awaitTermination()
        return store.articles(spark).orderBy("id").collect()

    land(landing, "idnes.cz", [item(1), item(2)])
    assert titles(stream()) == ["T1", "T2"]
    land(landing, "novinky.cz", [item(3), item(4, "content 1")], fetch="2")
    rows = stream()
    assert [(r["id"], r["title"]) for r in rows] == [(1, "T1"), (2, "T2"), (3, "T3")]
    assert len(stream()) == 3
    # A lost checkpoint replays everything; the store still takes nothing twice.
    assert len(stream(str(tmp_path / "fresh"))) == 3
    assert dedup.hash_uniqueness_audit(store.articles(spark)).count() == 0


def test_save_articles_keeps_given_times(spark, place):
    rows = spark.sql(
        """
        SELECT *, cast(t AS timestamp) AS createdAt FROM VALUES
          (1, 'A', 'u1', 'h1', 's', '2024-01-01 10:00:00'), (2, 'B', 'u2', 'h2', 's', NULL),
          (3, 'C', 'u3', 'h1', 's', NULL) AS v(ord, title, url, contentHash, source, t)
        """
    )
    ingest.save_articles(rows, place[1], "ord", as_of=utc("2024-05-01T00:00:00"))
    ingest.save_articles(rows, place[1], "ord", as_of=utc("2024-06-01T00:00:00"))
    saved = place[1].articles(spark).orderBy("id")
    assert [(r["id"], r["title"], str(r["created_date"])) for r in saved.collect()] == [
        (1, "A", "2024-01-01"),
        (2, "B", "2024-05-01"),
    ]


def test_save_articles_takes_ties_and_nulls_in_the_order(spark, place):
    rows = spark.sql(
        """
        SELECT * FROM VALUES (1, 't1', 'u1', 'h1', 's'), (1, 't2', 'u2', 'h2', 's'),
          (NULL, 't3', 'u3', 'h3', 's') AS v(ord, title, url, contentHash, source)
        """
    )
    ingest.save_articles(rows, place[1], "ord")
    saved = place[1].articles(spark).orderBy("id").collect()
    assert [r["id"] for r in saved] == [1, 2, 3] and saved[0]["title"] == "t3"
    assert sorted(titles(saved)) == ["t1", "t2", "t3"]


def test_reports(spark, place):
    store = place[1]
    as_of = utc("2024-01-01T12:34:56")
    before = reports.freshness_report(store.articles(spark), store.runs(spark), as_of).first()
    assert (before["articleCount"], before["lastRun"]) == (0, None)
    land(place[0], "idnes.cz", [item(1), item(2)])
    land(place[0], "blesk.cz", [item(3)])
    run(spark, place, started_at=as_of)
    after = reports.freshness_report(store.articles(spark), store.runs(spark), as_of).first()
    assert tuple(after) == (
        "2024-01-01T12:34:56.000Z",
        3,
        "2024-01-01T12:34:56.000Z",
        "2024-01-01T13:00:00.000Z",
    )
    status = reports.scraping_status(
        store.articles(spark), store.runs(spark), feed_registry(spark), as_of
    ).first()
    assert status["schedule"] == "0 * * * *" and status["totalArticles"] == 3
    assert status["articlesBySource"] == {"idnes.cz": 2, "blesk.cz": 1}
    assert status["sources"][:2] == ["idnes.cz", "hn.cz-byznys"] and len(status["sources"]) == 28
    by_source = reports.status_by_source(store.articles(spark), feed_registry(spark)).collect()
    assert tuple(by_source[0]) == ("idnes.cz", 2) and sum(r["articles"] for r in by_source) == 3
