"""Batches that count once, the hash index, and what the kept counts answer."""

import datetime as dt
import hashlib
import re
from pathlib import Path

import pytest
from feedfiles import land, utc
from pyspark.sql import functions as F
from test_ingest import item, run, titles

from feedlake.operators import catalog, dedup, stats
from feedlake.plans import ingest, reports
from feedlake.sources import batches, feeds, hash_index, store as store_module
from feedlake.sources.hash_index import HashIndex
from feedlake.sources.registry import feed_registry
from feedlake.sources.store import Store
from feedlake.streaming.ingest import stream_ingest


@pytest.fixture
def place(tmp_path):
    (tmp_path / "landing").mkdir()
    return str(tmp_path / "landing"), Store(str(tmp_path / "store"))


def report(store, spark):
    """Counters per source of all closed batches."""
    rows = store.runs(spark).filter("source <> 'all' AND items > 0")
    return sorted((r["source"], r["items"], r["malformed"], r["new_articles"]) for r in rows.collect())


def check_counts(spark, store):
    """The kept counts say the same as a scan of the articles."""
    articles = store.articles(spark)
    counts = store.counts(spark)
    assert stats.stored_total(counts).first()["total"] == articles.count()
    scanned = [tuple(r) for r in stats.sources_ranked(articles).collect()]
    assert [tuple(r) for r in stats.stored_by_source(counts).collect()] == scanned
    days = {r["created_date"]: r["count"] for r in articles.groupBy("created_date").count().collect()}
    assert {r["day"]: r["count"] for r in stats.stored_by_day(counts).collect()} == days


# --- batches -----------------------------------------------------------------


STEPS = ["articles", "hashes", "counts", "close"]


def break_at(monkeypatch, step):
    def fail(*_, **__):
        raise OSError(f"broke off at {step}")

    if step == "articles":
        monkeypatch.setattr(hash_index.HashIndex, "add", fail)
        monkeypatch.setattr(store_module.Store, "source_runs_path", property(fail))
    elif step == "hashes":
        monkeypatch.setattr(hash_index.HashIndex, "add", fail)
    elif step == "counts":
        monkeypatch.setattr(store_module.Store, "_write_kept", fail)
    else:
        monkeypatch.setattr(batches.Batches, "close", fail)


@pytest.mark.parametrize("step", STEPS)
def test_a_stream_batch_that_breaks_off_counts_once(spark, place, tmp_path, step):
    landing, store = place
    land(landing, "idnes.cz", [item(1), item(2), item(1)])
    land(landing, "novinky.cz", "<rss><channel><item><title>T</title><link>z</item></channel></rss>")
    checkpoint = str(tmp_path / "checkpoint")
    with pytest.MonkeyPatch.context() as patch:
        break_at(patch, step)
        with pytest.raises(Exception):
            stream_ingest(spark, landing, store, checkpoint).awaitTermination()
    # Nothing of the broken batch is seen.
    assert store.articles(spark).count() == 0 and report(store, spark) == []
    assert store.counts(spark).count() == 0 and store.quarantine(spark).count() == 0
    stream_ingest(spark, landing, store, checkpoint).awaitTermination()
    assert [(r["id"], r["title"]) for r in store.articles(spark).orderBy("id").collect()] == [(1, "T1"), (2, "T2")]
    assert report(store, spark) == [("idnes.cz", 3, 0, 2)]
    assert store.quarantine(spark).count() == 1
    check_counts(spark, store)
    assert dedup.hash_uniqueness_audit(store.articles(spark)).count() == 0


def test_a_closed_batch_is_not_done_again(spark, place):
    landing, store = place
    land(landing, "idnes.cz", [item(1), item(2)])
    items, registry = feeds.read_feeds(spark, landing), feed_registry(spark)
    at = utc("2024-02-03T04:05:06")
    first = ingest.ingest_items(items, store, registry, at, batch_key="k")
    want = sorted(map(tuple, first.collect()))
    again = ingest.ingest_items(items, store, registry, at + dt.timedelta(hours=1), batch_key="k")
    assert sorted(map(tuple, again.collect())) == want
    assert store.runs(spark).filter("new_articles > 0").count() == 1
    # Without a key a batch is one of its own, and stored hashes win.
    ingest.ingest_items(items, store, registry, at + dt.timedelta(hours=2))
    assert store.articles(spark).count() == 2
    manifests = store.batches(spark).all()
    assert [(m.batch, m.state, m.first_id, m.last_id, m.articles) for m in manifests] == [
        (1, "closed", 1, 2, 2),
        (2, "closed", 3, 2, 0),
    ]


def test_a_batch_that_broke_off_gives_way_to_another(spark, place):
    landing, store = place
    land(landing, "idnes.cz", [item(1), item(2), item(3)])
    land(landing, "novinky.cz", [item(4)], fetch="2")
    registry = feed_registry(spark)
    with pytest.MonkeyPatch.context() as patch:
        break_at(patch, "close")
        with pytest.raises(OSError):
            ingest.ingest_items(feeds.read_feeds(spark, landing, fetch="1"), store, registry, utc("2024-01-01T00:00:00"))
    assert [m.state for m in store.batches(spark).all()] == ["open"]
    assert store.batches(spark).all()[0].articles == 3
    ingest.ingest_items(feeds.read_feeds(spark, landing, fetch="2"), store, registry, utc("2024-01-02T00:00:00"))
    assert [(r["id"], r["title"]) for r in store.articles(spark).collect()] == [(1, "T4")]
    check_counts(spark, store)


def test_ids_run_on_without_reading_articles(spark, place):
    landing, store = place
    land(landing, "idnes.cz", [item(1), item(2)])
    assert titles(run(spark, place)) == ["T1", "T2"]
    # The articles are put out of reach: neither ids nor hashes come from them.
    batches.remove(spark, f"{store.articles_path}/batch=1")
    land(landing, "novinky.cz", [item(3), item(2)], fetch="2")
    assert [(r["id"], r["title"]) for r in run(spark, place, fetch="2")] == [(3, "T3")]


def test_old_manifests_go(spark, place, monkeypatch):
    monkeypatch.setattr(batches, "KEPT", 2)
    store = place[1]
    for n in range(4):
        store.batches(spark).open(batches.Manifest(n + 1, f"k{n}"))
        store.batches(spark).close(batches.Manifest(n + 1, f"k{n}"))
    assert [m.batch for m in store.batches(spark).all()] == [3, 4]


# --- files -------------------------------------------------------------------


def break_feeds(landing):
    land(landing, "idnes.cz", [item(1)])
    land(landing, "novinky.cz", [item(2)])
    for source, name, content in [
        ("blesk.cz", "feed.xml.gz", b"\x1f\x8b\x08\x00 no gzip at all"),
        ("e15.cz", "feed.xml", b"<?xml version='1.0'?><!-- x --><!DOCTYPE html><html><body>503 <rss/></body></html>"),
        ("e15.cz", "other.xml.bz2", b"BZh9 broken"),
    ]:
        folder = Path(landing) / "fetch=1" / f"feed={source}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(content)
    land(landing, "e15.cz", [item(3)], name="good.xml")


@pytest.mark.parametrize("how", ["batch", "stream"])
def test_broken_files_fail_alone(spark, place, tmp_path, how):
    landing, store = place
    break_feeds(landing)
    if how == "batch":
        ingest.run_ingest(spark, landing, store)
    else:
        stream_ingest(spark, landing, store, str(tmp_path / "cp"), max_files_per_batch=2).awaitTermination()
    assert sorted(titles(store.articles(spark).collect())) == ["T1", "T2", "T3"]
    rows = store.runs(spark).filter("status = 'failed'").collect()
    assert {r["source"] for r in rows} == {"blesk.cz", "e15.cz"}
    told = " ".join(r["message"] for r in rows)
    assert "Failed to scrape: feed.xml.gz" in told and all(r["message"].startswith("Failed to scrape: ") for r in rows)
    assert store.runs(spark).filter("status = 'completed' AND source = 'idnes.cz'").count() == 1
    assert store.runs(spark).filter("status = 'completed' AND source = 'all'").count() == 1


def test_packed_feeds_are_read(spark, place):
    import bz2
    import gzip

    from feedfiles import rss

    folder = Path(place[0]) / "fetch=1" / "feed=idnes.cz"
    folder.mkdir(parents=True)
    (folder / "a.xml.gz").write_bytes(gzip.compress(rss([item(1)]).encode()))
    (folder / "b.xml.bz2").write_bytes(bz2.compress(rss([item(2)]).encode()))
    (folder / "c d%.xml").write_text(rss([item(3)]))
    assert titles(run(spark, place)) == ["T1", "T2", "T3"]


def test_fetches_are_taken_in_order_of_their_numbers(spark, place):
    land(place[0], "idnes.cz", [item(1, "same")], fetch="10")
    land(place[0], "idnes.cz", [item(2, "same")], fetch="2")
    land(place[0], "idnes.cz", [item(3, "times")], fetch="2024-01-01T10%3A00")
    land(place[0], "idnes.cz", [item(4, "times")], fetch="2024-01-01T09%3A00")
    assert titles(run(spark, place)) == ["T2", "T4"]
    order = spark.createDataFrame([(t,) for t in ["", "9", "10", "010", "2024-01-01T9", "123456789012345678901"]], "t string")
    got = [r["t"] for r in order.orderBy(feeds.fetch_order(F.col("t")), "t").collect()]
    assert got == ["", "9", "010", "10", "2024-01-01T9", "123456789012345678901"]


def test_items_that_are_left_out_are_counted(spark, place):
    land(place[0], "idnes.cz", [item(1), {"title": "no link", "content": "c"}])
    run(spark, place)
    row = place[1].runs(spark).filter("source = 'idnes.cz'").first()
    assert (row["items"], row["invalid"], row["new_articles"]) == (2, 1, 1)


# --- hash index ----------------------------------------------------------------


def hashes(spark, numbers):
    rows = [(n, hashlib.sha256(str(n).encode()).hexdigest()) for n in numbers]
    return spark.createDataFrame(rows, "n long, contentHash string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_small_batch_reads_few_hashes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hash_index, "PARTITION_HASHES", 100)
    index = HashIndex(spark, str(tmp_path / "hashes"), [], [])
    n = 20_000
    index.add(1, hashes(spark, range(n)), n)
    index.merge(1)
    (made,) = index.runs
    assert made["bits"] == 8 and index.run(made).select("prefix").distinct().count() == 256
    # Most hashes of a new batch are nowhere: the filters leave next to no partition.
    batch = hashes(spark, range(n, n + 100))
    keys = batch.select(hash_index.hash_key(F.col("contentHash")).alias("hash_key"))
    maybe = {r["prefix"] for r in index.candidates(keys, made).collect()}
    read = index.run(made).where(F.col("prefix").isin(list(maybe) or [-1]))
    assert read.count() < n / 100
    found = index.known(keys, 100)
    assert "PartitionFilters" in plan(found) and re.search(r"PartitionFilters: \[[^\]]*prefix", plan(found)) or not maybe
    assert found.count() == 0
    # All hashes that are stored are found, by filters as well as by a whole read.
    some = hashes(spark, [3, 77, 19_999, n + 5])
    assert [r["n"] for r in index.new_against(some, 4).collect()] == [n + 5]
    many = hashes(spark, range(n - 5000, n + 10))
    assert sorted(r["n"] for r in index.new_against(many, 5010).collect()) == list(range(n, n + 10))
    paths = index.known(hashes(spark, [3]).select(hash_index.hash_key(F.col("contentHash")).alias("hash_key")), 1)
    assert len(paths.collect()) == 1 and re.search(r"PartitionFilters: \[[^\]]*prefix", plan(paths))


def test_runs_are_merged_by_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hash_index, "PARTITION_HASHES", 16)
    monkeypatch.setattr(hash_index, "RECENT_BATCHES", 2)
    monkeypatch.setattr(hash_index, "RUNS_PER_SIZE", 2)
    index = HashIndex(spark, str(tmp_path / "hashes"), [], [])
    for k in range(9):
        batch = hashes(spark, range(k * 20, k * 20 + 20))
        assert index.new_against(batch, 20).count() == 20
        index.add(k + 1, batch, 20)
        index.remove_gone()
        # What is stored is known, whatever has been merged.
        again = hashes(spark, range(0, k * 20 + 21))
        assert [r["n"] for r in index.new_against(again, k * 20 + 21).collect()] == [k * 20 + 20]
    assert len(index.runs) <= 4 and index.hashes == 180
    left = {p.name for p in (tmp_path / "hashes" / "runs").iterdir()}
    assert left == {f"run={r['run']}" for r in index.runs}


def test_keys_tell_hashes_from_other_texts(spark):
    texts = ["ab" * 32, "AB" * 32, "x", "", "é"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    keys = [bytes(r[0]) for r in frame.select(hash_index.hash_key(F.col("t"))).collect()]
    assert [len(k) for k in keys] == [32, 64, 1, 0, 2] and len(set(keys)) == 5


# --- counts, files and look-ups ----------------------------------------------


def saved(spark, store, rows):
    """Batches of (title, source, day) rows."""
    frame = spark.createDataFrame(
        [(k, t, "u", hashlib.sha256(t.encode()).hexdigest(), s, d) for k, (t, s, d) in enumerate(rows)],
        "ord long, title string, url string, contentHash string, source string, day string",
    )
    frame = frame.withColumn("createdAt", F.col("day").cast("timestamp")).drop("day")
    ingest.save_articles(frame, store, "ord")


def test_counts_are_merged_now_and_then(spark, place, monkeypatch):
    monkeypatch.setattr(store_module, "COUNT_TABLES", 2)
    store = place[1]
    for k in range(5):
        rows = [(f"t{k}-{n}", "ab"[n % 2], f"2024-01-0{1 + (k + n) % 3}") for n in range(4)]
        saved(spark, store, rows + [(f"t{k - 1}-0", "a", "2024-01-01")] * (k > 0))
        check_counts(spark, store)
    assert store.batches(spark).last().counts_base == 4
    today = stats.stored_stats(store.counts(spark), dt.date(2024, 1, 2)).collect()
    want = stats.article_stats(store.articles(spark), utc("2024-01-02T10:00:00")).filter("source IS NOT NULL")
    assert sorted(map(tuple, today)) == sorted(map(tuple, want.collect()))


def test_files_are_cut_by_bytes(spark, place, monkeypatch):
    monkeypatch.setattr(store_module, "FILE_BYTES", 200_000)
    monkeypatch.setattr(store_module, "BUCKET_IDS", 4)
    store = place[1]
    rows = [(f"short {n}", "a", "2024-01-01") for n in range(400)]
    rows += [(f"long {n} " + "word " * 2000, "a", "2024-01-01") for n in range(100)]
    saved(spark, store, rows)
    assert [r["id"] for r in store.articles(spark).orderBy("id").collect()] == list(range(1, 501))
    spans = store.spans(spark).orderBy("first_id").collect()
    sizes = [
        store.articles_in(spark, [(s["batch"], s["span"])]).agg(F.sum(F.length("title")), F.count("*")).first()
        for s in spans
    ]
    assert all(size < 200_000 + 4 * 11_000 for size, _ in sizes)
    # The short half lies in one file, the long half in several of few rows.
    assert sizes[0][1] >= 400 and len(sizes) >= 5 and all(n < 30 for _, n in sizes[1:-1])
    assert all(a["last_id"] + 1 == b["first_id"] for a, b in zip(spans, spans[1:]))
    check_counts(spark, store)


def test_look_ups_and_pages_open_their_own_files_only(spark, place, monkeypatch):
    monkeypatch.setattr(store_module, "FILE_BYTES", 2_000)
    monkeypatch.setattr(store_module, "BUCKET_IDS", 5)
    store = place[1]
    for k in range(3):
        saved(spark, store, [(f"t{k}-{n}", "rare" if n == 7 else "ab"[n % 2], "2024-01-01") for n in range(60)])
    articles = store.articles(spark)
    assert len(articles.inputFiles()) > 8
    found = store.article(spark, 77)
    assert len(found.inputFiles()) == 1
    assert catalog.stored_article(spark, store, 77) == articles.filter("id = 77").first()
    with pytest.raises(LookupError, match="Article not found"):
        catalog.stored_article(spark, store, 1000)
    for source in (None, "a", "rare", "none"):
        for page in (1, 2, 5, 30):
            got = catalog.stored_page(spark, store, page, 7, source)
            want = catalog.list_articles(articles, page, 7, source)
            assert got.rows.collect() == want.rows.collect()
            assert got.pagination.collect() == want.pagination.collect()
            assert len(got.rows.inputFiles()) <= 7
    with pytest.raises(ValueError):
        catalog.stored_page(spark, store, 0)


def test_a_search_opens_files_that_can_hold_its_text(spark, place, monkeypatch):
    monkeypatch.setattr(store_module, "FILE_BYTES", 3_000)
    monkeypatch.setattr(store_module, "BUCKET_IDS", 5)
    store = place[1]
    words = ["vlak", "SNÍH", "hora", "Rychle", "město", "zpráva", "x\\y", "100%"]
    rows = [(f"{words[n % 8]} {words[n // 8 % 8]} {n}", "ab"[n % 2], "2024-01-01") for n in range(600)]
    rows[333] = ("úplně Zebulon jiný", "a", "2024-01-01")
    for k in range(0, 600, 300):
        saved(spark, store, rows[k : k + 300])
    articles = store.articles(spark)
    assert len(articles.inputFiles()) >= 20
    for text in ("zebulon", "ZEBULON JIN", "vlak sn", "MĚSTO", "město", "x\\y", "0%", "_lak", "ab", "a", "", None, "nowhere", "n j"):
        got = sorted(r["id"] for r in store.search(spark, text).collect())
        assert got == sorted(r["id"] for r in catalog.search_title(articles, text).collect()), text
    assert len(store.search(spark, "zebulon").inputFiles()) < len(articles.inputFiles()) / 10
    page = catalog.list_articles(store.search(spark, "vlak"), 2, 5, "a")
    assert page.rows.collect() == catalog.list_articles(articles, 2, 5, "a", "vlak").rows.collect()
    # The letters outlive a merge of the kept tables.
    monkeypatch.setattr(store_module, "COUNT_TABLES", 2)
    saved(spark, store, [("Quentin", "a", "2024-01-01")])
    assert [r["title"] for r in store.search(spark, "zebul").collect()] == [rows[333][0]]
    assert [r["title"] for r in store.search(spark, "quent").collect()] == ["Quentin"]


# --- counts as rows and maps -------------------------------------------------


def test_no_source_and_a_source_of_any_name_stand_side_by_side(spark):
    rows = spark.createDataFrame([(1, None), (2, "(none)"), (3, "a"), (4, None)], "id long, source string")
    rows = rows.withColumn("createdAt", F.lit("2024-01-01").cast("timestamp"))
    runs = spark.createDataFrame([(utc("2024-01-01T10:00:00"),)], "started_at timestamp")
    as_of = utc("2024-01-01T12:30:00")
    got = {r["source"]: (r["articles"], r["totalArticles"]) for r in stats.ingest_stats_rows(rows, runs, as_of).collect()}
    assert got == {None: (2, 4), "(none)": (1, 4), "a": (1, 4)}
    record = stats.ingest_stats(rows, runs, as_of).first()
    assert (record["totalArticles"], record["articlesBySource"], record["withoutSource"]) == (4, {"(none)": 1, "a": 1}, 2)
    registry = feed_registry(spark, [("z", "http://z"), ("a", "http://a")])
    status = reports.scraping_status_rows(rows, runs, registry, as_of).collect()
    assert [(r["source_ord"], r["source"], r["articles"]) for r in status] == [
        (0, "z", 0), (1, "a", 1), (None, None, 2), (None, "(none)", 1),
    ]
    assert status[0]["nextRun"] == "2024-01-01T13:00:00.000Z"


def test_large_source_lists_are_refused_as_maps(spark, monkeypatch):
    monkeypatch.setattr(stats, "MAX_MAP_SOURCES", 3)
    counts = spark.range(5).select(F.col("id").cast("string").alias("source"), F.lit(1).cast("long").alias("count"))
    assert len(stats.as_map(counts.limit(3)).first()["bySource"]) == 3
    with pytest.raises(Exception, match="use the rows"):
        stats.as_map(counts).collect()


# --- Atom ----------------------------------------------------------------------


ATOM = """<?xml version="1.0" encoding="utf-8"?>
<feed xmlns="http://www.w3.org/2005/Atom" xmlns:media="http://search.yahoo.com/mrss/">
 <title>A feed</title><link href="https://news.example/"/>
 <entry><title>One</title><id>1</id>
  <link rel="enclosure" type="image/png" href="https://news.example/1.png"/>
  <link rel="alternate" href="https://news.example/1"/>
  <content type="html">&lt;p&gt;first&lt;/p&gt;</content>
  <author><name>Eva</name><uri>x</uri></author>
  <published>2024-01-02T03:04:05Z</published><updated>2024-02-02T00:00:00Z</updated></entry>
 <entry><title type="text">Two</title><link rel="self" href="https://news.example/self"/><link href="https://news.example/2"/>
  <summary>second</summary><updated>2024-01-03T00:00:00Z</updated>
  <media:content url="https://news.example/2.jpg"/></entry>
 <entry><title>Three</title><link rel="self" href="https://news.example/3"/><content>third</content></entry>
 <entry><title>No link</title><content>fourth</content></entry>
</feed>"""


@pytest.mark.parametrize("how", ["batch", "stream", "only"])
def test_atom_documents_are_stored(spark, place, tmp_path, how):
    landing, store = place
    land(landing, "idnes.cz", ATOM)
    if how != "only":
        land(landing, "novinky.cz", [item(1)])
    if how == "batch":
        ingest.run_ingest(spark, landing, store)
    else:
        stream_ingest(spark, landing, store, str(tmp_path / "cp")).awaitTermination()
    rows = store.articles(spark).filter("source = 'idnes.cz'").orderBy("id").collect()
    assert [(r["title"], r["url"], r["author"], r["description"], r["imageUrl"]) for r in rows] == [
        ("One", "https://news.example/1", "Eva", "first", "https://news.example/1.png"),
        ("Two", "https://news.example/2", None, "second", "https://news.example/2.jpg"),
        ("Three", "https://news.example/3", None, "third", None),
    ]
    dates = store.articles(spark).filter("source = 'idnes.cz'").orderBy("id").select(F.col("publishedAt").cast("string"))
    assert [r[0] for r in dates.collect()] == ["2024-01-02 03:04:05", "2024-01-03 00:00:00", None]
    row = store.runs(spark).filter("source = 'idnes.cz' AND items > 0").first()
    assert (row["status"], row["items"], row["invalid"], row["new_articles"]) == ("completed", 4, 1, 3)
    if how != "only":
        assert store.articles(spark).count() == 4
