"""Hot keys, both sides of every size bound, and the plans that matter at size."""

import datetime as dt
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from feedlake.operators import catalog, dedup, positions
from feedlake.plans import driver_queries, driver_tables, ingest
from feedlake.sources import store as store_module
from feedlake.sources.registry import feed_registry
from feedlake.sources.store import Store
from feedlake.schema import ITEM

SF_DIR = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def hot_rows(spark):
    """9,000 rows over 12 tasks; a third share one key, the rest repeat now and then."""
    rng = random.Random(7)
    rows = [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(4000)}") for i in range(9000)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "n long, contentHash string").repartition(12)


def test_first_wins_with_a_hot_key(hot_rows):
    rows, frame = hot_rows
    want = {}
    for n, key in sorted(rows):
        want.setdefault(key, n)
    got = {r["contentHash"]: r["n"] for r in dedup.first_wins(frame, ["n"]).collect()}
    assert got == want


def test_a_hot_key_shrinks_before_the_shuffle(hot_rows):
    text = plan(dedup.first_wins(hot_rows[1], ["n"]))
    above, below = text.split("Exchange hashpartitioning(contentHash", 1)
    assert "Partial" in below and "Final" in above


@pytest.mark.parametrize("batch_rows", [None, 10, dedup.BROADCAST_ROWS + 1])
def test_new_against_on_both_sides_of_the_bound(spark, hot_rows, batch_rows):
    rows, batch = hot_rows
    known = {f"k{i}" for i in range(0, 4000, 2)}
    history = spark.createDataFrame([(k,) for k in known for _ in range(2)], "contentHash string")
    for hot in (False, True):
        past = history.union(spark.createDataFrame([("hot",)] * 50, "contentHash string")) if hot else history
        want = sorted(n for n, k in rows if k not in known and not (hot and k == "hot"))
        got = sorted(r["n"] for r in dedup.new_against(batch, past, batch_rows=batch_rows).collect())
        assert got == want


def test_small_batch_does_not_shuffle_the_history(spark, hot_rows):
    history = spark.createDataFrame([("a",)], "contentHash string")
    text = plan(dedup.new_against(hot_rows[1], history, batch_rows=10))
    assert "LeftSemi, BuildRight" in text


def test_positions_are_dense_and_ordered(hot_rows):
    rows, frame = hot_rows
    placed = positions.with_positions(frame, "contentHash", F.desc("n")).collect()
    got = [(r["contentHash"], r["n"]) for r in sorted(placed, key=lambda r: r["position"])]
    assert got == sorted(((k, n) for n, k in rows), key=lambda e: (e[0], -e[1]))
    assert sorted(r["position"] for r in placed) == list(range(len(rows)))


def test_ids_run_on(hot_rows):
    rows, frame = hot_rows
    got = {r["n"]: r["id"] for r in positions.assign_ids(frame, "n", last_id=100).collect()}
    assert got == {n: n + 101 for n, _ in rows}


def test_no_rows_get_no_positions(hot_rows):
    assert positions.with_positions(hot_rows[1].limit(0), "n").collect() == []


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("broadcast_rows", [dedup.BROADCAST_ROWS, 10])
def test_ingest_runs_against_a_plain_loop(spark, tmp_path, monkeypatch, broadcast_rows):
    """Two batches where one text and one source hold a third of all items each."""
    monkeypatch.setattr(dedup, "BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(store_module, "FILE_BYTES", 12_000)
    monkeypatch.setattr(store_module, "BUCKET_IDS", 10)
    registry = feed_registry(spark, [(f"s{i}", f"http://s{i}") for i in range(6)])
    store = Store(str(tmp_path / "store"))
    rng = random.Random(11)
    stored = {}
    fields = [f.name for f in ITEM.fields]
    for batch in range(2):
        items = []
        for n in range(1200):
            source = "s0" if rng.random() < 0.33 else f"s{rng.randrange(7)}"
            content = "hot" if rng.random() < 0.33 else f"text {rng.randrange(1500)}"
            title = "" if rng.random() < 0.05 else f"t{batch}-{n}"
            items.append((str(n % 2), source, f"f{n % 3}", n, title, content))
        rows = []
        for fetch, source, file_name, n, title, content in items:
            item = {"title": title, "link": "l", "content": content}
            rows.append((fetch, source, file_name, n, False, *[item.get(f) for f in fields]))
        schema = "fetch string, source string, file_name string, item_ord long, malformed boolean"
        frame = spark.createDataFrame(rows, _with_items(spark, schema)).repartition(7)
        for fetch, source, file_name, n, title, content in sorted(items, key=lambda e: e[:4]):
            if title and source != "s6" and _sha(content) not in stored:
                stored[_sha(content)] = (len(stored) + 1, title, source)
        report = ingest.ingest_items(frame, store, registry)
        states = {r["source"]: r["status"] for r in report.collect()}
        assert states == {f"s{i}": "completed" for i in range(6)} | {"s6": "unregistered"}
    got = {r["contentHash"]: (r["id"], r["title"], r["source"]) for r in store.articles(spark).collect()}
    assert got == stored
    assert len(store.articles(spark).inputFiles()) >= len(stored) // 100


def _with_items(spark, schema):
    fields = list(spark.createDataFrame([], schema).schema.fields) + list(ITEM.fields)
    return type(ITEM)(fields)


def test_page_bounds_reach_the_scan(spark):
    text = plan(driver_queries.articles_by_source_page(spark, SF_DIR))
    for bound in ("EqualTo(source,src3)", "GreaterThanOrEqual(doc_id,0)", "LessThanOrEqual(doc_id,65535)"):
        assert bound in text
    # The page is found without reading the texts.
    articles = catalog.by_source(driver_tables.document_articles(spark, SF_DIR), "src3")
    counts = plan(catalog.counts_per_span(articles))
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in counts and "partial_count" in counts


def test_day_filter_prunes_stored_partitions(spark, tmp_path):
    store = Store(str(tmp_path / "store"))
    rows = spark.sql(
        """
        SELECT n AS ord, 't' AS title, 'u' AS url, concat('h', n) AS contentHash, 's' AS source,
               timestamp '2024-01-01' + make_dt_interval(cast(n AS int)) AS createdAt
        FROM (SELECT id AS n FROM range(5))
        """
    )
    ingest.save_articles(rows, store, "ord")
    articles = store.articles(spark)
    found = catalog.created_on(articles, "2024-01-03")
    assert [r["id"] for r in found.collect()] == [3]
    assert re.search(r"PartitionFilters: \[[^\]]*isnotnull\(created_date", plan(found))
    recent = catalog.created_recently(articles, 1, dt.datetime(2024, 1, 5, 9))
    assert sorted(r["id"] for r in recent.collect()) == [4, 5]
    assert re.search(r"PartitionFilters: \[[^\]]*isnotnull\(created_date", plan(recent))


def test_time_filter_is_pushed(spark):
    text = plan(driver_queries.articles_by_date(spark, SF_DIR))
    assert "GreaterThanOrEqual(ts," in text and "LessThan(ts," in text


def test_counts_read_no_texts(spark):
    text = plan(driver_queries.count_by_source(spark, SF_DIR))
    assert "ReadSchema: struct<event_type:string>" in text and "partial_count" in text
