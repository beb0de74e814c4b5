import re

import pytest
from feedfiles import article
from pyspark.sql import functions as F

from feedlake.sources import registry


def reg(spark, *rows):
    return registry.feed_registry(spark, rows)


def test_built_in_registry_is_sound(spark):
    feeds = registry.feed_registry(spark)
    assert feeds.count() == 28
    assert registry.registry_violations(feeds).collect() == []
    assert all(re.match("^https?://", url) for _, url in registry.FEEDS)
    as_map = registry.registry_map(feeds)
    assert as_map.first()["sources"] == dict(registry.FEEDS)
    names = as_map.selectExpr("map_keys(sources) AS names").first()["names"]
    assert names == [name for name, _ in registry.FEEDS]


def test_violations(spark):
    rows = reg(spark, ("a", "http://a"), ("a", "https://a"), ("", "http://b"), ("c", ""), ("d", "ftp://d"))
    found = {tuple(r) for r in registry.registry_violations(rows).collect()}
    assert found == {("a", "duplicate_name"), ("", "empty_name"), ("c", "empty_url"), ("d", "bad_url")}


def test_unknown_name_lists_the_known_in_order(spark):
    rows = reg(spark, ("z", "http://z"), ("a", "http://a"))
    with pytest.raises(ValueError, match="Invalid source: invalid-source. Valid sources are: z, a$"):
        registry.check_source("invalid-source", rows)
    for accepted in ("a", "", None):
        registry.check_source(accepted, rows)


def test_joins(spark):
    rows = reg(spark, ("a", "http://a"), ("b", "http://b"))
    items = article(spark, [(1, "t", "a"), (2, "t", "a"), (3, "t", "x")])
    joined = registry.with_registry(items, rows).select("id", "feed_url").collect()
    assert {tuple(r) for r in joined} == {(1, "http://a"), (2, "http://a")}
    assert [tuple(r) for r in registry.unknown_sources(items, rows).collect()] == [("x", 1)]
    assert [r[0] for r in registry.sources_without_items(items, rows).collect()] == ["b"]


def test_registry_beyond_the_broadcast_bound_joins_the_same(spark, monkeypatch):
    rows = reg(spark, ("a", "http://a"), ("b", "http://b"))
    items = article(spark, [(1, "t", "a"), (2, "t", "b"), (3, "t", "x")])
    monkeypatch.setattr(registry, "BROADCAST_SOURCES", 1)
    joined = registry.with_registry(items, rows)
    assert {r["id"] for r in joined.collect()} == {1, 2}


def test_double_names_are_refused_where_they_would_double_items(spark):
    rows = reg(spark, ("a", "http://a"), ("a", "http://b"))
    with pytest.raises(ValueError, match="unique"):
        registry.with_registry(article(spark, [(1, "t", "a")]), rows)
    assert registry.feed_registry(spark, []).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_a_large_registry_and_a_hot_source(spark, monkeypatch, request, how):
    monkeypatch.setattr(registry, "BROADCAST_SOURCES", 1000)
    # Nothing is broadcast but what is said to be.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    feeds = registry.feed_registry(spark, [(f"s{i}", f"http://s{i}") for i in range(3000)])
    names = ["s7" if n % 3 == 0 else None if n % 31 == 0 else f"s{n % 4000}" for n in range(12_000)]
    items = spark.createDataFrame(list(enumerate(names)), "n long, source string").repartition(12, "n")
    assert [r["source"] for r in registry.hot_sources(items).collect()] == ["s7"]
    joined = registry.with_registry(items, feeds, how)
    got = sorted((r["n"], r["source"], r["feed_url"]) for r in joined.collect())
    known = {f"s{i}" for i in range(3000)}
    want = [(n, s, f"http://{s}" if s in known else None) for n, s in enumerate(names) if how == "left" or s in known]
    assert got == want
    # The hot source's items meet their feed by broadcast, in the tasks that hold them.
    text = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" in text
    rows = joined.filter("source = 's7'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(rows) >= 8 and max(r["count"] for r in rows) < 1000
