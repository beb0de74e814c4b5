"""The feed registry: which sources are read and where each feed lives."""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.staging import stage

# A registry up to this size, some 20 MB, is broadcast.
BROADCAST_SOURCES = 100_000
# A source is hot with more items than this part of a shuffle partition's share.
HOT_PARTS = 4

# The feeds in reading order, as (name, url).
FEEDS = [
    ("idnes.cz", "http://servis.idnes.cz/rss.asp"),
    ("hn.cz-byznys", "https://byznys.hn.cz/?m=rss"),
    ("hn.cz-domaci", "https://domaci.hn.cz/?m=rss"),
    ("hn.cz-zahranicni", "https://zahranicni.hn.cz/?m=rss"),
    ("hn.cz-nazory", "https://nazory.hn.cz/?m=rss"),
    ("hn.cz-tech", "https://tech.hn.cz/?m=rss"),
    ("aktualne.cz", "https://www.aktualne.cz/rss/?BBX_DEVICE=desktop&BBX_REAL_DEVICE=desktop"),
    ("novinky.cz", "https://www.novinky.cz/rss"),
    ("blesk.cz", "https://www.blesk.cz/rss"),
    ("ct24.cz", "https://ct24.ceskatelevize.cz/rss"),
    ("ceskatelevize.cz", "https://www.ceskatelevize.cz/rss/"),
    ("e15.cz", "https://www.e15.cz/rss"),
    ("lidovky.cz", "https://www.lidovky.cz/rss.aspx"),
    ("sport.cz", "https://www.sport.cz/rss"),
    ("lupa.cz", "https://www.lupa.cz/n/rss/"),
    ("zive.cz", "https://www.zive.cz/rss"),
    ("super.cz", "https://www.super.cz/rss"),
    ("reflex.cz", "https://www.reflex.cz/rss"),
    ("forbes.cz", "https://www.forbes.cz/rss"),
    ("echo24.cz", "https://echo24cz.webnode.cz/rss/all.xml"),
    ("denik.cz", "https://www.denik.cz/rss/zpravy.html"),
    ("irozhlas.cz", "https://www.irozhlas.cz/rss/irozhlas"),
    ("irozhlas-domov", "https://www.irozhlas.cz/rss/irozhlas/section/zpravy-domov"),
    ("irozhlas-svet", "https://www.irozhlas.cz/rss/irozhlas/section/zpravy-svet"),
    (
        "irozhlas-veda-technologie",
        "https://www.irozhlas.cz/rss/irozhlas/section/veda-technologie",
    ),
    ("ceskenoviny-vse", "https://www.ceskenoviny.cz/sluzby/rss/zpravy.php"),
    ("ceskenoviny-cr", "https://www.ceskenoviny.cz/sluzby/rss/cr.php"),
    ("ceskenoviny-svet", "https://www.ceskenoviny.cz/sluzby/rss/svet.php"),
]

# Fixed value: what a feed url must look like.
URL_PATTERN = "^https?://"

REGISTRY_SCHEMA = pa.schema(
    [("source_ord", pa.int64()), ("source", pa.string()), ("url", pa.string())]
)


def feed_registry(spark: SparkSession, feeds=None) -> DataFrame:
    """Registry as (source_ord, source, url); source_ord is the reading order.

    Made from an Arrow table, so that Spark knows how small it is when it plans joins.
    """
    feeds = FEEDS if feeds is None else feeds
    rows = [
        {"source_ord": i, "source": name, "url": url} for i, (name, url) in enumerate(feeds)
    ]
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=REGISTRY_SCHEMA))


def registry_map(registry: DataFrame) -> DataFrame:
    """One row with the registry as a name -> url map, for registries of feed-list size."""
    entries = F.transform(
        F.array_sort(F.collect_list(F.struct("source_ord", "source", "url"))),
        lambda e: F.struct(e["source"], e["url"]),
    )
    return registry.agg(F.map_from_entries(entries).alias("sources"))


def check_source(source: str | None, registry: DataFrame) -> None:
    """Reject a name the registry lacks; no name at all means every source."""
    if not source:
        return
    if registry.filter(F.col("source") == source).isEmpty():
        # Names are read only to word the error; a registry is a short feed list.
        ordered = registry.orderBy("source_ord").select("source")
        names = ", ".join(r["source"] for r in ordered.toLocalIterator())
        raise ValueError(f"Invalid source: {source}. Valid sources are: {names}")


def registry_violations(registry: DataFrame) -> DataFrame:
    """One row per broken rule and source: duplicate_name, empty_name, empty_url, bad_url."""
    duplicates = (
        registry.groupBy("source")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .select("source", F.lit("duplicate_name").alias("rule"))
    )
    url = F.coalesce("url", F.lit(""))
    broken = F.array_compact(
        F.array(
            F.when(F.coalesce("source", F.lit("")) == "", "empty_name"),
            F.when(url == "", "empty_url"),
            F.when((url != "") & ~url.rlike(URL_PATTERN), "bad_url"),
        )
    )
    per_row = registry.select("source", F.explode(broken).alias("rule")).distinct()
    return duplicates.unionByName(per_row)


def with_registry(items: DataFrame, registry: DataFrame, how: str = "inner") -> DataFrame:
    """Items of registered sources, with the feed url and reading order.

    With how="left" items of other sources stay, without both. A registry beyond
    BROADCAST_SOURCES is joined by a shuffle, but for the sources that hold many items.
    """
    rows, names = registry.agg(F.count("*"), F.count_distinct("source")).first()
    if rows != names:
        raise ValueError("Registry names must be set and unique")
    feeds = registry.select("source", F.col("url").alias("feed_url"), "source_ord")
    if rows <= BROADCAST_SOURCES:
        return items.join(F.broadcast(feeds), "source", how)
    return _with_large_registry(items, feeds, how)


def hot_sources(items: DataFrame) -> DataFrame:
    """Sources with more items than a shuffle partition should get: no more of them than HOT_PARTS
    times the partitions. Written."""
    parts = HOT_PARTS * int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = stage(items.groupBy("source").agg(F.count("*").alias("n")), "items-per-source")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return counts.filter(F.col("source").isNotNull() & (F.col("n") * parts > total)).select("source")


def _with_large_registry(items: DataFrame, feeds: DataFrame, how: str) -> DataFrame:
    """The items of hot sources stay where they are and get their few feeds by broadcast;
    all others are shuffled, no source of them more than a share of a partition."""
    (hot_mark,) = [c for c in ("_hot", "__hot") if c not in items.columns][:1]
    hot = hot_sources(items)
    marked = items.join(F.broadcast(hot.withColumn(hot_mark, F.lit(True))), "source", "left")
    # Items without a source match nothing and are not shuffled either.
    stays = F.col(hot_mark).isNotNull() | F.col("source").isNull()
    hot_feeds = feeds.join(F.broadcast(hot), "source", "left_semi")
    near = marked.filter(stays).join(F.broadcast(hot_feeds), "source", how)
    far = marked.filter(~stays).join(feeds, "source", how)
    return near.unionByName(far).drop(hot_mark)


def unknown_sources(items: DataFrame, registry: DataFrame) -> DataFrame:
    """Source names of items that the registry lacks, with their item counts."""
    # Counting first leaves one row per name, so a hot name cannot skew the join.
    counts = items.groupBy("source").agg(F.count("*").alias("items"))
    return counts.join(registry.select("source"), "source", "left_anti")


def items_per_source(items: DataFrame, registry: DataFrame) -> DataFrame:
    """Item count of every registered source, 0 where its feed had none."""
    counts = items.groupBy("source").agg(F.count("*").alias("items"))
    return registry.join(counts, "source", "left").select(
        "source_ord", "source", F.coalesce("items", F.lit(0).cast("long")).alias("items")
    )


def sources_without_items(items: DataFrame, registry: DataFrame) -> DataFrame:
    return items_per_source(items, registry).filter("items = 0").select("source")
