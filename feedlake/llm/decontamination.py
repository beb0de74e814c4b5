"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Every item of a benchmark is cut into windows of consecutive normalised words. Their
64-bit hashes go to all tasks; each window of a training document is hashed and looked up,
and what is found is verified word for word. No document text is shuffled: a task sends on
one row per document with the places of its hits. Documents can then be dropped, or the
words of the hits removed from them.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import column, fresh
from feedlake.staging import broadcast_if_small, stage

WINDOW = 10
# A broadcast holds at most this many bytes of windows; more windows go in several passes.
BROADCAST_BYTES = 48 << 20
# What a window costs beside its words and item ids.
WINDOW_BYTES = 96
# Documents with hits are broadcast to the texts up to this many.
BROADCAST_DOCUMENTS = 100_000

# What is no word, after A-Z became a-z.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The borders between words and gaps in a text as it stands.
BORDER = r"(?<=[0-9A-Za-z\x{80}-\x{10FFFF}])(?=[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])|(?<=[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])(?=[0-9A-Za-z\x{80}-\x{10FFFF}])"
STARTS_WITH_WORD = r"^[0-9A-Za-z\x{80}-\x{10FFFF}]"


def words(text: Column) -> Column:
    """The normalised words of a text in order; none for null."""
    lowered = F.translate(
        F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase
    )
    return F.array_remove(F.split(lowered, GAP), "")


def _gram(start: Column, length: Column) -> Column:
    return F.array_join(F.slice("words", start + 1, length), " ")


def _hash(start: Column, length: Column) -> Column:
    return F.xxhash64(F.slice("words", start + 1, length))


def item_windows(
    items: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = WINDOW
) -> DataFrame:
    """(hash, gram, length, items): each distinct window of n item words and the items that
    hold it, written. An item of fewer words is one window; one without words has none.
    Items without an id count under no id, but their windows are found.
    """
    cut = items.select(
        column(items, id_col).cast("string").alias("item"),
        words(column(items, text_col)).alias("words"),
    ).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(n))
    placed = cut.select(
        "item", "words", length.alias("length"), F.explode(F.sequence(F.lit(0), F.size("words") - length)).alias("start")
    )
    start, length = F.col("start"), F.col("length")
    grams = placed.select(
        _hash(start, length).alias("hash"), _gram(start, length).alias("gram"), "length", "item"
    ).distinct()
    return stage(
        grams.groupBy("hash", "gram", "length").agg(F.sort_array(F.collect_list("item")).alias("items")),
        "item-windows",
    )


def _hits(texts: DataFrame, windows: DataFrame, lengths: list[int], keep: list[str]) -> DataFrame:
    """One row per hit (start, length, items) and, with nulls there, one per document."""
    first = lengths[0] if lengths else 0
    placed = texts.select("row", *keep, "words", F.posexplode_outer("words").alias("start", "_word"))
    placed = placed.select(
        "row", *keep, "words", F.coalesce("start", F.lit(0)).alias("start"),
        F.explode(F.array(*[F.lit(x) for x in lengths or [0]])).alias("length"),
    )
    start, length = F.col("start"), F.col("length")
    hashed = placed.withColumn(
        "hash", F.when((length > 0) & (start + length <= F.size("words")), _hash(start, length))
    )
    found = hashed.join(F.broadcast(windows.withColumnRenamed("length", "_length")), "hash", "left")
    hit = F.when(
        F.col("gram").isNotNull() & (F.col("_length") == length), _gram(start, length) == F.col("gram")
    )
    hit = F.coalesce(hit, F.lit(False))
    return found.where(hit | ((start == 0) & (length == first))).select(
        "row",
        *keep,
        F.size("words").alias("n_words"),
        F.when(hit, F.struct("start", "length")).alias("place"),
        F.when(hit, F.col("items")).alias("items"),
    )


def scan(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = WINDOW,
) -> DataFrame:
    """One row per document: the columns keep, n_words, n_hit, spans and items.

    spans are the runs (start, end) of words that lie in any occurrence of a test window,
    in words from 0, end exclusive; n_hit counts these words; items are the distinct ids, as
    sorted text, of the items with occurring windows.

    A null or empty text has no words and no hits. Repeated rows, and rows that share or lack
    an id, are documents of their own. Documents are scanned in time proportional to their
    words times the number of distinct window lengths (one, unless items are shorter than n);
    a very long text is read by one task, which holds its words once. An empty benchmark hits
    nothing, an empty table gives an empty result; columns not in keep are not read. Windows
    beyond BROADCAST_BYTES are looked up in several passes over the tokenised documents,
    parted by their hash, so that no broadcast outgrows the bound.
    """
    windows = item_windows(items, item_id, item_text, n)
    ids = F.aggregate("items", F.lit(0), lambda s, x: s + F.octet_length(x) + 24)
    size = F.octet_length("gram") + ids + F.lit(WINDOW_BYTES)
    total, lengths = windows.agg(F.sum(size.cast("long")), F.collect_set("length")).first()
    parts = max(1, -(-(total or 0) // BROADCAST_BYTES))
    names = [f"k{i}" for i in range(len(keep))]
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"),
        *[column(docs, c).alias(k) for c, k in zip(keep, names)],
        words(column(docs, text_col)).alias("words"),
    )
    if parts == 1:
        hits = _hits(texts, windows, sorted(lengths), names)
    else:
        # All passes must see the same row numbers.
        texts = stage(texts, "tokenised")
        hits = None
        for part in range(parts):
            some = windows.where(F.pmod("hash", F.lit(parts)) == part)
            passed = stage(_hits(texts, some, sorted(lengths), names), "hits")
            hits = passed if hits is None else hits.unionByName(passed)
    return _documents(hits, names, keep)


def _documents(hits: DataFrame, names: list[str], keep: tuple[str, ...]) -> DataFrame:
    found = hits.groupBy("row").agg(
        *[F.first(k).alias(k) for k in names],
        F.first("n_words").alias("n_words"),
        F.collect_set("place").alias("places"),
        F.collect_set("items").alias("items"),
    )
    inside = F.array_sort(
        F.array_distinct(
            F.flatten(
                F.transform("places", lambda p: F.sequence(p["start"], p["start"] + p["length"] - 1))
            )
        )
    )
    # A run starts where the word before is no hit and ends where the word after is none.
    found = found.withColumn("inside", inside)
    at = F.col("inside")
    starts = F.filter(at, lambda w, i: (i == 0) | (F.get(at, i - 1) != w - 1))
    ends = F.filter(at, lambda w, i: (i == F.size(at) - 1) | (F.get(at, i + 1) != w + 1))
    return found.select(
        *[F.col(k).alias(c) for k, c in zip(names, keep)],
        F.col("n_words").cast("long").alias("n_words"),
        F.size("inside").cast("long").alias("n_hit"),
        F.transform(
            F.arrays_zip(starts.alias("start"), ends.alias("end")),
            lambda s: F.struct(s["start"].alias("start"), (s["end"] + 1).alias("end")),
        ).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"),
    )


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the words of the spans and the gaps inside a span."""
    # Bound to variables, so that the pieces are cut once and sliced in place.
    def rest(pieces: Column) -> Column:
        lead = F.when(text.rlike(STARTS_WITH_WORD), 0).otherwise(1)
        begins = F.concat(
            F.array(F.lit(0)), F.transform(spans, lambda s: lead + s["end"] * 2 - 1)
        )
        ends = F.concat(
            F.transform(spans, lambda s: lead + s["start"] * 2), F.array(F.size(pieces))
        )
        kept = F.zip_with(
            begins, ends, lambda b, e: F.array_join(F.slice(pieces, b + 1, F.greatest(e - b, F.lit(0))), "")
        )
        return F.array_join(kept, "")

    return F.get(F.transform(F.array(F.split(text, BORDER)), rest), F.lit(0))


def clean(
    docs: DataFrame,
    items: DataFrame,
    remove: str = "documents",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = WINDOW,
) -> DataFrame:
    """The documents without benchmark text, in the columns of docs.

    remove="documents" drops every document with a hit; remove="spans" keeps it and removes
    the words of its hits, with the gaps between them. Other documents stay as they are.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be 'documents' or 'spans'")
    row, spans = fresh(docs, "_row", "_spans")
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    hit = scan(numbered, items, text_col, (row,), item_id, item_text, n)
    hit = stage(hit.where("n_hit > 0").select(row, F.col("spans").alias(spans)), "contaminated")
    hit = broadcast_if_small(hit, BROADCAST_DOCUMENTS)
    if remove == "documents":
        return numbered.join(hit, row, "left_anti").drop(row)
    joined = numbered.join(hit, row, "left")
    text = column(joined, text_col)
    cut = F.when(F.col(spans).isNull(), text).otherwise(without_spans(text, F.col(spans)))
    return joined.select(
        *[cut.alias(c) if c == text_col else column(joined, c) for c in docs.columns]
    )


def digests(scanned: DataFrame) -> DataFrame:
    """The contract's columns of a scan that kept doc_id."""
    return scanned.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _words_sql(table: str) -> str:
    lowered = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"[x FOR x IN string_split_regex({lowered}, '{GAP}') IF x <> ''] AS w FROM {table}"


ORACLE_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_words_sql("documents")}),
i AS (SELECT item_id::VARCHAR AS item, {_words_sql("benchmark")}),
g AS MATERIALIZED (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS n,
    array_to_string(w[s + 1 : s + least(len(w), {WINDOW})], ' ') AS gram
  FROM (SELECT *, unnest(range(len(w) - least(len(w), {WINDOW}) + 1)) AS s FROM i WHERE len(w) > 0)),
p AS (SELECT r, n, w, unnest(range(len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM g)),
h AS MATERIALIZED (
  SELECT DISTINCT r, s, n, item FROM (SELECT r, s, n, array_to_string(w[s + 1 : s + n], ' ') AS gram FROM p) JOIN g USING (n, gram)),
a AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS x FROM h) GROUP BY r),
b AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN a USING (r) LEFT JOIN b USING (r)
"""
