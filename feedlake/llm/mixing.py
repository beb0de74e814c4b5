"""Mixing sources to target weights: weighted sampling without replacement, in whole documents.

Each source gets a target of words, its share by weight of all words, at most
MAX_EPOCHS times its own; what is over is shared out again. A source then gives as many
complete epochs as fit. The rest of its target comes from the Efraimidis-Spirakis order:
every document draws an exponential key, divided by its quality weight, and documents are
taken by ascending key while the sum of their words stays within the budget. The last
document is the one, among those left, whose size comes nearest what is still missing.

Keys come from a hash of the id, so reruns agree. The running sum is made of sums of
KEY_BUCKETS ranges of the key and sums inside a range, so that no task holds a source.
Everything is built from Spark's own functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedlake.llm.common import column, fresh
from feedlake.operators.positions import with_positions
from feedlake.staging import broadcast_if_small, stage

WORD = r"[^\x20\x09-\x0D]+"
# Sources in order of their names take these weights in turn.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
# Weight of a document by its quality label; unlabelled ones weigh 1.
QUALITY_WEIGHTS = {1: 2.0, 0: 0.5}
SEED = 42
KEY_BUCKETS = 4096
# Per-source tables up to this many rows are broadcast, after counting.
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(ident: Column, seed: int = SEED) -> Column:
    """A number in (0, 1) from the id's MD5."""
    digest = F.md5(F.concat(F.coalesce(ident.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def quality_weights(labels: DataFrame, id_col: str = "doc_id", quality: str = "quality") -> DataFrame:
    """(id, weight): one row per labelled id, the better label where there are several."""
    value = F.lit(1.0)
    for label, weight in QUALITY_WEIGHTS.items():
        value = F.when(F.col("q") == label, weight).otherwise(value)
    best = labels.groupBy(column(labels, id_col).alias("id")).agg(F.max(column(labels, quality)).alias("q"))
    return best.where("id IS NOT NULL").select("id", value.alias("weight"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(src, source_size, target, epochs, budget) from (src, source, source_size).

    The driver holds three sums per round; a round adds the sources above their limit.
    """
    ranked = with_positions(sizes, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("position") % len(WEIGHTS) + 1).cast("int"))
    sources = stage(ranked.select("src", "source_size", weight.alias("w")), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    share, limited = 0.0, -1
    while True:
        above = F.col("w") * share > MAX_EPOCHS * F.col("source_size")
        n, given, weights = sources.agg(
            F.count_if(above),
            F.coalesce(F.sum(F.when(above, MAX_EPOCHS * F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("w"))), F.lit(0.0)),
        ).first()
        if n == limited or not weights:
            break
        share, limited = (total - given) / weights, n
    size = F.col("source_size")
    target = F.least(F.col("w") * share, MAX_EPOCHS * size.cast("double"))
    epochs = F.when(size > 0, F.least(F.floor(target / size), F.lit(MAX_EPOCHS))).otherwise(0)
    return (
        sources.withColumn("target", target)
        .withColumn("epochs", epochs.cast("long"))
        .withColumn("budget", F.col("target") - F.col("epochs") * size)
        .select("src", "source_size", "target", "epochs", "budget")
    )


def plan(rows: DataFrame) -> DataFrame:
    """How often each row of a mix is taken, from (row, id, source, size, weight).

    Adds source_size, target, copies and taken; row must be unique. Rows without words are
    taken with the epochs they fall in and count nothing.
    """
    key = -F.log(uniform(F.col("id"))) / F.col("weight")
    part = F.floor((1 - F.exp(-F.col("key"))) * KEY_BUCKETS)
    # A null source is a source of its own, after all others.
    src = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    keyed = rows.select("row", "id", "source", "size", src.alias("src"), key.alias("key"))
    keyed = stage(keyed.withColumn("part", part.cast("int")), "keyed")
    parts = stage(
        keyed.groupBy("src", "part").agg(F.first("source").alias("source"), F.sum("size").alias("words")),
        "key-ranges",
    )
    sizes = parts.groupBy("src").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    targets = stage(source_targets(sizes), "targets")
    n_sources = targets.count()

    earlier = W.partitionBy("src").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select("src", "part", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    starts = starts.join(broadcast_if_small(targets, BROADCAST_SOURCES, n_sources), "src")
    inside = W.partitionBy("src", "part").orderBy("key", "id", "size", "row")
    inside = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = keyed.join(starts, ["src", "part"]).withColumn(
        "chosen", F.col("start") + F.sum("size").over(inside) <= F.col("budget")
    )
    placed = stage(placed.drop("part", "start", "source"), "placed")

    missing = placed.groupBy("src").agg(
        (F.first("budget") - F.coalesce(F.sum(F.when(F.col("chosen"), F.col("size"))), F.lit(0))).alias("gap")
    )
    missing = stage(missing, "gaps")
    off = F.abs(F.col("size") - F.col("gap"))
    last = (
        placed.where(~F.col("chosen"))
        .join(broadcast_if_small(missing, BROADCAST_SOURCES, n_sources), "src")
        .where(off < F.col("gap"))
        .groupBy("src")
        .agg(F.min(F.struct(off.alias("off"), "key", "id", "size", "row")).alias("best"))
        .select(F.col("best.row").alias("row"), F.lit(1).alias("last"))
    )
    last = stage(last, "last")
    joined = placed.join(broadcast_if_small(last, BROADCAST_SOURCES, n_sources), "row", "left")
    copies = F.col("epochs") + F.col("chosen").cast("long") + F.coalesce("last", F.lit(0))
    return joined.withColumn("copies", copies).select(
        "row", "id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def _rows(docs: DataFrame, row: Column, weights: DataFrame | None, id_col, text_col, source_col) -> DataFrame:
    rows = docs.select(
        row.alias("row"),
        column(docs, id_col).alias("id"),
        column(docs, source_col).alias("source"),
        n_words(column(docs, text_col)).alias("size"),
    )
    if weights is None:
        return rows.withColumn("weight", F.lit(1.0))
    joined = rows.join(weights, "id", "left")
    return joined.withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per row of docs: id, size, source_size, target, taken, copies.

    weights holds (id, weight) with unique ids; documents it lacks weigh 1. A null text has
    size 0, a null source is a source of its own after all others, and rows that repeat an
    id are taken one by one. An empty table gives an empty result; extra columns are not read.
    """
    rows = _rows(docs, F.monotonically_increasing_id(), weights, id_col, text_col, source_col)
    return plan(rows).select(
        F.col("id").alias(id_col), "size", "source_size", "target", "taken", "copies"
    )


def mixed(
    docs: DataFrame,
    weights: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs."""
    (row,) = fresh(docs, "mix_row")
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    rows = _rows(numbered, F.col(row), weights, id_col, text_col, source_col)
    (copies,) = fresh(numbered, "mix_copies")
    taken = plan(rows).where("copies > 0").select(F.col("row").alias(row), F.col("copies").alias(copies))
    joined = numbered.join(taken, row)
    return joined.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(
        *[column(joined, c) for c in docs.columns]
    )


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size
  FROM documents),
q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
k AS (
  SELECT d.*, -ln((CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':42'), 1, 13) AS BIGINT) + 0.5)
    / 4503599627370496.0::DOUBLE) / CASE quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5 ELSE 1 END AS key
  FROM d LEFT JOIN q USING (doc_id)),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
  FROM d GROUP BY source),
f AS (
  SELECT *, 3 * source_size / w AS full_at,
    ((sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))::BIGINT::DOUBLE
     / (sum(w) OVER () - coalesce(sum(w) OVER before, 0))) AS share
  FROM s WINDOW before AS (ORDER BY 3 * source_size / w, source
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size,
    least(w * (SELECT arg_min(share, full_at) FROM f WHERE share <= full_at), 3.0 * source_size) AS target
  FROM f),
b AS (
  SELECT *, least(floor(target / source_size), 3)::BIGINT AS epochs,
    target - least(floor(target / source_size), 3) * source_size AS budget FROM t),
p AS (
  SELECT k.*, source_size, target, epochs, budget,
    sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= budget AS chosen
  FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source),
g AS (
  SELECT source, first(budget) - coalesce(sum(size) FILTER (chosen), 0)::DOUBLE AS gap
  FROM p GROUP BY source),
l AS (
  SELECT p.source, arg_min(doc_id, struct_pack(a := abs(size - gap), b := key)) AS doc_id
  FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source
  WHERE NOT chosen AND abs(size - gap) < gap GROUP BY p.source)
SELECT p.doc_id, size::BIGINT AS size, source_size, target::DOUBLE AS target,
  ((epochs + chosen::INT + (l.doc_id IS NOT NULL)::INT) * size)::BIGINT AS taken,
  (epochs + chosen::INT + (l.doc_id IS NOT NULL)::INT)::BIGINT AS copies
FROM p LEFT JOIN l ON p.doc_id = l.doc_id
"""
