"""The stored tables: articles, their hashes and counts, and ingest runs.

Articles lie under batch=<number>/span=<number>/created_date=<UTC day>. A span holds a
run of ids whose texts make up about FILE_BYTES, and is one file a day. Counts per
span, day and source are kept beside them with each batch; they say where an id or a page lies,
so look-ups, pages and totals need no other article files. The letters of the titles are kept
as well, so that a search opens only files that can hold its text.
"""

import datetime as dt
import string
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake.functions.text import contains_pattern
from feedlake.schema import ARTICLE, CREATED_DATE, RUN
from feedlake.sources.batches import Batches, Manifest, remove
from feedlake.sources.hash_index import HASH, HashIndex

# Text of one file, and the ids whose sizes are added up together to cut files.
FILE_BYTES = 256 << 20
BUCKET_IDS = 256
# Tables of counts, one a batch, that are merged into one.
COUNT_TABLES = 64

BATCH, SPAN, BYTES = "batch", "span", "bytes"

QUARANTINE = T.StructType(
    [
        T.StructField(name, T.LongType() if name == "item_ord" else T.StringType())
        for name in ("run_id", "source", "fetch", "file_name", "item_ord")
    ]
)

STORED_ARTICLE = T.StructType(
    list(ARTICLE.fields) + [T.StructField(CREATED_DATE, T.DateType())]
)

COUNTS = T.StructType(
    [
        T.StructField(BATCH, T.LongType()),
        T.StructField(SPAN, T.IntegerType()),
        T.StructField(CREATED_DATE, T.DateType()),
        T.StructField("source", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("first_id", T.LongType()),
        T.StructField("last_id", T.LongType()),
    ]
)


# Hashed runs of three letters that the titles of a span hold: at most GRAM_CODES numbers.
GRAM_CODES = 1 << 20
GRAMS = T.StructType(
    [
        T.StructField(BATCH, T.LongType()),
        T.StructField(SPAN, T.IntegerType()),
        T.StructField("codes", T.ArrayType(T.IntegerType())),
    ]
)


def gram_codes(rows: DataFrame, value: str, *keep: str) -> DataFrame:
    """Distinct (*keep, code): the hashed runs of three characters of value, A-Z as a-z."""
    folded = F.translate(F.col(value), string.ascii_uppercase, string.ascii_lowercase)
    letters = rows.select(*keep, F.split(folded, "").alias("_letters"))
    placed = letters.select(*keep, "_letters", F.posexplode("_letters").alias("_at", "_first"))
    later = [F.get("_letters", F.col("_at") + k) for k in (1, 2)]
    code = F.pmod(F.xxhash64("_first", *later), F.lit(GRAM_CODES)).cast("int")
    whole = later[1].isNotNull() & (later[1] != "")
    return placed.filter(whole).select(*keep, code.alias("code")).distinct()


def _read(spark: SparkSession, schema: T.StructType, *paths: str, base: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema)
    if base is not None:
        reader = reader.option("basePath", base)
    try:
        return reader.parquet(*paths)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _in_batches(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])


@dataclass(frozen=True)
class Store:
    """Folder of one article table. One writer at a time; readers as many as you like.

    Readers see the batches that are closed when they ask.
    """

    path: str

    @property
    def articles_path(self) -> str:
        return f"{self.path}/articles"

    @property
    def runs_path(self) -> str:
        return f"{self.path}/ingest_runs"

    @property
    def source_runs_path(self) -> str:
        return f"{self.path}/source_runs"

    @property
    def quarantine_path(self) -> str:
        return f"{self.path}/quarantine"

    def batches(self, spark: SparkSession) -> Batches:
        return Batches(spark, f"{self.path}/batches")

    def hash_index(self, spark: SparkSession, at: Manifest | None = None) -> HashIndex:
        at = self.batches(spark).last() if at is None else at
        return HashIndex(spark, f"{self.path}/hashes", at.runs, at.recent)

    def _closed(self, spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
        last = self.batches(spark).last().batch
        rows = _read(spark, _in_batches(schema), path)
        return rows.filter(F.col(BATCH) <= last).drop(BATCH, SPAN)

    def quarantine(self, spark: SparkSession) -> DataFrame:
        """Places of the items that could not be read, by run."""
        return self._closed(spark, self.quarantine_path, QUARANTINE)

    def articles(self, spark: SparkSession) -> DataFrame:
        return self._closed(spark, self.articles_path, STORED_ARTICLE)

    def runs(self, spark: SparkSession) -> DataFrame:
        """Rows of whole runs, and the rows per source of closed batches."""
        return _read(spark, RUN, self.runs_path).unionByName(
            self._closed(spark, self.source_runs_path, RUN)
        )

    def append_runs(self, runs: DataFrame) -> None:
        # A run adds one row per source at most, so one small file.
        runs.coalesce(1).write.mode("append").parquet(self.runs_path)

    # --- counts and what they tell ------------------------------------------

    def _kept(self, spark: SparkSession, name: str, schema: T.StructType, at: Manifest) -> DataFrame:
        """A table kept with the batches: one part up to the last merge, and one for every batch since."""
        parts = [f"{self.path}/{name}/batch={n}" for n in range(at.counts_base + 1, at.batch + 1)]
        if at.counts_base:
            parts.append(f"{self.path}/{name}/upto={at.counts_base}")
        return _read(spark, schema, *parts) if parts else spark.createDataFrame([], schema)

    def counts(self, spark: SparkSession) -> DataFrame:
        """Articles per batch, span, day and source, with the ids they lie between."""
        return self._kept(spark, "counts", COUNTS, self.batches(spark).last())

    def search(self, spark: SparkSession, text: str | None) -> DataFrame:
        """Articles whose title contains the text, ignoring ASCII case, as in the catalog.

        Only files whose titles hold every run of three letters of the text are opened. Texts with
        a wildcard (% or _) or of fewer than three letters are looked for in all files.
        """
        if not text:
            return self.articles(spark)
        sought = contains_pattern(F.col("title"), text)
        if len(text) < 3 or "%" in text or "_" in text:
            return self.articles(spark).filter(sought)
        asked = gram_codes(spark.range(1).select(F.lit(text).alias("text")), "text")
        codes = F.array(*[F.lit(r["code"]) for r in asked.collect()])
        grams = self._kept(spark, "grams", GRAMS, self.batches(spark).last())
        able = grams.filter(F.size(F.array_except(codes, F.col("codes"))) == 0).select(BATCH, SPAN)
        return self.articles_in(spark, [tuple(r) for r in able.collect()]).filter(sought)

    def spans(self, spark: SparkSession, source: str | None = None) -> DataFrame:
        """(batch, span, first_id, last_id, n): where ids lie, and how many are of the source."""
        counts = self.counts(spark)
        n = F.col("n") if not source else F.when(F.col("source") == source, F.col("n")).otherwise(0)
        return counts.groupBy(BATCH, SPAN).agg(
            F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"), F.sum(n).alias("n")
        )

    def articles_in(self, spark: SparkSession, spans: list[tuple[int, int]]) -> DataFrame:
        """Articles of the given (batch, span) only; no other file is listed or opened."""
        schema = T.StructType([*_in_batches(STORED_ARTICLE).fields, T.StructField(SPAN, T.IntegerType())])
        if not spans:
            return spark.createDataFrame([], STORED_ARTICLE)
        paths = [f"{self.articles_path}/batch={b}/span={s}" for b, s in spans]
        return _read(spark, schema, *paths, base=self.articles_path).drop(BATCH, SPAN)

    def article(self, spark: SparkSession, article_id: int) -> DataFrame:
        """The article with this id, from the one span that holds it."""
        held = self.spans(spark).filter(F.lit(article_id).between(F.col("first_id"), F.col("last_id")))
        places = [(r[BATCH], r[SPAN]) for r in held.limit(1).collect()]
        return self.articles_in(spark, places).filter(F.col("id") == article_id)

    # --- appending ----------------------------------------------------------

    def begin(self, spark: SparkSession, key: str, started: dt.datetime) -> tuple[Manifest, HashIndex] | None:
        """The next batch and the index it is held against; None if the key is closed already."""
        batches = self.batches(spark)
        if batches.closed(key) is not None:
            return None
        last = batches.last()
        following = replace(
            last, batch=last.batch + 1, key=key, started_at=started.isoformat(), first_id=last.last_id + 1, new_articles={}
        )
        return following, self.hash_index(spark, last)

    def with_spans(self, numbered: DataFrame, batch: Manifest, total_bytes: int) -> DataFrame:
        """Adds the span of each id: running sums of bytes, in buckets of ids, cut at FILE_BYTES."""
        if total_bytes <= FILE_BYTES:
            return numbered.withColumn(SPAN, F.lit(0))
        bucket = F.floor((F.col("id") - F.lit(batch.first_id)) / F.lit(BUCKET_IDS)).alias("bucket")
        sizes = numbered.groupBy(bucket).agg(F.sum(BYTES).alias(BYTES))
        # One row per BUCKET_IDS new articles goes through one task and is broadcast.
        before = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        sums = F.coalesce(F.sum(BYTES).over(before), F.lit(0))
        cut = sizes.select("bucket", F.floor(sums / F.lit(FILE_BYTES)).cast("int").alias(SPAN))
        return numbered.withColumn("bucket", bucket).join(F.broadcast(cut), "bucket").drop("bucket")

    def append(
        self,
        batch: Manifest,
        index: HashIndex,
        articles: DataFrame,
        numbered: DataFrame,
        source_runs: DataFrame,
        bad: DataFrame | None = None,
    ) -> Manifest:
        """Append a batch and close it.

        articles are the whole rows with id, span and created_date; numbered has these, source and
        hash of the same rows, and nothing wide. Everything goes to the batch's own folders, over what
        a run that broke off may have left there; only the last step makes it visible.
        """
        spark = articles.sparkSession
        batches = self.batches(spark)
        batches.open(batch)
        folder = f"batch={batch.batch}"
        if batch.articles:
            spans = numbered.agg(F.max(SPAN)).first()[0] + 1
            (
                articles.repartitionById(spans, F.col(SPAN))
                .sortWithinPartitions(SPAN, CREATED_DATE, "id")
                .write.mode("overwrite")
                .partitionBy(SPAN, CREATED_DATE)
                .parquet(f"{self.articles_path}/{folder}")
            )
        else:
            remove(spark, f"{self.articles_path}/{folder}")
        if bad is not None:
            bad.write.mode("overwrite").parquet(f"{self.quarantine_path}/{folder}")
        else:
            remove(spark, f"{self.quarantine_path}/{folder}")
        source_runs.coalesce(1).write.mode("overwrite").parquet(f"{self.source_runs_path}/{folder}")
        index.add(batch.batch, numbered.select(HASH), batch.articles)
        counts_base, merged = self._write_kept(spark, batch, numbered)
        closed = replace(batch, runs=index.runs, recent=index.recent, counts_base=counts_base)
        batches.close(closed)
        # Nothing points at these any more; a reader that started before finds its counts for a while.
        index.remove_gone()
        for path in merged:
            remove(spark, path)
        return closed

    def _write_kept(self, spark: SparkSession, batch: Manifest, numbered: DataFrame) -> tuple[int, list[str]]:
        """Write the batch's counts and the letters of its titles; every COUNT_TABLES batches
        merge all parts of these tables into one.

        Returns up to which batch they are merged, and the parts of the merge before.
        """
        counted = numbered.groupBy(SPAN, CREATED_DATE, "source").agg(
            F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
        )
        tables = [("counts", COUNTS, counted)]
        if batch.articles:
            titles = spark.read.schema(f"title string, {SPAN} int").parquet(f"{self.articles_path}/batch={batch.batch}")
            codes = gram_codes(titles, "title", SPAN).groupBy(SPAN)
            grams = codes.agg(F.sort_array(F.collect_list("code")).alias("codes"))
        else:
            grams = spark.createDataFrame([], GRAMS)
        tables.append(("grams", GRAMS, grams))
        merge = batch.batch - batch.counts_base >= COUNT_TABLES
        # The parts merged here stay until the next merge, for readers that have begun.
        low = max(0, batch.counts_base - COUNT_TABLES)
        old = []
        for name, schema, rows in tables:
            numbers = rows.withColumn(BATCH, F.lit(batch.batch)).select(
                *[F.col(f.name).cast(f.dataType) for f in schema.fields]
            )
            numbers.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch.batch}")
            if merge:
                whole = self._kept(spark, name, schema, batch)
                whole.repartitionByRange(BATCH, SPAN).write.mode("overwrite").parquet(f"{self.path}/{name}/upto={batch.batch}")
                old += [f"{self.path}/{name}/batch={n}" for n in range(low + 1, batch.counts_base + 1)]
                old += [f"{self.path}/{name}/upto={low}"] * bool(low)
        return (batch.batch if merge else batch.counts_base), old
