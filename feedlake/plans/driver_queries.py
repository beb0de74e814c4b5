"""Every operator as a query over the given tables, with the SQL that must agree."""

import datetime as dt

from pyspark.sql import functions as F

from feedlake.functions import dates, text
from feedlake.operators import catalog, dedup, items as item_ops, positions, stats
from feedlake.plans import driver_tables as given
from feedlake.plans import ingest, reports
from feedlake.sources import accesslog, registry
from feedlake.sources.hash_index import HashIndex
from feedlake.sources.store import Store
from feedlake.staging import new_path, stage
from feedlake.streaming.ingest import stream_ingest

QUERIES = {}
ORACLE_SQL = {}

# The same constants in DuckDB's spelling.
WS = (
    r"[\t\n\x{0B}\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
)


def strip_sql(value: str) -> str:
    no_tags = f"regexp_replace({value}, '<[^>]*>', '', 'g')"
    return f"nullif(regexp_replace({no_tags}, '^{WS}|{WS}$', '', 'g'), '')"


def query(sql: str | None = None):
    def register(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLE_SQL[run.__name__] = sql
        return run

    return register


# --- values of an item ------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    hashed = item_ops.with_content_hash(given.document_items(spark, sf_dir))
    return hashed.select("doc_id", F.col("contentHash").alias("content_hash"))


@query(
    """
    SELECT doc_id, CASE WHEN lang = 'es' THEN '' ELSE text END AS content
    FROM documents
    """
)
def content_chain(spark, sf_dir):
    items = given.field_items(spark, sf_dir)
    return items.select("doc_id", text.content_chain().alias("content"))


@query(f"SELECT page_id, {strip_sql('html')} AS description FROM pages")
def strip_html(spark, sf_dir):
    pages = given.table(spark, sf_dir, "pages")
    return pages.select("page_id", text.strip_html(F.col("html")).alias("description"))


IMAGE_SQL = """
    CASE
      WHEN url LIKE '%.example.com%' AND url LIKE 'https:%' THEN 'https://img.example.com/' || page_id
      WHEN url LIKE '%.example.com%' THEN NULL
      WHEN url LIKE '%.example.net%' AND url LIKE 'https:%' THEN 'https://img.example.com/' || page_id
      ELSE url
    END
"""


@query(f"SELECT page_id, {IMAGE_SQL} AS image_url FROM pages")
def extract_image(spark, sf_dir):
    items = given.page_items(spark, sf_dir)
    return items.select("page_id", text.image_url().alias("image_url"))


@query(
    """
    SELECT page_id,
           nullif(regexp_extract('<img class="x" src="' || url || '" data-src="'
             || 'https://img.example.com/' || page_id || '"/>' || html,
             '<img[^>]+src="([^"]+)"', 1), '') AS image_url
    FROM pages
    """
)
def extract_image_from_html(spark, sf_dir):
    html = F.concat(
        F.lit('<img class="x" src="'),
        "url",
        F.lit('" data-src="https://img.example.com/'),
        "page_id",
        F.lit('"/>'),
        "html",
    )
    pages = given.table(spark, sf_dir, "pages")
    return pages.select("page_id", text.first_image(html).alias("image_url"))


@query("SELECT doc_id, CASE WHEN lang <> 'es' THEN source END AS author FROM documents")
def author_chain(spark, sf_dir):
    return given.field_items(spark, sf_dir).select("doc_id", text.author().alias("author"))


@query(
    """
    SELECT event_id,
           CASE event_type
             WHEN 'click' THEN date_trunc('second', ts)
             WHEN 'view' THEN CASE event_id % 4
               WHEN 3 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END - INTERVAL 1 HOUR
             WHEN 'signup' THEN CASE event_id % 3
               WHEN 1 THEN date_trunc('day', ts) ELSE date_trunc('minute', ts) END
             WHEN 'purchase' THEN CASE event_id % 3
               WHEN 0 THEN ts ELSE date_trunc('minute', ts) END
           END AS published_at,
           event_type = 'error' AS parse_error
    FROM events
    """
)
def parse_pubdate(spark, sf_dir):
    ts, kind = F.col("ts"), F.col("event_type")

    def in_turn(*forms):
        """The forms by turns of the event id."""
        turn = F.col("event_id") % len(forms)
        return F.coalesce(*[F.when(turn == i, F.date_format(ts, f)) for i, f in enumerate(forms)])

    written = (
        F.when(
            kind == "click",
            in_turn(
                "EEE, dd MMM yyyy HH:mm:ss 'GMT'",
                "EEE, dd MMM yy HH:mm:ss 'GMT'",
                "EEE, dd MMMM yyyy HH:mm:ss 'GMT'",
            ),
        )
        .when(
            kind == "view",
            in_turn(
                "EEE, d MMM yyyy HH:mm:ss '+0100'",
                "EEE, d MMM yyyy HH:mm:ss '+0100 (CET)'",
                "EEE MMM dd yyyy HH:mm:ss 'GMT+0100'",
                "yyyy-MM-dd'T'HH:mm'+01:00'",
            ),
        )
        .when(
            kind == "signup", in_turn("d MMM yyyy HH:mm '+00:00'", "MMMM d, yyyy", "MMM d, yyyy HH:mm")
        )
        .when(
            kind == "purchase",
            in_turn("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "yyyy-MM-dd'T'HH:mm'Z'", "yyyy/MM/dd HH:mm"),
        )
        .otherwise("invalid-date-string")
    )
    none = F.lit(None).cast("string")
    items = given.table(spark, sf_dir, "events").select(
        "event_id", written.alias("pubDate"), none.alias("published"), none.alias("dc:date")
    )
    return dates.with_published(items).select(
        "event_id",
        F.col("publishedAt").cast("timestamp_ntz").alias("published_at"),
        F.col("dateError").alias("parse_error"),
    )


@query(
    """
    SELECT event_id,
           CASE event_id % 10
             WHEN 1 THEN date_trunc('second', ts) + INTERVAL 0 HOUR
             WHEN 2 THEN date_trunc('millisecond', ts)
             WHEN 6 THEN date_trunc('day', ts)
             WHEN 7 THEN date_trunc('second', ts)
             WHEN 8 THEN date_trunc('day', ts) + INTERVAL 1 DAY
             WHEN 9 THEN date_trunc('day', ts) + INTERVAL 1 DAY
             ELSE date_trunc('minute', ts)
           END AS published_at
    FROM events
    """
)
def parse_pubdate_spellings(spark, sf_dir):
    """Event times in less usual spellings: no blank after the weekday, hours of one digit, parts
    of seconds, AM and PM, slashes and dashes, midnight as 24:00."""
    ts, turn = F.col("ts"), F.col("event_id") % 10
    forms = [
        "EEE,dd MMM yyyy HH:mm 'GMT'",
        "EEE, d MMM yyyy H:mm:ss 'GMT'",
        "dd MMM yyyy HH:mm:ss.SSS 'GMT'",
        "EEE, dd MMM yyyy hh:mm a",
        "MMM d, yyyy h:mm a",
        "MM/dd/yyyy HH:mm",
        "MM/dd/yyyy",
        "dd-MMM-yyyy HH:mm:ss",
        "EEE, dd MMM yyyy '24:00:00 GMT'",
        "yyyy-MM-dd'T24:00:00Z'",
    ]
    written = F.coalesce(*[F.when(turn == i, F.date_format(ts, f)) for i, f in enumerate(forms)])
    none = F.lit(None).cast("string")
    items = given.table(spark, sf_dir, "events").select(
        "event_id", written.alias("pubDate"), none.alias("published"), none.alias("dc:date")
    )
    return dates.with_published(items).select(
        "event_id", F.col("publishedAt").cast("timestamp_ntz").alias("published_at")
    )


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'es')")
def valid_items(spark, sf_dir):
    return item_ops.valid_items(given.field_items(spark, sf_dir)).select("doc_id")


@query(
    f"""
    WITH items AS (
      SELECT page_id, url, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS source,
             regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
             CASE WHEN url LIKE '%.example.com%' THEN html
                  ELSE '<img class="x" src="https://img.example.com/' || page_id
                       || '" data-src="' || url || '"/>' || html END AS content
      FROM pages
    )
    SELECT page_id, title, url, sha256(content) AS "contentHash", source,
           {strip_sql('content')} AS description,
           regexp_extract(url, '^https?://([^/]*)', 1) AS author,
           CASE WHEN url LIKE 'https:%' THEN TIMESTAMP '2024-01-02 09:20:30'
                ELSE TIMESTAMP '2024-01-03 04:05:06' END AS "publishedAt",
           {IMAGE_SQL} AS "imageUrl"
    FROM items WHERE title <> '' AND url <> ''
    """
)
def article_projection(spark, sf_dir):
    items = item_ops.valid_items(given.page_items(spark, sf_dir))
    articles = item_ops.article_projection(item_ops.with_content_hash(items), "page_id")
    return articles.withColumn("publishedAt", F.col("publishedAt").cast("timestamp_ntz"))


@query("SELECT doc_id, CASE WHEN lang <> 'de' THEN text END AS title FROM documents")
def null_if_empty(spark, sf_dir):
    items = given.field_items(spark, sf_dir)
    return items.select("doc_id", text.null_if_empty(F.col("title")).alias("title"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN source ELSE 'all' END AS source FROM documents")
def default_for_missing(spark, sf_dir):
    items = given.field_items(spark, sf_dir)
    return items.select("doc_id", text.default_if_empty(F.col("creator"), "all").alias("source"))


@query(
    """
    SELECT page_id,
           CASE WHEN url LIKE '%.example.com%' AND url LIKE 'https:%'
                THEN 'https://img.example.com/' || page_id END AS media_url,
           CASE WHEN url LIKE '%.example.net%' THEN
             CASE WHEN url LIKE 'https:%' THEN 'image/png' ELSE 'audio/mpeg' END END AS enclosure_type
    FROM pages
    """
)
def optional_nested_fields(spark, sf_dir):
    return given.page_items(spark, sf_dir).select(
        "page_id",
        text.field("media:content")["_url"].alias("media_url"),
        F.col("enclosure")["_type"].alias("enclosure_type"),
    )


# --- deduplication ----------------------------------------------------------

FIRSTS_SQL = """
    SELECT doc_id, source, sha256(text) AS h FROM documents
    QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1
"""


def _hashed_documents(spark, sf_dir):
    hashed = item_ops.with_content_hash(given.document_items(spark, sf_dir))
    return hashed.select("doc_id", "source", "contentHash")


def _first_documents(spark, sf_dir):
    return dedup.first_wins(_hashed_documents(spark, sf_dir), ["doc_id"])


def _history(spark, sf_dir):
    hashed = item_ops.with_content_hash(given.labelled_documents(spark, sf_dir))
    return hashed.select("contentHash")


@query(f'SELECT doc_id, source, h AS "contentHash" FROM ({FIRSTS_SQL})')
def dedup_first_wins(spark, sf_dir):
    return _first_documents(spark, sf_dir)


@query(
    """
    SELECT doc_id, source, sha256(text) AS "contentHash" FROM documents
    WHERE sha256(text) NOT IN (
      SELECT sha256(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
    """
)
def new_vs_history(spark, sf_dir):
    return dedup.new_against(_hashed_documents(spark, sf_dir), _history(spark, sf_dir))


@query(
    """
    SELECT sha256(text) AS "contentHash", count(*) AS copies FROM documents
    GROUP BY sha256(text) HAVING count(*) > 1
    """
)
def hash_uniqueness_audit(spark, sf_dir):
    return dedup.hash_uniqueness_audit(_hashed_documents(spark, sf_dir))


@query(f"SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS id FROM ({FIRSTS_SQL})")
def assign_ids(spark, sf_dir):
    firsts = _first_documents(spark, sf_dir).select("doc_id")
    return positions.assign_ids(firsts, "doc_id")


@query(
    f"""
    WITH new AS (
      SELECT source FROM ({FIRSTS_SQL}) WHERE h NOT IN (
        SELECT sha256(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)))
    SELECT s.source, (SELECT count(*) FROM new n WHERE n.source = s.source) AS new_articles
    FROM (SELECT DISTINCT source FROM documents) s
    """
)
def new_articles_by_source(spark, sf_dir):
    new = dedup.new_against(_first_documents(spark, sf_dir), _history(spark, sf_dir))
    counted = registry.items_per_source(new, given.document_registry(spark, sf_dir))
    return counted.select("source", F.col("items").alias("new_articles"))


# --- whole ingest runs over landed feed files -------------------------------


def _stored(spark, store):
    """All stored columns; times as plain ones."""
    articles = store.articles(spark)
    return articles.withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("publishedAt", "createdAt")}
    ).drop("created_date")


# What landed documents carry in their other fields, by turns of their ids.
LANDED_SQL = """
           CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN lang WHEN 2 THEN 'dc ' || source END AS author,
           CASE doc_id % 5 WHEN 0 THEN TIMESTAMP '2024-01-02 09:20:30' WHEN 1 THEN TIMESTAMP '2024-01-03 04:05:06'
             WHEN 2 THEN TIMESTAMP '2024-01-04 00:00:00' END AS "publishedAt",
           CASE doc_id % 3 WHEN 0 THEN 'https://img.example.com/' || doc_id
             WHEN 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'https://enc.example.com/' || doc_id END END AS "imageUrl",
           TIMESTAMP '2024-01-20 12:30:00' AS "createdAt"
"""


STORED_SQL = f"""
    WITH reg AS (SELECT source, min(doc_id) AS source_ord FROM documents GROUP BY source),
    items AS (
      SELECT 2 AS landed, d.*, r.source_ord FROM documents d JOIN reg r USING (source)
      UNION ALL
      SELECT 1 AS landed, d.*, r.source_ord FROM documents d JOIN reg r USING (source)
      WHERE doc_id IN (SELECT doc_id FROM labels)
    ),
    firsts AS (
      SELECT * FROM items WHERE landed >= FIRST_FETCH
      QUALIFY row_number() OVER (
        PARTITION BY sha256(text) ORDER BY landed, source_ord, doc_id) = 1
    )
    SELECT row_number() OVER (ORDER BY landed, source_ord, doc_id) AS id,
           'Document ' || doc_id AS title, 'https://example.com/' || doc_id AS url,
           sha256(text) AS "contentHash", source, {strip_sql('text')} AS description,
           {LANDED_SQL}
    FROM firsts
"""


@query(STORED_SQL.replace("FIRST_FETCH", "2"))
def feed_file_ingest(spark, sf_dir):
    """All documents landed as RSS files and ingested in one run."""
    landing, store = given.landed_documents(spark, sf_dir), Store(new_path(spark, "store"))
    ingest.run_ingest(
        spark, landing, store, registry=given.document_registry(spark, sf_dir), started_at=given.AS_OF
    )
    return _stored(spark, store)


@query(
    f"""
    SELECT row_number() OVER (ORDER BY doc_id) AS id, 'Document ' || doc_id AS title,
           'https://example.com/' || doc_id AS url, sha256(text) AS "contentHash", source,
           {strip_sql('text')} AS description,
           {LANDED_SQL}
    FROM (SELECT * FROM documents WHERE source = 'src3'
          QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1)
    """
)
def ingest_one_source(spark, sf_dir):
    """All documents landed as RSS files, the files of one source ingested."""
    landing, store = given.landed_documents(spark, sf_dir), Store(new_path(spark, "store"))
    reg = given.document_registry(spark, sf_dir)
    ingest.run_ingest(spark, landing, store, "src3", registry=reg, started_at=given.AS_OF)
    return _stored(spark, store)


@query(f"SELECT * EXCLUDE \"createdAt\" FROM ({STORED_SQL.replace('FIRST_FETCH', '1')})")
def feed_stream_ingest(spark, sf_dir):
    """Labelled documents land first, then all of them; a stream takes each up in turn."""
    landing, store = given.new_landing(spark), Store(new_path(spark, "store"))
    checkpoint = new_path(spark, "stream")
    reg = given.document_registry(spark, sf_dir)
    items = given.full_items(spark, sf_dir)
    labels = given.table(spark, sf_dir, "labels").select("doc_id")
    for fetch, landed in enumerate([items.join(labels, "doc_id", "left_semi"), items], 1):
        given.land_items(landed, landing, str(fetch))
        stream_ingest(spark, landing, store, checkpoint, reg).awaitTermination()
    # A stream's articles are created when it runs, which no SQL can foretell.
    return _stored(spark, store).drop("createdAt")


@query(
    """
    WITH reg AS (
      SELECT source, min(doc_id) AS source_ord FROM documents GROUP BY source
      HAVING source <> 'src7'),
    items AS (SELECT d.*, r.source_ord FROM documents d JOIN reg r USING (source)),
    firsts AS (
      SELECT source, count(*) AS n FROM (
        SELECT source FROM items
        QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY source_ord, doc_id) = 1)
      GROUP BY source)
    SELECT r.source, 'completed' AS status, count(*) AS items, CAST(0 AS BIGINT) AS malformed,
           CAST(0 AS BIGINT) AS unparsed_dates, coalesce(any_value(f.n), 0) AS new_articles
    FROM reg r JOIN items i USING (source) LEFT JOIN firsts f USING (source)
    GROUP BY r.source
    UNION ALL
    SELECT source, 'unregistered', count(*), 0, 0, 0 FROM documents WHERE source = 'src7'
    GROUP BY source
    UNION ALL SELECT DISTINCT 'no-' || source, 'empty', 0, 0, 0, 0 FROM reg
    """
)
def ingest_run_report(spark, sf_dir):
    """Run rows per source after all documents landed: one source is not registered,
    and beside each other source stands one that landed nothing."""
    landing, store = given.new_landing(spark), Store(new_path(spark, "store"))
    given.land_items(given.document_items(spark, sf_dir), landing, "1")
    landed = given.document_registry(spark, sf_dir).filter("source <> 'src7'")
    silent = landed.select(
        (F.col("source_ord") + 1_000_000_000).alias("source_ord"),
        F.concat(F.lit("no-"), "source").alias("source"),
        "url",
    )
    reg = landed.unionByName(silent)
    ingest.run_ingest(spark, landing, store, registry=reg, started_at=given.AS_OF)
    per_source = store.runs(spark).filter(F.col("source") != ingest.ALL_SOURCES)
    return per_source.select(
        "source", "status", "items", "malformed", "unparsed_dates", "new_articles"
    )


RUN_ROWS_SQL = """
    WITH firsts AS (
      SELECT source, count(*) AS n FROM (
        SELECT d.source FROM documents d JOIN (
          SELECT source, min(doc_id) AS source_ord FROM documents GROUP BY source) USING (source)
        QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY source_ord, doc_id) = 1)
      GROUP BY source)
    SELECT source, {status} AS status, count(*) AS items, coalesce(any_value(n), 0) AS new_articles
    FROM documents LEFT JOIN firsts USING (source) GROUP BY source
"""
LABELLED_SOURCES_SQL = """
    (SELECT source FROM documents GROUP BY source HAVING min(doc_id) IN (SELECT doc_id FROM labels))
"""


@query(RUN_ROWS_SQL.format(status=f"CASE WHEN source IN {LABELLED_SOURCES_SQL} THEN 'failed' ELSE 'completed' END"))
def stream_with_broken_files(spark, sf_dir):
    """Run rows after a stream took up all documents, and beside the files of some
    sources a packed file that breaks off and an error page."""
    landing, store = given.new_landing(spark), Store(new_path(spark, "store"))
    reg = given.document_registry(spark, sf_dir)
    given.land_items(given.full_items(spark, sf_dir), landing, "1")
    some = [r["source"] for r in given.label_registry(spark, sf_dir).collect()]
    given.land_broken_files(spark, some, landing, "1")
    stream_ingest(spark, landing, store, new_path(spark, "stream"), reg).awaitTermination()
    per_source = store.runs(spark).filter(F.col("source") != ingest.ALL_SOURCES)
    return per_source.select("source", "status", "items", "new_articles")


def _stored_documents(spark, sf_dir):
    """A store with the labelled documents of one batch and all documents of the next."""
    store, reg = Store(new_path(spark, "store")), given.document_registry(spark, sf_dir)
    items = given.placed_items(spark, sf_dir)
    labels = given.table(spark, sf_dir, "labels").select("doc_id")
    ingest.ingest_items(items.join(labels, "doc_id", "left_semi"), store, reg, given.AS_OF, report_empty=False)
    ingest.ingest_items(items, store, reg, given.AS_OF + dt.timedelta(days=1))
    return store


@query(RUN_ROWS_SQL.format(status="'completed'"))
def replayed_run_report(spark, sf_dir):
    """Run rows of a batch of all documents that broke off before it was closed, was
    done again, and was replayed once more after that."""
    path, reg = new_path(spark, "store"), given.document_registry(spark, sf_dir)
    items = given.placed_items(spark, sf_dir)
    try:
        ingest.ingest_items(items, given.BreakingStore(path), reg, given.AS_OF, batch_key="batch")
    except OSError:
        pass
    store = Store(path)
    ingest.ingest_items(items, store, reg, given.AS_OF, batch_key="batch")
    report = ingest.ingest_items(items, store, reg, given.AS_OF, batch_key="batch")
    return report.select("source", "status", "items", "new_articles")


@query(
    """
    SELECT doc_id, source, h AS "contentHash" FROM (FIRSTS) WHERE h NOT IN (
      SELECT sha256(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
    """.replace("FIRSTS", FIRSTS_SQL)
)
def new_vs_hash_index(spark, sf_dir):
    """First documents held against an index of the labelled ones, as an ingest does it."""
    index = HashIndex(spark, new_path(spark, "hashes"), [], [])
    history = stage(_history(spark, sf_dir).distinct(), "history")
    index.add(1, history, history.count())
    index.merge(1)
    firsts = stage(_first_documents(spark, sf_dir), "first-keys")
    return index.new_against(firsts, firsts.count())


STORED_TWICE_SQL = """
    WITH items AS (
      SELECT d.*, r.source_ord, (doc_id NOT IN (SELECT doc_id FROM labels))::INT AS batch
      FROM documents d JOIN (SELECT source, min(doc_id) AS source_ord FROM documents GROUP BY source) r USING (source)),
    firsts AS (
      SELECT * FROM items
      QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY batch, source_ord, doc_id) = 1),
    stored AS (
      SELECT row_number() OVER (ORDER BY batch, source_ord, doc_id) AS id, 'Document ' || doc_id AS title, source,
        DATE '2024-01-20' + batch AS day
      FROM firsts)
"""


@query(
    STORED_TWICE_SQL
    + """SELECT source, count(*) AS total, count(*) FILTER (day = DATE '2024-01-21') AS today
         FROM stored GROUP BY source"""
)
def stored_stats(spark, sf_dir):
    """Counts per source of two batches, from the counts kept with the store."""
    counts = _stored_documents(spark, sf_dir).counts(spark)
    return stats.stored_stats(counts, given.AS_OF.date() + dt.timedelta(days=1))


@query(STORED_TWICE_SQL + "SELECT id, title, source FROM stored WHERE source = 'src3' ORDER BY id DESC LIMIT 5 OFFSET 5")
def stored_page(spark, sf_dir):
    store = _stored_documents(spark, sf_dir)
    return catalog.stored_page(spark, store, 2, 5, "src3").rows.select("id", "title", "source")


@query(STORED_TWICE_SQL + "SELECT id, title, source FROM stored WHERE lower(title) LIKE '%ment 4%'")
def stored_search(spark, sf_dir):
    """Title search that opens files by the letters of their titles."""
    return _stored_documents(spark, sf_dir).search(spark, "MENT 4").select("id", "title", "source")


@query(STORED_TWICE_SQL + "SELECT id, title, source FROM stored WHERE id = 42")
def stored_article(spark, sf_dir):
    return _stored_documents(spark, sf_dir).article(spark, 42).select("id", "title", "source")


# --- catalog ----------------------------------------------------------------


@query("SELECT doc_id AS id, text AS title, source FROM documents WHERE doc_id = 42")
def article_by_id(spark, sf_dir):
    return catalog.find_article(given.document_articles(spark, sf_dir), 42)


PAGE_SQL = """
    SELECT doc_id AS id, text AS title, source FROM documents WHERE {where}
    ORDER BY doc_id DESC LIMIT {limit} OFFSET {offset}
"""


@query(PAGE_SQL.format(where="true", limit=20, offset=40))
def articles_page(spark, sf_dir):
    return catalog.list_articles(given.document_articles(spark, sf_dir), page=3).rows


@query(
    """
    SELECT event_id AS id, event_type AS source, ts AS "createdAt" FROM events
    ORDER BY event_id DESC LIMIT 20 OFFSET 580
    """
)
def articles_page_deep(spark, sf_dir):
    """A deep page, found by the same counts as any other."""
    return catalog.page_rows(given.event_articles(spark, sf_dir), page=30)


@query("SELECT doc_id AS id, text AS title, source FROM documents WHERE source = 'src3'")
def articles_by_source(spark, sf_dir):
    return catalog.by_source(given.document_articles(spark, sf_dir), "src3")


@query(PAGE_SQL.format(where="source = 'src3'", limit=4, offset=4))
def articles_by_source_page(spark, sf_dir):
    articles = given.document_articles(spark, sf_dir)
    return catalog.articles_by_source(articles, "src3", page=2, limit=4).rows


@query(
    """
    SELECT event_id AS id, event_type AS source, ts AS "createdAt" FROM events
    WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16'
    """
)
def articles_by_date(spark, sf_dir):
    return catalog.created_on(given.event_articles(spark, sf_dir), "2024-01-15")


@query(
    """
    SELECT event_id AS id, event_type AS source, ts AS "createdAt" FROM events
    WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16'
    ORDER BY event_id DESC LIMIT 20 OFFSET 20
    """
)
def articles_by_date_page(spark, sf_dir):
    return catalog.articles_by_date(given.event_articles(spark, sf_dir), "2024-01-15", page=2).rows


@query(
    """
    SELECT event_id AS id, event_type AS source, ts AS "createdAt" FROM events
    WHERE ts >= TIMESTAMP '2024-01-13'
    """
)
def articles_recent(spark, sf_dir):
    return catalog.created_recently(given.event_articles(spark, sf_dir), 7, given.AS_OF)


@query(
    """
    SELECT event_id AS id, event_type AS source, ts AS "createdAt" FROM events
    WHERE ts >= TIMESTAMP '2024-01-13' ORDER BY event_id DESC LIMIT 20
    """
)
def articles_recent_page(spark, sf_dir):
    return catalog.recent_articles(given.event_articles(spark, sf_dir), 7, given.AS_OF).rows


@query(
    """
    SELECT event_id AS id, event_type AS source, ts AS "createdAt" FROM events
    WHERE ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-21'
    """
)
def articles_today(spark, sf_dir):
    return catalog.created_today(given.event_articles(spark, sf_dir), given.AS_OF)


SEARCH_SQL = (
    "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%the was%'"
)


@query(f"SELECT doc_id AS id, text AS title, source FROM documents WHERE {SEARCH_SQL}")
def search_title(spark, sf_dir):
    return catalog.search_title(given.document_articles(spark, sf_dir), "The WAS")


@query(
    "SELECT doc_id AS id, text AS title, source FROM documents "
    f"WHERE source = 'src3' AND {SEARCH_SQL} ORDER BY doc_id DESC LIMIT 20"
)
def search_title_in_source(spark, sf_dir):
    articles = given.document_articles(spark, sf_dir)
    return catalog.list_articles(articles, source="src3", search="The WAS").rows


@query(
    f"""
    SELECT CAST(1 AS INTEGER) AS page, CAST(20 AS INTEGER) AS "limit", count(*) AS total,
           CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages
    FROM documents WHERE {SEARCH_SQL}
    """
)
def pagination_totals(spark, sf_dir):
    return catalog.list_articles(given.document_articles(spark, sf_dir), search="The WAS").pagination


@query(PAGE_SQL.format(where="doc_id < 500", limit=20, offset=0))
def articles_keyset_page(spark, sf_dir):
    return catalog.keyset_page(given.document_articles(spark, sf_dir), 500, 20)


@query(
    """
    WITH days AS (
      SELECT event_id, CASE event_type
        WHEN 'click' THEN strftime(ts, '%Y-%m-%d')
        WHEN 'view' THEN strftime(ts, '%Y-02-%d')
        WHEN 'signup' THEN strftime(ts, '%Y/%m/%d')
        WHEN 'purchase' THEN strftime(ts, '%Y-') || CAST(month(ts) AS VARCHAR) || strftime(ts, '-%d')
        ELSE 'invalid-date' END AS day
      FROM events)
    SELECT event_id, day FROM days
    WHERE NOT regexp_full_match(day, '[0-9]{4}-[0-9]{2}-[0-9]{2}') OR TRY_CAST(day AS DATE) IS NULL
    """
)
def invalid_dates(spark, sf_dir):
    ts, kind = F.col("ts"), F.col("event_type")
    day = (
        F.when(kind == "click", F.date_format(ts, "yyyy-MM-dd"))
        .when(kind == "view", F.date_format(ts, "yyyy-'02'-dd"))
        .when(kind == "signup", F.date_format(ts, "yyyy/MM/dd"))
        .when(kind == "purchase", F.date_format(ts, "yyyy-M-dd"))
        .otherwise("invalid-date")
    )
    days = given.table(spark, sf_dir, "events").select("event_id", day.alias("day"))
    return days.filter(dates.is_invalid_day(F.col("day")))


# --- counts -----------------------------------------------------------------


@query("SELECT count(*) AS total FROM documents")
def total_articles(spark, sf_dir):
    return stats.total_articles(given.document_articles(spark, sf_dir))


@query('SELECT event_type AS source, count(*) AS "count" FROM events GROUP BY event_type')
def count_by_source(spark, sf_dir):
    return stats.count_by_source(given.event_articles(spark, sf_dir))


@query(
    f"""
    SELECT source, count(*) AS "count" FROM ({FIRSTS_SQL}) GROUP BY source
    ORDER BY count(*) DESC, min(doc_id)
    """
)
def sources_ranked(spark, sf_dir):
    firsts = _first_documents(spark, sf_dir).withColumnRenamed("doc_id", "id")
    return stats.sources_ranked(firsts)


@query(
    """
    SELECT event_type AS source, count(*) AS total,
           count(*) FILTER (ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-21') AS today
    FROM events GROUP BY ROLLUP (event_type)
    """
)
def article_stats(spark, sf_dir):
    return stats.article_stats(given.event_articles(spark, sf_dir), given.AS_OF)


@query(
    """
    SELECT event_type AS source, count(*) AS articles,
           (SELECT max(date_trunc('hour', ts)) FROM events) AS "lastRun",
           TIMESTAMP '2024-01-20 13:00:00' AS "nextRun"
    FROM events GROUP BY event_type
    """
)
def ingest_stats(spark, sf_dir):
    record = stats.ingest_stats(
        given.event_articles(spark, sf_dir), given.hourly_runs(spark, sf_dir), given.AS_OF
    )
    return record.select(
        F.explode("articlesBySource").alias("source", "articles"),
        F.col("lastRun").cast("timestamp_ntz").alias("lastRun"),
        F.col("nextRun").cast("timestamp_ntz").alias("nextRun"),
    )


@query(
    """
    SELECT event_type AS source, count(*) AS articles, (SELECT count(*) FROM events)::BIGINT AS "totalArticles",
           (SELECT max(date_trunc('hour', ts)) FROM events) AS "lastRun",
           TIMESTAMP '2024-01-20 13:00:00' AS "nextRun"
    FROM events GROUP BY event_type
    """
)
def ingest_stats_rows(spark, sf_dir):
    rows = stats.ingest_stats_rows(
        given.event_articles(spark, sf_dir), given.hourly_runs(spark, sf_dir), given.AS_OF
    )
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("lastRun", "nextRun")})


@query(
    f"""
    WITH reg AS (SELECT source, min(doc_id) AS source_ord FROM documents GROUP BY source
                 HAVING min(doc_id) IN (SELECT doc_id FROM labels))
    SELECT '{reports.SCHEDULE}' AS schedule,
           (SELECT strftime(max(date_trunc('hour', ts)), '%Y-%m-%dT%H:%M:%S.000Z') FROM events) AS "lastRun",
           '2024-01-20T13:00:00.000Z' AS "nextRun", any_value(source_ord) AS source_ord, source, count(*) AS articles
    FROM documents LEFT JOIN reg USING (source) GROUP BY source
    """
)
def scraping_status(spark, sf_dir):
    return reports.scraping_status_rows(
        given.document_articles(spark, sf_dir),
        given.hourly_runs(spark, sf_dir),
        given.label_registry(spark, sf_dir),
        given.AS_OF,
    )


@query(
    """
    SELECT '2024-01-20T12:30:00.000Z' AS "timestamp", count(*) AS "articleCount",
           strftime(max(date_trunc('hour', ts)), '%Y-%m-%dT%H:%M:%S.000Z') AS "lastRun",
           '2024-01-20T13:00:00.000Z' AS "nextRun"
    FROM events
    """
)
def freshness_report(spark, sf_dir):
    return reports.freshness_report(
        given.event_articles(spark, sf_dir), given.hourly_runs(spark, sf_dir), given.AS_OF
    )


@query("SELECT source, count(*) AS articles FROM documents GROUP BY source ORDER BY min(doc_id)")
def status_by_source(spark, sf_dir):
    return reports.status_by_source(
        given.document_articles(spark, sf_dir), given.document_registry(spark, sf_dir)
    )


@query('SELECT event_type AS source, count(*) AS "count" FROM events GROUP BY event_type')
def source_counts_map(spark, sf_dir):
    """Counts folded into one map and read back from it."""
    counts = stats.count_by_source(given.event_articles(spark, sf_dir))
    folded = stats.as_map(counts)
    return folded.select(F.explode("bySource").alias("source", "count"))


# --- registry ---------------------------------------------------------------


FEED_ROWS = ", ".join(f"({i}, '{name}', '{url}')" for i, (name, url) in enumerate(registry.FEEDS))


@query(
    f"""
    WITH reg(source_ord, source, url) AS (VALUES {FEED_ROWS})
    SELECT r.source_ord::BIGINT AS source_ord, r.source, r.url, count(d.doc_id) AS items
    FROM reg r LEFT JOIN documents d ON CAST(substr(d.source, 4) AS INT) = r.source_ord
    GROUP BY ALL
    """
)
def registry_sources(spark, sf_dir):
    """The feed registry with the documents of each feed, their sources numbered as its rows."""
    feeds = registry.feed_registry(spark)
    place = F.substring("source", 4, 10).cast("int").alias("source_ord")
    numbered = given.table(spark, sf_dir, "documents").select(place)
    items = numbered.join(F.broadcast(feeds), "source_ord")
    counted = registry.items_per_source(items, feeds)
    return counted.join(feeds.select("source", "url"), "source")


@query(
    """
    SELECT source, 'https://example.com/rss/' || source AS url
    FROM (SELECT DISTINCT source FROM documents)
    """
)
def registry_as_map(spark, sf_dir):
    as_map = registry.registry_map(given.document_registry(spark, sf_dir))
    return as_map.select(F.explode("sources").alias("source", "url"))


@query(
    """
    WITH reg AS (
      SELECT regexp_extract(url, '^https?://([^/]*)', 1) AS source,
             regexp_replace(url, '^http://', '') AS url FROM pages)
    SELECT source, 'duplicate_name' AS rule FROM reg GROUP BY source HAVING count(*) > 1
    UNION ALL
    SELECT DISTINCT source, 'bad_url' FROM reg WHERE NOT regexp_matches(url, '^https?://')
    """
)
def registry_violations(spark, sf_dir):
    return registry.registry_violations(given.page_registry(spark, sf_dir))


LABEL_REGISTRY_SQL = """
    SELECT source FROM documents GROUP BY source
    HAVING min(doc_id) IN (SELECT doc_id FROM labels)
"""


@query(
    f"""
    SELECT source, count(*) AS items FROM documents
    WHERE source NOT IN ({LABEL_REGISTRY_SQL}) GROUP BY source
    """
)
def unknown_sources(spark, sf_dir):
    return registry.unknown_sources(
        given.document_items(spark, sf_dir), given.label_registry(spark, sf_dir)
    )


@query(
    f"""
    SELECT doc_id, source, '' AS feed_url, min(doc_id) OVER (PARTITION BY source) AS source_ord
    FROM documents WHERE source IN ({LABEL_REGISTRY_SQL})
    """
)
def items_with_registry(spark, sf_dir):
    items = given.document_items(spark, sf_dir).select("doc_id", "source")
    joined = registry.with_registry(items, given.label_registry(spark, sf_dir))
    return joined.select("doc_id", "source", "feed_url", "source_ord")


@query(
    f"SELECT DISTINCT source FROM documents WHERE source NOT IN ({LABEL_REGISTRY_SQL})"
)
def sources_without_items(spark, sf_dir):
    items = given.document_items(spark, sf_dir).select("doc_id", "source")
    known = registry.with_registry(items, given.label_registry(spark, sf_dir))
    return registry.sources_without_items(known, given.document_registry(spark, sf_dir))


# --- dates and run ids ------------------------------------------------------


@query("SELECT event_id, date_trunc('hour', ts) + INTERVAL 1 HOUR AS next_hour FROM events")
def next_hour(spark, sf_dir):
    events = given.table(spark, sf_dir, "events")
    return events.select(
        "event_id", dates.next_hour(F.col("ts")).cast("timestamp_ntz").alias("next_hour")
    )


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM events")
def iso_timestamp(spark, sf_dir):
    events = given.table(spark, sf_dir, "events")
    return events.select("event_id", dates.iso_text(F.col("ts")).alias("iso"))


@query("SELECT event_id, 'scrape_' || (epoch_us(ts) // 1000) AS run_id FROM events")
def run_id(spark, sf_dir):
    events = given.table(spark, sf_dir, "events")
    return events.select("event_id", dates.run_id(F.col("ts").cast("timestamp")).alias("run_id"))


@query(
    """
    SELECT event_id, CASE WHEN event_type = 'click' THEN ts
                          ELSE TIMESTAMP '2024-01-20 12:30:00' END AS "createdAt"
    FROM events
    """
)
def created_at_default(spark, sf_dir):
    clicked = F.when(F.col("event_type") == "click", F.col("ts"))
    created = dates.created_or(clicked, given.AS_OF).cast("timestamp_ntz")
    events = given.table(spark, sf_dir, "events")
    return events.select("event_id", created.alias("createdAt"))


# --- request log ------------------------------------------------------------


@query(
    """
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level,
           CASE event_type WHEN 'signup' THEN 'Incoming' WHEN 'error' THEN 'Failed'
             ELSE 'Completed' END AS outcome,
           CASE WHEN event_type = 'signup' THEN 'POST' ELSE 'GET' END AS method,
           '/articles/source/' || event_type AS url,
           CASE WHEN event_type = 'signup' THEN '10.0.0.' || user_id END AS ip,
           CASE WHEN event_type = 'signup' THEN CASE WHEN value > 10 THEN props ELSE '' END END
             AS user_agent,
           CASE event_type WHEN 'signup' THEN NULL
             WHEN 'error' THEN CASE WHEN value > 20 THEN 404 ELSE 500 END ELSE 200 END AS status,
           CASE WHEN event_type <> 'signup' THEN CAST(floor(value) AS BIGINT) END AS duration_ms,
           CASE WHEN event_type = 'error' THEN 'Article - not found' END AS error
    FROM events
    """
)
def parse_access_log(spark, sf_dir):
    return accesslog.parse_access_log(given.log_lines(spark, sf_dir))


@query(
    f"""
    SELECT event_id, 'error' AS level,
           concat_ws('{accesslog.SEPARATOR}', 'Failed GET /articles/source/error',
             CASE WHEN value > 20 THEN '404' ELSE 'undefined' END,
             CAST(floor(value) AS BIGINT) || 'ms', 'Article - not found') AS message
    FROM events WHERE event_type = 'error'
    """
)
def error_events(spark, sf_dir):
    return accesslog.error_events(given.log_lines(spark, sf_dir))


@query(
    """
    SELECT 'GET' AS method, '/articles/source/' || event_type AS url,
           CASE WHEN event_type = 'error' THEN 'Failed' ELSE 'Completed' END AS outcome,
           count(*) AS requests, avg(CAST(floor(value) AS BIGINT)) AS avg_ms,
           max(CAST(floor(value) AS BIGINT)) AS max_ms,
           quantile_disc(CAST(floor(value) AS BIGINT), 0.95) AS p95_ms
    FROM events WHERE event_type <> 'signup' GROUP BY event_type
    """
)
def request_durations(spark, sf_dir):
    requests = accesslog.parse_access_log(given.log_lines(spark, sf_dir))
    return accesslog.request_durations(requests)


@query(
    f"""
    SELECT 'GET' AS method, '/articles/source/' || event_type AS url,
           CASE WHEN event_type = 'error' THEN 'Failed' ELSE 'Completed' END AS outcome,
           date_trunc('day', ts) AS day,
           CASE WHEN value >= 1 THEN floor(ln(floor(value)) / ln({accesslog.BUCKET_GROWTH}::DOUBLE))::INT ELSE -1 END AS bucket,
           count(*) AS n
    FROM events WHERE event_type <> 'signup' GROUP BY ALL
    """
)
def duration_histogram(spark, sf_dir):
    """Histograms of durations by hour, added up to days."""
    lines = given.log_lines(spark, sf_dir).join(given.table(spark, sf_dir, "events").select("event_id", "ts"), "event_id")
    requests = accesslog.parse_access_log(lines).withColumn("hour", F.date_trunc("hour", "ts"))
    hourly = accesslog.duration_histogram(requests, "hour")
    return accesslog.merged_histogram(hourly.withColumn("day", F.date_trunc("day", "hour")), "day").withColumn(
        "day", F.col("day").cast("timestamp_ntz")
    )


@query(
    f"""
    SELECT 'GET' AS method, '/articles/source/' || event_type AS url,
           CASE WHEN event_type = 'error' THEN 'Failed' ELSE 'Completed' END AS outcome, count(*) AS requests, true AS within
    FROM events WHERE event_type <> 'signup' GROUP BY event_type
    """
)
def histogram_durations(spark, sf_dir):
    """Whether the 95 % mark read from merged histograms lies as near to the exact one as it must."""
    requests = accesslog.parse_access_log(given.log_lines(spark, sf_dir))
    read = accesslog.histogram_durations(accesslog.duration_histogram(requests))
    exact = accesslog.request_durations(requests).select("method", "url", "outcome", "p95_ms")
    off = F.abs(F.col("quantile_ms") - F.col("p95_ms"))
    return read.join(exact, ["method", "url", "outcome"]).select(
        "method", "url", "outcome", "requests", (off <= F.col("p95_ms") * accesslog.BUCKET_ERROR + 0.5).alias("within")
    )
