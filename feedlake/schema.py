"""Record layouts: feed items as landed, the article table and the run table."""

from pyspark.sql import types as T

STR = T.StringType()

# Text elements of a feed item, in the names the feeds use.
ITEM_TEXT_FIELDS = [
    "title",
    "link",
    "content",
    "summary",
    "description",
    "creator",
    "author",
    "dc:creator",
    "pubDate",
    "published",
    "dc:date",
]

_MEDIA = T.StructType([T.StructField("_url", STR)])
_ENCLOSURE = T.StructType([T.StructField("_url", STR), T.StructField("_type", STR)])

ITEM = T.StructType(
    [T.StructField(name, STR) for name in ITEM_TEXT_FIELDS]
    + [T.StructField("media:content", _MEDIA), T.StructField("enclosure", _ENCLOSURE)]
)

CORRUPT = "_corrupt"

# What the XML scan reads. Every element is an array, because Spark keeps the
# last of repeated elements for a plain field and a feed reader takes the first.
# fetch and feed come from the landing path, not from the file.
FEED_FILE = T.StructType(
    [T.StructField(f.name, T.ArrayType(f.dataType)) for f in ITEM.fields]
    + [
        T.StructField(CORRUPT, STR),
        T.StructField("fetch", STR),
        T.StructField("feed", STR),
    ]
)

# What the scan of Atom documents reads: links are structs, and authors hold a name.
ATOM_LINK = T.StructType([T.StructField(name, STR) for name in ("_href", "_rel", "_type")])
ATOM_AUTHOR = T.StructType([T.StructField("name", STR)])
ATOM_FILE = T.StructType(
    [T.StructField(name, T.ArrayType(STR)) for name in ("title", "content", "summary", "published", "updated")]
    + [
        T.StructField("link", T.ArrayType(ATOM_LINK)),
        T.StructField("author", T.ArrayType(ATOM_AUTHOR)),
        T.StructField("media:content", T.ArrayType(_MEDIA)),
        T.StructField(CORRUPT, STR),
        T.StructField("fetch", STR),
        T.StructField("feed", STR),
    ]
)

ARTICLE = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("title", STR, False),
        T.StructField("url", STR, False),
        T.StructField("contentHash", STR, False),
        T.StructField("source", STR, False),
        T.StructField("description", STR),
        T.StructField("author", STR),
        T.StructField("publishedAt", T.TimestampType()),
        T.StructField("imageUrl", STR),
        T.StructField("createdAt", T.TimestampType(), False),
    ]
)

# Partition column of the stored article table.
CREATED_DATE = "created_date"

RUN = T.StructType(
    [
        T.StructField("run_id", STR),
        T.StructField("status", STR),
        T.StructField("source", STR),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("items", T.LongType()),
        T.StructField("malformed", T.LongType()),
        T.StructField("unparsed_dates", T.LongType()),
        T.StructField("invalid", T.LongType()),
        T.StructField("new_articles", T.LongType()),
        T.StructField("message", STR),
    ]
)

ACCESS_LOG_LINE = T.StructType(
    [
        T.StructField("level", STR),
        T.StructField("message", STR),
        T.StructField("timestamp", STR),
        T.StructField("context", STR),
    ]
)
