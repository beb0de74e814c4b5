"""Column expressions over the text fields of a feed item."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tag pattern, the image pattern (double quotes only, the last
# src of the first matching tag wins) and the white space that trimming removes.
TAG_PATTERN = "<[^>]*>"
IMAGE_PATTERN = '<img[^>]+src="([^"]+)"'
IMAGE_TYPE_PREFIX = "image/"
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
EMPTY_CONTENT_MODES = ("collapse", "key_by_url")


def field(name: str) -> Column:
    """A column whose name holds a namespace prefix, e.g. dc:creator."""
    return F.col(f"`{name}`")


def null_if_empty(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def trim_white_space(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITE_SPACE))


def raw_content() -> Column:
    """First set content field; an empty string counts as set."""
    return F.coalesce("content", "summary", "description")


def content_chain() -> Column:
    return F.coalesce(raw_content(), F.lit(""))


def content_hash(empty_content: str = "collapse") -> Column:
    """SHA-256 of the raw content as lower-case hex, never NULL.

    With "collapse" all items without content share one hash, so one of them is
    kept; "key_by_url" hashes the link of such items instead.
    """
    if empty_content not in EMPTY_CONTENT_MODES:
        raise ValueError(f"empty_content must be one of {', '.join(EMPTY_CONTENT_MODES)}")
    content = content_chain()
    if empty_content == "key_by_url":
        content = F.when(content == "", F.coalesce("link", F.lit(""))).otherwise(content)
    return F.sha2(content, 256)


def strip_html(value: Column) -> Column:
    """Text without tags and outer white space; NULL when nothing is left."""
    return null_if_empty(trim_white_space(F.regexp_replace(value, TAG_PATTERN, "")))


def description() -> Column:
    return strip_html(raw_content())


def author() -> Column:
    return null_if_empty(F.coalesce(F.col("creator"), F.col("author"), field("dc:creator")))


def first_image(html: Column) -> Column:
    return null_if_empty(F.regexp_extract(html, IMAGE_PATTERN, 1))


def image_url() -> Column:
    """Media url, else an image enclosure, else the first image in the content."""
    enclosure = F.col("enclosure")
    return F.coalesce(
        null_if_empty(field("media:content")["_url"]),
        F.when(
            F.startswith(enclosure["_type"], F.lit(IMAGE_TYPE_PREFIX)),
            null_if_empty(enclosure["_url"]),
        ),
        first_image(raw_content()),
    )


def _search_piece(piece: str) -> str:
    """A piece without % as a regular expression; _ is any one character."""

    def token(c: str) -> str:
        if c == "_":
            return "."
        return c if c.isalnum() or not c.isascii() else "\\" + c

    return "".join(token(c) for c in piece)


def contains_pattern(value: Column, search: str) -> Column:
    """Substring match ignoring ASCII case; % and _ in search stay wildcards.

    The i flag folds A-Z only, so accented letters must match as they are. Pieces
    between % are each taken at their first place, without backtracking.
    """
    pieces = [_search_piece(p) for p in search.split("%") if p]
    if len(pieces) > 1:
        pieces = [r"\A", *[f"(?>.*?{p})" for p in pieces]]
    return value.rlike("(?is)" + "".join(pieces))


def default_if_empty(value: Column, default: str) -> Column:
    return F.coalesce(null_if_empty(value), F.lit(default))
