"""From feed items to articles, one narrow projection per step."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions import dates, text


def is_valid_item() -> Column:
    """Title and link are set and not empty, untrimmed."""
    return F.coalesce((F.col("title") != "") & (F.col("link") != ""), F.lit(False))


def valid_items(items: DataFrame) -> DataFrame:
    return items.filter("title <> '' AND link <> ''")


def with_content_hash(items: DataFrame, empty_content: str = "collapse") -> DataFrame:
    return items.withColumn("contentHash", text.content_hash(empty_content))


def article_projection(items: DataFrame, *keep: str) -> DataFrame:
    """Article columns of hashed items, plus the columns named in keep."""
    dated = items if "publishedAt" in items.columns else dates.with_published(items)
    return dated.select(
        *keep,
        "title",
        F.col("link").alias("url"),
        "contentHash",
        "source",
        text.description().alias("description"),
        text.author().alias("author"),
        "publishedAt",
        text.image_url().alias("imageUrl"),
    )
