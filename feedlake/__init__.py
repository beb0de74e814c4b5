"""Deduplicated news-article table on Spark: feed ingest, catalog queries, reports."""
