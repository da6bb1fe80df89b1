"""Feed items to candidates for admission."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.url import url_key
from tidemark.sources.feed import in_categories


def to_candidates(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Items with a link that pass their source's category filter, keyed by canonical URL; other sources' items go."""
    filters = sources.select(F.col("id").alias("source_id"), "category_filter")
    kept = items.where(F.col("link") != "").join(filters, "source_id").where(in_categories(F.col("categories"), F.col("category_filter")))
    title = F.coalesce("title", F.lit("")).alias("title")
    return kept.select("source_id", "pos", url_key(F.col("link")).alias("id"), "link", title, "guid", "published_at", "content_html")
