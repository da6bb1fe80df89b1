"""Source rows: seeding, overrides, enabling, resets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a reset clears; when a source was last fetched stays.
RESET = ("etag", "last_modified", "last_status", "last_error", "last_item_count", "latest_published_at", "last_fetch_mode")
_FIXED = ("name", "alt_feed_urls", "site_url", "category_filter", "listing_url", "listing_link_pattern", "listing_exclude_pattern")


def upsert_sources(seed: DataFrame, stored: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Seed rows with the state that is stored for them; stored sources that are no longer seeded stay.

    ``overrides(id, feed_url)`` replace feed URLs. Where the feed URL changed, validators are forgotten.
    """
    fixed = seed.select("id", "feed_url", *_FIXED)
    if overrides is not None:
        fixed = fixed.join(overrides.select("id", F.col("feed_url").alias("override")), "id", "left")
        fixed = fixed.withColumn("feed_url", F.coalesce("override", "feed_url")).drop("override")
    state = [c for c in stored.columns if c not in (*_FIXED, "feed_url")]
    old = stored.select(*state, F.col("feed_url").alias("old_url"), F.lit(True).alias("is_stored"))
    both = fixed.join(old, "id", "left")
    moved = F.col("is_stored") & ~F.col("old_url").eqNullSafe(F.col("feed_url"))
    both = both.withColumns({c: F.when(~F.coalesce(moved, F.lit(False)), F.col(c)) for c in ("etag", "last_modified")})
    both = both.withColumn("initialized", F.coalesce("initialized", F.lit(False)))
    gone = stored.join(seed.select("id"), "id", "left_anti")
    return both.select(stored.columns).unionByName(gone)


def enabled(sources: DataFrame, ids: DataFrame) -> DataFrame:
    """Sources whose id is enabled."""
    return sources.join(ids.select("id"), "id", "left_semi")


def reset_source(source_id: str, sources: DataFrame, articles: DataFrame, chats: DataFrame, *, running: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sources, articles, chats, deleted): a source as if never fetched, without its articles and their chats; ``deleted`` counts articles.

    Refused while a run holds the lock.
    """
    if running:
        raise RuntimeError("a run is in progress")
    own = articles.where(F.col("source_id") == source_id)
    mine = F.col("id") == source_id
    cleared = {c: F.when(~mine, F.col(c)) for c in RESET} | {"initialized": ~mine & F.col("initialized")}
    left = chats.join(own.select(F.col("id").alias("article_id")), "article_id", "left_anti")
    return sources.withColumns(cleared), articles.where(~F.col("source_id").eqNullSafe(source_id)), left, own.agg(F.count("*").alias("deleted"))


def reset_all(seed: DataFrame, sources: DataFrame, articles: DataFrame, chats: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Freshly seeded sources and empty tables; settings are not touched."""
    return upsert_sources(seed, sources.limit(0)), articles.limit(0), chats.limit(0)


def record_failures(sources: DataFrame, failures: DataFrame, now) -> DataFrame:
    """Sources with the status of failures(source_id, error)."""
    told = failures.select(F.col("source_id").alias("id"), F.col("error").alias("told"))
    both = sources.join(told, "id", "left")
    bad = F.col("told").isNotNull()
    new = {
        "last_status": F.when(bad, "error").otherwise(F.col("last_status")),
        "last_error": F.coalesce("told", "last_error"),
        "last_fetched_at": F.when(bad, F.lit(now).cast("timestamp")).otherwise(F.col("last_fetched_at")),
    }
    return both.withColumns(new).select(sources.columns)


def save_validators(sources: DataFrame, fetches: DataFrame, metrics: DataFrame) -> DataFrame:
    """Sources with the validators of their fetch, unless items were carried over: then the next run must see the feed again."""
    got = fetches.select(F.col("source_id").alias("id"), F.col("etag").alias("new_etag"), F.col("last_modified").alias("new_modified"))
    whole = metrics.where("carried_over = 0").select(F.col("source_id").alias("id"), F.lit(True).alias("whole"))
    both = sources.join(got.join(whole, "id"), "id", "left")
    kept = {c: F.when(F.col("whole"), F.col(n)).otherwise(F.col(c)) for c, n in (("etag", "new_etag"), ("last_modified", "new_modified"))}
    return both.withColumns(kept).select(sources.columns)


def first_working_alternate(tests: DataFrame) -> DataFrame:
    """(source_id, url): of tests(source_id, pos, url, ok) the first that works, which becomes the override."""
    return tests.where("ok").groupBy("source_id").agg(F.min_by("url", "pos").alias("url"))
