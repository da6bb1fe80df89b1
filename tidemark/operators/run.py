"""A refresh from fetched documents to stored articles, and the enrichment after it, over a Store."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.operators import enrich as E
from tidemark.operators.candidates import to_candidates
from tidemark.operators.commit import commit
from tidemark.operators.sources import record_failures, save_validators
from tidemark.sources.feed import read_feeds
from tidemark.sources.fetch import outcome
from tidemark.sources.listing import as_feed_items, read_listings
from tidemark.sources.store import Store, shared_root


def refresh(store: Store, feeds: DataFrame, listings: DataFrame | Callable[[DataFrame], DataFrame] | None, now: datetime, *, limit: int = C.MAX_NEW_PER_SOURCE_PER_RUN, batch: str | None = None, writer: str = "") -> DataFrame:
    """Admit what the fetches hold and return metrics(source_id, added, carried_over, latest_published_at).

    A feed that failed or did not parse falls back to its source's listing; where that fails or has no link too, the source gets both errors.
    ``listings`` holds fetched listing pages, or is a function that fetches targets(source_id, url, etag, last_modified), which are those of failed feeds.
    Unchanged feeds (304) touch nothing. Articles, marks and validators become visible together; stored articles are not written anew, and only
    folders that may hold a candidate are opened. A repeated ``batch`` of a ``writer`` changes nothing.
    """
    sources = store.read("sources")
    seen = outcome(feeds)
    parsed = read_feeds(seen.where("kind = 'ok'")).persist()
    failed = seen.where("kind = 'failed'").select("source_id", F.coalesce("error", F.lit("failed")).alias("feed_error"))
    failed = failed.unionByName(parsed.where("error is not null").select("source_id", F.col("error").alias("feed_error")))
    shape = ("source_id", "pos", "title", "link", "guid", "published_at", "categories", "content_html", "has_full_content")
    items = parsed.where("pos is not null").select(*shape)
    modes = parsed.where("error is null").select("source_id").distinct().withColumn("mode", F.lit("feed"))
    told = failed.withColumn("listing_error", F.lit(None).cast("string"))
    links = None
    if listings is not None:
        config = sources.where("listing_url is not null and listing_link_pattern is not null").select(
            F.col("id").alias("source_id"), F.col("listing_url").alias("base_url"), F.col("listing_link_pattern").alias("pattern"), F.col("listing_exclude_pattern").alias("exclude_pattern")
        )
        if callable(listings):
            targets = config.select("source_id", F.col("base_url").alias("url")).join(failed.select("source_id"), "source_id", "left_semi")
            listings = listings(targets.select("*", *(F.lit(None).cast("string").alias(c) for c in ("etag", "last_modified"))))
        got = outcome(listings).join(failed.select("source_id"), "source_id", "left_semi")
        pages = got.where("kind = 'ok'").join(config, "source_id").select(F.col("source_id").alias("page"), F.col("body").alias("html"), "base_url", "pattern", "exclude_pattern")
        links = as_feed_items(read_listings(pages, now)).persist()
        items = items.unionByName(links.select(*shape))
        rescued = links.select("source_id").distinct()
        modes = modes.unionByName(rescued.withColumn("mode", F.lit("listing")))
        errors = got.select("source_id", F.coalesce("error", F.lit("no links")).alias("listing_error"))
        told = failed.join(errors, "source_id", "left").join(rescued, "source_id", "left_anti")
    found = to_candidates(items, sources).persist()  # read by the lookup and twice by the commit
    stored = store.lookup("articles", found.select("id"))
    done = commit(found, sources, stored, now, limit=limit, modes=modes)
    failures = told.select("source_id", F.concat_ws("; ", "feed_error", "listing_error").alias("error"))
    after = save_validators(record_failures(done.sources, failures, now), feeds.where("status between 200 and 299"), done.metrics)
    metrics = _kept(done.metrics)  # before the tables that it is computed from are replaced
    store.write(batch, writer, append={"articles": done.articles}, sources=after)
    done.release()
    for used in (parsed, links, found):
        if used is not None:
            used.unpersist()
    return metrics


def _kept(rows: DataFrame, name: str = "run-result") -> DataFrame:
    """A run's result in a file of the shared folder, so that it needs neither memory nor the tables that it was computed from."""
    path = f"{shared_root(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def claim(store: Store, now: datetime, *, limit: int = C.MAX_SUMMARIES_PER_RUN, batch: str | None = None, writer: str = "") -> DataFrame:
    """Claim the newest waiting articles as summarizing, free claims that were lost, and return the claimed ones: the first of two commits.

    A job that dies after this leaves claims that lapse in 15 minutes, after which ``is_orphan`` finds them. A repeated ``batch`` of a ``writer`` claims
    nothing, and returns what is claimed since ``now``.
    """
    if batch is None or store.batch(writer) != batch:
        stored = store.read("articles")
        claimed, freed = E.claim(stored, now, limit)
        store.write(batch, writer, upsert={"articles": (claimed.unionByName(freed), stored.select("id").limit(0))})
    return store.read("articles").where((F.col("status") == "summarizing") & (F.col("summarizing_at") == F.lit(now).cast("timestamp")))


def finish(store: Store, claimed: DataFrame, pages: DataFrame, enricher: Callable[[dict], str], now: datetime, *, parallelism: int | None = None, batch: str | None = None, writer: str = "") -> DataFrame:
    """Ask about claimed articles and store what comes of it: the second commit. Returns the ids that were claimed.

    Answers are stored as they come, and are what all that follows reads: a lost executor costs the calls that it had not ended. Articles that turn out
    old are deleted. After an error of billing or authorisation no task asks any more; that article and those not asked about are new again.
    """
    sources = store.read("sources")
    dated, after, old = E.redate(claimed, pages, sources, drop_old=True)
    marker = E.StopMarker(shared_root(store.spark))
    result = _kept(E.enrich(dated, pages, sources, enricher, now, parallelism=parallelism, marker=marker, keep=lambda a: _kept(a, "answers")))
    freed = E.unclaimed(claimed.join(result.where("stops_batch").select("id"), "id", "left_semi").select(claimed.columns))
    told = result.where("not stops_batch").drop("stops_batch").unionByName(freed)
    ids = _kept(result.select("id"))
    store.write(batch, writer, upsert={"articles": (told, old)}, sources=after)
    return ids


def summarize(store: Store, pages: DataFrame, enricher: Callable[[dict], str], now: datetime, *, limit: int = C.MAX_SUMMARIES_PER_RUN, parallelism: int | None = None, batch: str | None = None, writer: str = "") -> DataFrame:
    """Enrich the newest waiting articles with pages(id, text, published_at) and return their ids: ``claim``, then ``finish``. Only rows that change are written."""
    claimed = claim(store, now, limit=limit, batch=batch and f"{batch}.claim", writer=writer)
    return finish(store, claimed, pages, enricher, now, parallelism=parallelism, batch=batch, writer=writer)


def resummarize(store: Store, article_id: str, pages: DataFrame, enricher: Callable[[dict], str], now: datetime, *, refetch: bool = False) -> None:
    """Enrich one article again, whatever its status, with pages(id, text, published_at); without a lock (M6).

    It is summarizing while the model is asked, never new, so that no run picks it up. With ``refetch`` its stored content is forgotten first, so
    that a failure leaves it without. A provisional date is replaced, but the article is never deleted as old. An error of billing or
    authorisation is stored like any other.
    """
    sources = store.read("sources")
    one = store.read("articles").where(F.col("id") == article_id).withColumns({"status": F.lit("summarizing"), "summarizing_at": F.lit(now).cast("timestamp")})
    if refetch:
        one = one.withColumns({"content_text": F.lit(None).cast("string"), "content_source": F.lit("none"), "content_chars": F.lit(0)})
    one = _kept(one, "claimed")
    store.write(upsert={"articles": (one, one.select("id").limit(0))})
    dated, after, none = E.redate(one, pages, sources, drop_old=False)
    result = E.enrich(dated, pages, sources, enricher, now, keep=lambda a: _kept(a, "answers")).drop("stops_batch")
    store.write(upsert={"articles": (result, none)}, sources=after)
