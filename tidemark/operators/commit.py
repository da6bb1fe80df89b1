"""Admission of new items per source: threshold, first wins, cold start, cap, high-water mark.

A pure function of DataFrames; what is new is decided by date against the source's mark, not by absence from the table.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions.html import html_to_text


@dataclass
class Committed:
    """articles: rows to add; sources: all sources after the run; metrics: (source_id, added, carried_over, latest_published_at).

    All three read the candidates once judged, which are persisted until ``release``.
    """

    articles: DataFrame
    sources: DataFrame
    metrics: DataFrame
    judged: DataFrame

    def release(self) -> None:
        self.judged.unpersist()


def first_of_key(items: DataFrame, *key: str, order: str = "pos") -> DataFrame:
    """The first row of each key in document order, as an aggregate that is reduced before the shuffle."""
    row = F.struct(order, *(c for c in items.columns if c not in (order, *key)))
    return items.groupBy(*key).agg(F.min_by(row, F.struct(order)).alias("row")).select(*key, "row.*").select(items.columns)


def fresh_rows(candidates: DataFrame, sources: DataFrame, articles: DataFrame) -> DataFrame:
    """First candidates of each key with their source's ``mode`` and ``cold`` (no mark yet), and ``known``, ``fresh`` and ``stored``."""
    cold = ~F.coalesce("initialized", F.lit(False)) | F.col("latest_published_at").isNull()
    state = sources.select(F.col("id").alias("source_id"), F.col("latest_published_at").alias("mark"), cold.alias("cold"), "mode")
    stored = articles.select("id", F.lit(True).alias("stored"))
    rows = first_of_key(candidates, "source_id", "id").join(state, "source_id").join(stored, "id", "left")
    known = F.col("published_at").isNotNull()
    late = F.col("published_at") <= F.col("mark") - F.expr(f"interval {C.NEW_ITEM_GRACE_DAYS} days")
    flags = {"stored": F.coalesce("stored", F.lit(False)), "known": known, "fresh": known & ~F.coalesce(late, F.lit(False))}
    return rows.withColumns(flags).drop("mark")


def per_source(rows: DataFrame, limit: int | None) -> DataFrame:
    """What each source's rows come to: (source_id, cold, mode, newest, first_unknown, latest, carried_over).

    All are aggregates that are reduced before the shuffle, so that a source with most of the rows costs a row a task.
    """
    row = F.struct(*rows.columns)
    fresh, waiting = F.col("fresh"), F.col("fresh") & ~F.col("stored")
    over = F.lit(0) if limit is None else F.greatest(F.lit(0), F.col("waiting") - limit)
    carried = F.when(F.col("cold"), 0).otherwise(over).cast("int")
    return (
        rows.groupBy("source_id", "cold", "mode")
        .agg(
            F.max_by(row, F.when(fresh, F.struct("published_at", -F.col("pos")))).alias("newest"),
            F.min_by(row, F.when(~F.col("known"), F.col("pos"))).alias("first_unknown"),
            F.max(F.when(fresh, F.col("published_at"))).alias("latest"),
            F.count(F.when(waiting, 1)).alias("waiting"),
        )
        .withColumn("carried_over", carried)
        .drop("waiting")
    )


def as_articles(taken: DataFrame, now: datetime) -> DataFrame:
    """Candidates as new articles; an unknown date is ``now`` for the time being."""
    null = lambda kind: F.lit(None).cast(kind)
    at = F.lit(now).cast("timestamp")
    return taken.select(
        "id",
        "source_id",
        "guid",
        "title",
        F.col("link").alias("url"),
        F.coalesce("published_at", at).alias("published_at"),
        F.col("published_at").isNull().alias("published_at_provisional"),
        at.alias("created_at"),
        F.when(F.col("content_html") != "", html_to_text(F.col("content_html"))).alias("rss_summary"),
        null("string").alias("content_text"),
        F.lit("none").alias("content_source"),
        F.lit(0).alias("content_chars"),
        null("struct<headline:string,brief:string,digest:array<string>,detail:string,tags:array<string>>").alias("summary"),
        F.lit("new").alias("status"),
        null("string").alias("error"),
        F.lit(0).alias("attempts"),
        null("string").alias("model"),
        *(null("timestamp").alias(c) for c in ("summarizing_at", "summarized_at", "read_at")),
    )


def commit(candidates: DataFrame, sources: DataFrame, articles: DataFrame, now: datetime, *, limit: int | None = C.MAX_NEW_PER_SOURCE_PER_RUN, modes: DataFrame | None = None) -> Committed:
    """Admit candidates(source_id, pos, id, link, title, guid, published_at, content_html) of one run.

    ``limit`` is the cap of a source and run; None takes all. ``modes(source_id, mode)`` lists the sources that were fetched, as feed or listing; without it all that have candidates are
    feeds. A source that was fetched without candidates is initialized too. The mark never moves back; while items are carried
    over it only moves to what was added, and validators are not kept, so that the next run sees them again.
    """
    counted = candidates.groupBy("source_id").agg(F.count("*").cast("int").alias("seen"))
    if modes is None:
        modes = counted.select("source_id", F.lit("feed").alias("mode"))
    fetched = modes.select(F.col("source_id").alias("id"), "mode")
    limit = None if limit is None else max(0, int(limit))
    rows = fresh_rows(candidates, sources.join(fetched, "id"), articles).persist()
    found = per_source(rows, limit)
    first_cold = found.where("cold and newest is not null and not newest.stored").select("newest.*")
    undated = "mode = 'listing' and first_unknown is not null and not first_unknown.stored and not (cold and newest is not null)"
    oldest = rows.where("fresh and not stored and not cold")
    if limit is not None:  # cut in every task before rows of a source meet
        place = F.row_number().over(W.partitionBy("source_id").orderBy("published_at", "pos"))
        oldest = oldest.withColumn("place", place).where(F.col("place") <= limit).drop("place")
    taken = first_cold.unionByName(oldest).unionByName(found.where(undated).select("first_unknown.*"))
    added = taken.groupBy("source_id").agg(F.count("*").cast("int").alias("added"), F.max("published_at").alias("latest_added"))
    reached = F.when(F.col("cold"), F.col("newest.published_at")).when(F.col("carried_over") > 0, F.col("latest_added")).otherwise(F.col("latest"))
    sums = found.join(added, "source_id", "left").select(F.col("source_id").alias("id"), "added", "carried_over", reached.alias("reached"))
    run = fetched.join(sums, "id", "left").join(counted.withColumnRenamed("source_id", "id"), "id", "left")
    after = sources.join(run, "id", "left")
    ran = F.col("mode").isNotNull()
    new = {
        "initialized": F.when(ran, True).otherwise(F.col("initialized")),
        "latest_published_at": F.greatest("latest_published_at", "reached"),
        "last_fetched_at": F.when(ran, F.lit(now).cast("timestamp")).otherwise(F.col("last_fetched_at")),
        "last_item_count": F.when(ran, F.coalesce("seen", F.lit(0))).otherwise(F.col("last_item_count")),
        "last_status": F.when(ran, "ok").otherwise(F.col("last_status")),
        "last_error": F.when(~ran, F.col("last_error")),
        "last_fetch_mode": F.coalesce("mode", "last_fetch_mode"),
        "etag": F.when(F.coalesce(F.col("carried_over"), F.lit(0)) == 0, F.col("etag")),
        "last_modified": F.when(F.coalesce(F.col("carried_over"), F.lit(0)) == 0, F.col("last_modified")),
    }
    after = after.withColumns(new)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    metrics = after.where(ran).select(F.col("id").alias("source_id"), zero("added"), zero("carried_over"), "latest_published_at")
    return Committed(as_articles(taken, now), after.select(sources.columns), metrics, rows)
