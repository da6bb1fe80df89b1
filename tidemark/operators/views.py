"""Read-side queries: article lists, cards, threads, reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import collapse_space, summary_as_text


def article_list(articles: DataFrame, sources: DataFrame, *, source_ids: list[str] | None = None, unread_only: bool = False, status: str = "all") -> DataFrame:
    """Cards, newest first; filters reach the scan, and the content is never read."""
    rows = articles
    if source_ids:
        rows = rows.where(F.col("source_id").isin(*source_ids))
    if unread_only:
        rows = rows.where(F.col("read_at").isNull())
    if status != "all":
        rows = rows.where(F.col("status").isin("new", "summarizing") if status == "summarizing" else F.col("status") == status)
    names = sources.select(F.col("id").alias("source_id"), "name")
    cards = rows.join(names, "source_id", "left").select(
        "id",
        "source_id",
        F.coalesce("name", "source_id").alias("source_name"),
        F.coalesce("summary.headline", "title").alias("headline"),
        F.array_distinct("summary.tags").alias("tags"),
        "published_at",
        status_label(F.col("status")).alias("label"),
        F.col("read_at").isNotNull().alias("is_read"),
    )
    return cards.orderBy(F.desc_nulls_last("published_at"), "id")


def status_label(status: Column) -> Column:
    return F.when(status == "done", "").when(status == "error", "error").otherwise("summarizing")


def chat_context(articles: DataFrame) -> DataFrame:
    """(id, context): the content, else the summary as text, else the feed's summary, else the title; empty strings are passed over."""
    some = lambda c: F.nullif(c, F.lit(""))
    summary = F.when(F.col("summary").isNotNull(), summary_as_text(F.col("summary")))
    return articles.select("id", F.coalesce(some(F.col("content_text")), summary, some(F.col("rss_summary")), F.col("title")).alias("context"))


def threads(messages: DataFrame, thread: str, order: str, *fields: str) -> DataFrame:
    """(thread, messages, n): the messages of each thread in order."""
    each = F.array_sort(F.collect_list(F.struct(order, *fields)))
    return messages.groupBy(thread).agg(each.alias("messages")).withColumn("n", F.size("messages").cast("long"))


def append_messages(chats: DataFrame, new: DataFrame, now: datetime) -> DataFrame:
    """Chats with new(article_id, pos, role, content, refused) put at the end by ``pos``, or as new threads; refused answers are not kept.

    Without ``pos`` a thread can have one new message at most, since rows of a DataFrame have no order.
    """
    at = F.lit(now).cast("timestamp").alias("created_at")
    ordered = "pos" in new.columns
    message = F.struct((F.col("pos") if ordered else F.lit(0)).alias("pos"), "role", "content", at)
    one = new.where(~F.coalesce("refused", F.lit(False))).groupBy("article_id").agg(F.array_sort(F.collect_list(message)).alias("more"))
    if not ordered:
        one = one.where(F.assert_true(F.size("more") <= 1, F.lit("several new messages of a thread need pos")).isNull())
    more = F.transform("more", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), m["created_at"].alias("created_at")))
    both = chats.join(one, "article_id", "full_outer")
    none = F.array().cast("array<struct<role:string,content:string,created_at:timestamp>>")
    messages = F.concat(F.coalesce("messages", none), F.coalesce(more, none))
    return both.select("article_id", messages.alias("messages"), F.when(F.col("more").isNotNull(), F.lit(now).cast("timestamp")).otherwise(F.col("updated_at")).alias("updated_at"))


def with_chat(articles: DataFrame, chats: DataFrame) -> DataFrame:
    """(id, title, context, messages, updated_at): articles with what a chat starts from and their thread; null without one."""
    thread = chats.select(F.col("article_id").alias("id"), history(F.col("messages")).alias("messages"), "updated_at")
    return articles.select("id", "title").join(chat_context(articles), "id").join(thread, "id", "left")


def clear_chats(chats: DataFrame, ids: DataFrame) -> DataFrame:
    return chats.join(ids.select("article_id"), "article_id", "left_anti")


def history(messages: Column) -> Column:
    """Role and content of each message."""
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))


def mark_read(articles: DataFrame, ids: DataFrame, now: datetime) -> DataFrame:
    """Articles with the time of their first opening."""
    opened = ids.select("id", F.lit(True).alias("opened"))
    both = articles.join(opened, "id", "left")
    read = F.coalesce("read_at", F.when(F.col("opened"), F.lit(now).cast("timestamp")))
    return both.withColumn("read_at", read).select(articles.columns)


def batch_status(articles: DataFrame, ids: DataFrame, most: int = 30) -> DataFrame:
    """One row on a batch: done, failed and, as "title: error", the first ``most`` that failed by id; articles that are gone count as neither (A5).

    A batch of the queue has no more than ``most``; of a larger one ``batch_errors`` has all. Each task counts and cuts before rows move.
    """
    first = batch_errors(articles, ids).orderBy("id").limit(most)
    none = F.lit(0).cast("long")
    parts = batch_counts(articles, ids).select("done", "failed", F.lit(None).cast("string").alias("told"))
    parts = parts.unionByName(first.select(none.alias("done"), none.alias("failed"), F.col("error").alias("told")))
    return parts.agg(F.sum("done").alias("done"), F.sum("failed").alias("failed"), F.array_sort(F.collect_list("told")).alias("errors"))


def batch_counts(articles: DataFrame, ids: DataFrame) -> DataFrame:
    """One row on a batch of any size: done and failed, as in ``batch_status``, counted before the shuffle."""
    both = ids.select("id").join(articles.select("id", "status"), "id", "left")
    return both.agg(F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "error").alias("failed"))


def batch_errors(articles: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, error): what failed in a batch as "title: error", a row each, so that no task holds them all."""
    bad = articles.where("status = 'error'").select("id", F.concat_ws(": ", "title", "error").alias("error"))
    return ids.select("id").join(bad, "id")


def newest_dated(items: DataFrame, *key: str) -> DataFrame:
    """The newest item of each key; undated ones lose to dated ones, ties go to the first."""
    row = F.struct(*(c for c in items.columns if c not in key))
    # an undated item ranks below any date
    rank = F.struct(F.col("published_at").isNotNull(), F.coalesce("published_at", F.lit(datetime(1970, 1, 1)).cast("timestamp")), -F.col("pos"))
    return items.groupBy(*key).agg(F.max_by(row, rank).alias("row")).select(*key, "row.*")


def feed_tests(items: DataFrame) -> DataFrame:
    """A row per feed: format, items, dated items, first item in document order, and the newest by date."""
    first = F.min_by(F.struct("title", "published_at"), "pos").alias("first")
    counts = items.groupBy("source_id").agg(F.max("format").alias("format"), F.count("pos").alias("items"), F.count("published_at").alias("dated"), F.max("error").alias("error"), first)
    newest = newest_dated(items.where("pos is not null").select("source_id", "pos", "title", "published_at"), "source_id")
    newest = newest.select("source_id", F.struct("title", "published_at").alias("newest"))
    return counts.join(newest, "source_id", "left")


def failed_primaries(tests: DataFrame, seed: DataFrame) -> DataFrame:
    """(name, id, listing_url, listing_link_pattern): failed primary feeds of checks(name, is_primary, ok) that the seed gives a listing to."""
    failed = tests.where("is_primary and not ok").select("name").distinct()
    return failed.join(seed.where("listing_url is not null and listing_link_pattern is not null").select("name", "id", "listing_url", "listing_link_pattern"), "name")


def rescued_names(tests: DataFrame, rescued: DataFrame) -> DataFrame:
    """(name): the failed primaries of checks(name, is_primary, ok) that rescued(name) has, a row each; all that ``health`` names some of."""
    return tests.where("is_primary and not ok").select("name").distinct().join(rescued.select("name").distinct(), "name", "left_semi")


def health(tests: DataFrame, rescued: DataFrame, most: int = 30) -> DataFrame:
    """One row on checks(name, is_primary, ok): primaries that work, all primaries, the failed ones that a listing rescues (the first
    ``most`` names), and how many are left. Each task counts and cuts before rows move.
    """
    saved = rescued.select("name", F.lit(True).alias("saved")).distinct()
    primary = tests.where("is_primary").join(saved, "name", "left")
    names = primary.where("not ok and saved").select("name").distinct()
    none = F.lit(0).cast("long")
    sums = primary.agg(F.count_if("ok").alias("ok"), F.count("*").alias("total"), F.count_distinct(F.when(~F.col("ok") & F.col("saved"), F.col("name"))).alias("saved"))
    parts = sums.withColumn("name", F.lit(None).cast("string"))
    parts = parts.unionByName(names.orderBy("name").limit(most).select("name", none.alias("ok"), none.alias("total"), none.alias("saved")))
    out = parts.agg(*(F.sum(c).alias(c) for c in ("ok", "total", "saved")), F.array_sort(F.collect_list("name")).alias("rescued"))
    return out.select("ok", "total", "rescued", (F.col("total") - F.col("ok") - F.col("saved")).alias("unrescued"))


def report_cells(rows: DataFrame, width: int = 60, exempt: tuple[str, ...] = ("url",)) -> DataFrame:
    """Every column as a report cell: on one line, at most ``width`` characters with an ellipsis, URLs whole."""

    def cell(name: str) -> Column:
        s = collapse_space(F.coalesce(F.col(name).cast("string"), F.lit("")))
        return (s if name in exempt else F.when(F.length(s) > width, F.concat(F.substring(s, 1, width - 1), F.lit("…"))).otherwise(s)).alias(name)

    return rows.select(*(cell(c) for c in rows.columns))


def column_widths(cells: DataFrame) -> DataFrame:
    return cells.agg(*(F.max(F.length(c)).alias(c) for c in cells.columns))


def run_summary(metrics: DataFrame, status: DataFrame) -> DataFrame:
    """One row on a run: new items, summaries done and failed, and whether it is worth a notification."""
    none = F.lit(0).cast("long")
    parts = metrics.select(F.col("added").cast("long").alias("new"), none.alias("done"), none.alias("failed"))
    parts = parts.unionByName(status.select(none.alias("new"), "done", "failed"))
    return parts.agg(*(F.sum(c).alias(c) for c in ("new", "done", "failed"))).withColumn("notify", F.col("new") > 0)
