"""The enrichment queue: recovery, choice, content, and what each article becomes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions.text import SKIPPED, UNREADABLE, choose_content, error_message, is_billing_or_auth, parse_summary, truncate, utf16_length

#: The kind of what was not asked since the batch was stopped.
STOPPED = "stopped"
_ANSWER = "id string, answer string, error_kind string, error_status int, error_text string"


def _at(now: datetime) -> Column:
    return F.lit(now).cast("timestamp")


def is_orphan(now: datetime) -> Column:
    """New articles, and those whose summary began at least 15 minutes ago and never ended."""
    began = F.coalesce("summarizing_at", F.lit(datetime(1970, 1, 1)).cast("timestamp"))
    stale = _at(now) - F.expr(f"interval {C.SUMMARIZING_STALE_MINUTES} minutes") >= began
    return (F.col("status") == "new") | ((F.col("status") == "summarizing") & stale)


def recover(articles: DataFrame, now: datetime) -> DataFrame:
    """Stale summarizing articles become new again."""
    stale = is_orphan(now) & (F.col("status") == "summarizing")
    new = {"status": F.when(stale, "new").otherwise(F.col("status")), "summarizing_at": F.when(~stale, F.col("summarizing_at"))}
    return articles.withColumns(new)


def lock_is_active(running: bool, started_at: datetime | None, now: datetime) -> bool:
    return bool(running and started_at is not None and now - started_at < timedelta(minutes=C.LOCK_STALE_MINUTES))


def choose(queue: DataFrame, limit: int = C.MAX_SUMMARIES_PER_RUN) -> tuple[DataFrame, DataFrame]:
    """(the newest ``limit`` of the queue, what is carried over). An unknown date is oldest; ties go by id."""
    top = queue.orderBy(F.desc_nulls_last("published_at"), "id").limit(max(0, int(limit)))
    return top, queue.join(top.select("id"), "id", "left_anti")


def extractive_stub(title: str, text: str) -> dict:
    """A stand-in for a model: the first sentences of the text."""
    parts = [p.strip() for p in text.replace("\n", " ").split(". ") if p.strip()]
    return {"headline": title[:40], "brief": ". ".join(parts[:3]), "digest": parts[:5], "detail": ". ".join(parts[:10]), "tags": []}


def orphan_count(articles: DataFrame, now: datetime) -> DataFrame:
    """One row: how many articles wait to be enriched."""
    return articles.where(is_orphan(now)).agg(F.count("*").alias("orphans"))


def stops(status: int | None, message: str | None) -> bool:
    """Whether an error is one after which no more is asked, as in ``is_billing_or_auth``."""
    return status == 401 or status == 400 and "credit balance" in (message or "").lower()


class StopMarker:
    """A file that tells all tasks of a batch to ask no more. ``folder`` is a URI that tasks reach through pyarrow, as they do a shared disk, HDFS or S3."""

    def __init__(self, folder: str):
        self.path = f"{folder.rstrip('/')}/stop-{uuid.uuid4().hex}"

    def _file(self):
        system, path = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        return system, path

    def is_set(self) -> bool:
        system, path = self._file()
        return system.get_file_info(path).type != fs.FileType.NotFound

    def set(self) -> None:
        system, path = self._file()
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(path) as out:
            out.write(b"stop")


def ask(rows: DataFrame, enricher: Callable[[dict], str], parallelism: int | None = None, marker: StopMarker | None = None) -> DataFrame:
    """(id, answer or error) of an injected model call on rows(id, title, url, source_name, content_source, text).

    There is a call at a time in each partition of ``rows``; ``parallelism`` deals them to so many, where a service limits calls. A call that raises
    is a row with the error's ``kind`` and ``status`` attributes and stops no other, unless it is an error of billing or authorisation: then
    the partition's other rows are not asked about and have the kind "stopped", and with a ``marker`` those of all partitions, which look at it
    before every call: a call that is under way ends, and none begins.
    """
    columns = [c.split()[0] for c in _ANSWER.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stopped = False
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                stopped = stopped or marker is not None and marker.is_set()
                if stopped:
                    out.append({"id": row["id"], "error_kind": STOPPED})
                    continue
                try:
                    out.append({"id": row["id"], "answer": enricher(row)})
                except Exception as e:  # noqa: BLE001  one article's failure is data
                    status, told = getattr(e, "status", None), str(e) or type(e).__name__
                    stopped = stops(status, told)
                    if stopped and marker is not None:
                        marker.set()
                    out.append({"id": row["id"], "error_kind": getattr(e, "kind", None), "error_status": status, "error_text": told})
            frame = pd.DataFrame(out, columns=columns).astype(object)
            yield frame.where(frame.notna(), None)

    return (rows if parallelism is None else rows.repartition(parallelism)).mapInPandas(run, _ANSWER)


def claim(articles: DataFrame, now: datetime, limit: int = C.MAX_SUMMARIES_PER_RUN) -> tuple[DataFrame, DataFrame]:
    """(claimed, freed): the newest ``limit`` of the waiting articles as summarizing since ``now``, and the other stale ones as new again.

    A claim is a lease: who holds it for 15 minutes without a result has lost it.
    """
    waiting = articles.where(is_orphan(now))
    keys = choose(waiting.select("id", "published_at"), limit)[0].select("id")  # chosen by key and date: texts don't move for it
    claimed = waiting.join(keys, "id", "left_semi").withColumns({"status": F.lit("summarizing"), "summarizing_at": _at(now)})
    stale = waiting.where(F.col("status") == "summarizing").join(keys, "id", "left_anti")
    return claimed.select(articles.columns), recover(stale, now).select(articles.columns)


def unclaimed(articles: DataFrame) -> DataFrame:
    """Claimed articles that were not asked about, as new again."""
    return articles.withColumns({"status": F.lit("new"), "summarizing_at": F.lit(None).cast("timestamp")})


def redate(articles: DataFrame, pages: DataFrame, sources: DataFrame, *, drop_old: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(articles, sources, dropped): provisional dates replaced by those of pages(id, published_at).

    With ``drop_old`` an article whose real date is at or below its source's threshold goes. Marks only rise. All articles are held
    against the marks at the start of the batch.
    """
    real = pages.select("id", F.col("published_at").alias("real"))
    marks = sources.select(F.col("id").alias("source_id"), F.col("latest_published_at").alias("mark"))
    rows = articles.join(real, "id", "left").join(marks, "source_id", "left")
    moves = F.coalesce(F.col("published_at_provisional") & F.col("real").isNotNull(), F.lit(False))
    old = moves & F.coalesce(F.col("real") <= F.col("mark") - F.expr(f"interval {C.NEW_ITEM_GRACE_DAYS} days"), F.lit(False)) & F.lit(drop_old)
    rows = rows.withColumn("moves", moves).withColumn("old", old)
    kept = rows.where("not old")
    reached = kept.where("moves").groupBy(F.col("source_id").alias("id")).agg(F.max("real").alias("reached"))
    after = sources.join(reached, "id", "left").withColumn("latest_published_at", F.greatest("latest_published_at", "reached")).select(sources.columns)
    new = {"published_at": F.when(F.col("moves"), F.col("real")).otherwise(F.col("published_at")), "published_at_provisional": F.col("published_at_provisional") & ~F.col("moves")}
    return kept.withColumns(new).select(articles.columns), after, rows.where("old").select("id")


def with_content(articles: DataFrame, pages: DataFrame, max_chars: int = C.MAX_CONTENT_CHARS) -> DataFrame:
    """Articles with the text to summarize from pages(id, text), where it is from, and ``skip`` if there is none."""
    rows = articles.join(pages.select("id", F.col("text").alias("page_text")), "id", "left")
    rows = rows.withColumn("chosen", choose_content(F.col("page_text"), F.col("rss_summary")))
    rows = rows.withColumns({"content_source": F.col("chosen.content_source"), "text": truncate(F.col("chosen.text"), max_chars)})
    skip = (F.col("content_source") == "none") & (F.coalesce("rss_summary", F.lit("")) == "")
    return rows.withColumn("skip", skip).drop("chosen", "page_text")


def enrich(articles: DataFrame, pages: DataFrame, sources: DataFrame, enricher: Callable[[dict], str], now: datetime, *, model: str = "stub", max_chars: int = C.MAX_CONTENT_CHARS, parallelism: int | None = None, marker: StopMarker | None = None, keep: Callable[[DataFrame], DataFrame] = lambda answers: answers) -> DataFrame:
    """Chosen articles after their summary: done, or error with one more attempt; ``stops_batch`` marks errors after which no more is asked, and
    the articles that were not asked about then.

    Articles without any text are not asked about. An error is not tried again by itself. ``keep`` may store the answers, so that nothing that
    is computed from them later asks again.
    """
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    rows = with_content(articles, pages, max_chars).join(names, "source_id", "left")
    asked = rows.where("not skip").select("id", "title", "url", F.coalesce("source_name", "source_id").alias("source_name"), "content_source", "text")
    both = rows.join(keep(ask(asked, enricher, parallelism, marker)), "id", "left").withColumn("parsed", parse_summary(F.col("answer")))
    done = F.col("parsed").isNotNull()
    unreadable = F.concat(F.lit(UNREADABLE), F.substring("answer", 1, 200))
    told = F.when(F.col("skip"), SKIPPED).when(F.col("answer").isNotNull(), unreadable).otherwise(error_message(F.col("error_kind"), F.col("error_status"), F.col("error_text")))
    after = lambda new, old: F.when(done, new).otherwise(F.col(old))
    out = both.withColumns(
        {
            "status": F.when(done, "done").otherwise("error"),
            "error": F.when(~done, told),
            "attempts": F.col("attempts") + F.when(done, 0).otherwise(1),
            "summary": after(F.col("parsed"), "summary"),
            "content_text": after(F.col("text"), "content_text"),
            "content_chars": after(utf16_length(F.col("text")), "content_chars"),
            "model": after(F.lit(model), "model"),
            "summarized_at": after(_at(now), "summarized_at"),
            "summarizing_at": F.lit(None).cast("timestamp"),
            "stops_batch": is_billing_or_auth(F.col("error_status"), F.col("error_text")) | F.coalesce(F.col("error_kind") == STOPPED, F.lit(False)),
        }
    )
    return out.select(*articles.columns, "stops_batch")
