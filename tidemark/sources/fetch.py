"""Fetching feeds and pages over HTTP as a Spark data source."""

from __future__ import annotations

import http.client
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from urllib.parse import urlsplit

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition

from tidemark import constants as C
from tidemark.schemas import FETCHES

_COLUMNS = [c.split()[0] for c in FETCHES.split(", ")]


class _WebOnly(urllib.request.HTTPRedirectHandler):
    """Follows redirects to web addresses only."""

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        if not newurl.lower().startswith(("http://", "https://")):
            raise ValueError(f"redirected to no web address: {newurl}")
        return super().redirect_request(req, fp, code, msg, headers, newurl)


_OPENER = urllib.request.build_opener(_WebOnly)


def _decoded(body: bytes, charset: str | None) -> str:
    """Text by its charset; by UTF-8 where that is none that Python knows."""
    try:
        return body.decode(charset or "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def http_get(url: str, etag: str | None = None, last_modified: str | None = None, timeout: float = C.FETCH_TIMEOUT_SECONDS, most: int | None = C.MAX_PAGE_BYTES) -> dict:
    """One conditional GET of an http or https URL: status, content_type, validators and body, or an error, whatever fails. The chunk that passes ``most`` bytes is the last one kept; None keeps all."""
    if not url.lower().startswith(("http://", "https://")):
        return {"status": None, "error": f"not a web address: {url}"}
    asked = {k: v for k, v in (("If-None-Match", etag), ("If-Modified-Since", last_modified)) if v}
    try:
        with _OPENER.open(urllib.request.Request(url, headers=asked), timeout=timeout) as r:
            chunks, size = [], 0
            while (most is None or size <= most) and (chunk := r.read(1 << 16)):
                chunks.append(chunk)
                size += len(chunk)
            h = r.headers
            body = _decoded(b"".join(chunks), h.get_content_charset())
            return {"status": r.status, "content_type": h.get("Content-Type"), "etag": h.get("ETag"), "last_modified": h.get("Last-Modified"), "body": body, "error": None}
    except urllib.error.HTTPError as e:
        after = (e.headers or {}).get("Retry-After", "")
        return {"status": e.code, "error": None if e.code == 304 else f"HTTP {e.code}", "retry_after": int(after) if after.isdigit() else None}
    except (OSError, ValueError, http.client.HTTPException) as e:
        return {"status": None, "error": str(e) or type(e).__name__}


def get_with_retries(url: str, etag: str | None = None, last_modified: str | None = None, *, attempts: int = 3, wait: float = 1.0, longest: float = 30.0, sleep: Callable[[float], None] = time.sleep, get: Callable[..., dict] = http_get, **options) -> dict:
    """``http_get``, again where that may help: no answer, 429 or 5xx. Waits double from ``wait``, or are as long as the server asks, at most ``longest``."""
    for turn in range(attempts):
        got = get(url, etag, last_modified, **options)
        status = got.get("status")
        again = got.get("error") and (status is None and not got["error"].startswith(("not a web", "redirected to no web")) or status == 429 or (status or 0) >= 500)
        if not again or turn == attempts - 1:
            return got
        sleep(min(longest, got.get("retry_after") or wait * 2**turn))
    return {"status": None, "error": "not tried"}


class _Part(InputPartition):
    def __init__(self, targets: list[dict]):
        self.targets = targets


def by_host(targets: list[dict]) -> list[list[dict]]:
    """Targets of a host together, in order, so that a site is asked one page at a time."""
    hosts: dict[str, list[dict]] = {}
    for t in targets:
        hosts.setdefault(urlsplit(t["url"]).netloc.lower(), []).append(t)
    return list(hosts.values())


class _Options:
    """What both readers know: targets by the options, how often to try, and the bytes to keep."""

    def __init__(self, options: dict, schema):
        given = {k.lower(): v for k, v in options.items()}
        self.columns = schema.fieldNames()
        self.targets = json.loads(given.get("targets", "[]"))
        self.parts = int(given.get("parallelism", C.FEED_CONCURRENCY))
        self.most = int(given["maxbytes"]) if "maxbytes" in given else C.MAX_PAGE_BYTES
        self.attempts, self.wait = int(given.get("attempts", 1)), float(given.get("wait", 1.0))
        self.interval = max(1.0, float(given.get("intervalseconds", 60 * C.MIN_INTERVAL_MINUTES)))
        self.validators = given.get("validators")

    def rows(self, targets: list[dict]) -> Iterator[tuple]:
        for t in targets:
            got = get_with_retries(t["url"], t.get("etag"), t.get("last_modified"), attempts=self.attempts, wait=self.wait, most=self.most)
            row = {"source_id": t["source_id"], "url": t["url"], "fetched_at": datetime.now(UTC), **got}
            yield tuple(row.get(c) for c in self.columns)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.asked = _Options(options, schema)

    def partitions(self):
        targets = self.asked.targets
        n = max(1, min(self.asked.parts, len(targets)))
        return [_Part(targets[i::n]) for i in range(n)]

    def read(self, partition):
        yield from self.asked.rows(partition.targets)


class _FilteredReader(_Reader):
    def pushFilters(self, filters):  # noqa: N802
        """Fetch only what is asked for: equality and lists on the columns that are known before the fetch."""
        for f in filters:
            column, values = getattr(f, "attribute", ()), [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if values is not None and column in (("source_id",), ("url",)):
                self.asked.targets = [t for t in self.asked.targets if t[column[0]] in values]
            else:
                yield f


class _StreamReader(DataSourceStreamReader):
    """A round of fetches every ``intervalSeconds``; its number by the clock is the offset, so that a restart goes on where it was. A round that was missed is not made up for."""

    def __init__(self, options: dict, schema):
        self.asked = _Options(options, schema)

    def _round(self) -> int:
        return int(time.time() // self.asked.interval)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"round": self._round() - 1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"round": self._round()}

    def partitions(self, start: dict, end: dict):
        known = read_validators(self.asked.validators) if self.asked.validators else {}
        targets = [{**t, **known.get(t["source_id"], {})} for t in self.asked.targets]
        return [_Part(some) for some in by_host(targets)] if end["round"] > start["round"] else []

    def read(self, partition):
        yield from self.asked.rows(partition.targets)


def _file(uri: str):
    return fs.FileSystem.from_uri(uri if ":" in uri.split("/", 1)[0] else f"file://{uri}")


def read_validators(uri: str) -> dict[str, dict]:
    """{source_id: {etag, last_modified}} of a file that ``write_validators`` wrote; none where there is none."""
    system, path = _file(uri)
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return {}
    with system.open_input_stream(path) as f:
        return json.loads(f.read() or b"{}")


def write_validators(uri: str, sources: DataFrame) -> None:
    """Keep the validators of sources for the next round of a stream; after its articles are stored (X7). As many rows as the stream has targets."""
    rows = sources.where("etag is not null or last_modified is not null").select("id", "etag", "last_modified").collect()
    system, path = _file(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path) as f:
        f.write(json.dumps({r["id"]: {"etag": r["etag"], "last_modified": r["last_modified"]} for r in rows}).encode())


class HttpSource(DataSource):
    """``spark.read.format("http_fetch")`` with a JSON list of {source_id, url, etag, last_modified} as ``targets``.

    With the option ``pushFilters`` filters on source_id and url by equality or a list reach the targets; Spark wants
    ``spark.sql.python.filterPushdown.enabled`` for it. ``attempts`` and ``wait`` try
    again as in ``get_with_retries``. ``spark.readStream`` makes a round of fetches every ``intervalSeconds``, a task a host, with the validators
    of the file ``validators``; its schema may have ``fetched_at timestamp`` too.
    """

    @classmethod
    def name(cls) -> str:
        return "http_fetch"

    def schema(self) -> str:
        return FETCHES

    def reader(self, schema):
        pushed = {k.lower(): v for k, v in self.options.items()}.get("pushfilters", "false").lower() == "true"
        return (_FilteredReader if pushed else _Reader)(self.options, schema)

    def streamReader(self, schema):  # noqa: N802
        return _StreamReader(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HttpSource)


def fetch(targets: DataFrame, *, parallelism: int | None = None, get: Callable[..., dict] = http_get, most: int | None = C.MAX_PAGE_BYTES) -> DataFrame:
    """Fetch targets(source_id, url, etag, last_modified); a failure is a row with its error and stops no other.

    There is a fetch at a time in each partition; ``parallelism`` deals targets to so many. ``get`` replaces the HTTP call, in tests and behind proxies.
    """
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch.astype(object).where(batch.notna(), None).to_dict("records"):
                try:
                    got = get(t["url"], t["etag"], t["last_modified"], most=most)
                except Exception as e:  # noqa: BLE001  a fetch must not fail its peers
                    got = {"status": None, "error": str(e) or type(e).__name__}
                rows.append({"source_id": t["source_id"], "url": t["url"], **got})
            out = pd.DataFrame(rows, columns=_COLUMNS).astype(object)
            yield out.where(out.notna(), None)

    asked = targets.select("source_id", "url", "etag", "last_modified")
    return (asked if parallelism is None else asked.repartition(parallelism)).mapInPandas(run, FETCHES)


def fetch_pages(articles: DataFrame, **options) -> DataFrame:
    """(id, html) of articles(id, url): the page where it is HTML, at most MAX_PAGE_BYTES of it, else null."""
    none = F.lit(None).cast("string")
    targets = articles.select(F.col("id").alias("source_id"), "url", none.alias("etag"), none.alias("last_modified"))
    return html_only(outcome(fetch(targets, **options)).where("kind = 'ok'")).select(F.col("source_id").alias("id"), F.col("body").alias("html"))


def outcome(fetches: DataFrame) -> DataFrame:
    """Fetches with ``kind``: ok, not_modified or failed."""
    kind = F.when(F.col("status") == 304, "not_modified").when(F.col("error").isNull() & F.col("status").between(200, 299), "ok").otherwise("failed")
    return fetches.withColumn("kind", kind)


def html_only(fetches: DataFrame) -> DataFrame:
    """Page fetches whose body is HTML; other content has a null body."""
    return fetches.withColumn("body", F.when(F.contains(F.lower("content_type"), F.lit("text/html")), F.col("body")))


def with_fallback(feeds: DataFrame, listings: DataFrame) -> DataFrame:
    """(source_id, mode, error): which fetch a source uses. A failed feed falls back to its listing; if that fails too both errors are told (X11)."""
    f = outcome(feeds).select("source_id", F.col("kind").alias("feed"), F.col("error").alias("feed_error"))
    li = outcome(listings).select("source_id", F.col("kind").alias("listing"), F.col("error").alias("listing_error"))
    both = f.join(li, "source_id", "left")
    mode = F.when(F.col("feed") != "failed", F.when(F.col("feed") == "ok", "feed").otherwise("not_modified")).when(F.col("listing") == "ok", "listing")
    error = F.when(mode.isNull(), F.concat_ws("; ", "feed_error", "listing_error"))
    return both.select("source_id", mode.alias("mode"), error.alias("error"))
