"""Listing pages: article links from structured data or anchors."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from urllib.parse import urldefrag, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions import url as U
from tidemark.functions.dates import dates_in, parse_moment
from tidemark.sources.dom import Element, parse_html
from tidemark.sources.structured import structured_items

# Headings, and what holds navigation.
HEADINGS = ("h1", "h2", "h3", "h4")
NAVIGATION, NAVIGATION_ROLES = ("nav", "header", "footer"), ("navigation", "menu")

_RAW = "url string, title string, published_at timestamp, plausible boolean"


def _one_line(s: str | None) -> str:
    return " ".join((s or "").split())


def absolute(href: str, base: str) -> str | None:
    """An href as an absolute URL without fragment; its slash and query stay. None if it is none."""
    try:
        joined = urldefrag(urljoin(base, href.strip()))[0]
        parts = urlsplit(joined)
    except ValueError:
        return None
    if not parts.scheme or parts.scheme in ("http", "https") and not parts.netloc:
        return None
    return joined + "/" if parts.netloc and not parts.path and not parts.query else joined


class _Dates:
    """Dates near anchors; each element's text is read once a page."""

    def __init__(self, now: datetime):
        self.now, self.seen = now, {}

    def _around(self, e: Element) -> list[datetime] | None:
        """The dates in an element's text; None if there is too much of it."""
        if e not in self.seen:
            text = e.clean_text()
            self.seen[e] = None if len(text) > C.LISTING_TEXT_DATE_CHARS else dates_in(_one_line(text), self.now)
        return self.seen[e]

    def of(self, anchor: Element) -> datetime | None:
        timed = lambda e: e.tag == "time" and "datetime" in e.attrs
        near = [anchor, *(a for a in anchor.ancestors(C.LISTING_TIME_DEPTH) if a.tag in ("article", "li", "div"))]
        time = next((t for e in near if (t := e.first(timed)) is not None), None)
        if time is not None and (at := parse_moment(time.attrs["datetime"])) is not None:
            return at
        for a in anchor.ancestors(C.LISTING_TEXT_DATE_DEPTH):
            found = self._around(a)
            if found is None:
                break
            if len(found) == 1:
                return found[0]
        return None


def _anchor(e: Element, dates: _Dates) -> tuple[str, bool, datetime | None]:
    """(title, whether it looks like an article's link, date)."""
    rel = e.attrs.get("rel", "").lower().split()
    inside = any(a.tag in NAVIGATION or a.attrs.get("role") in NAVIGATION_ROLES for a in (e, *e.ancestors()))
    heading, text = e.first(lambda x: x.tag in HEADINGS), _one_line(e.text())
    title = _one_line(heading.text() if heading is not None else "") or text or _one_line(e.attrs.get("aria-label")) or _one_line(e.attrs.get("title"))
    fits = heading is not None or len(text) >= C.LISTING_MIN_ANCHOR_CHARS and " " in text
    good = bool(fits and title and not inside and "hreflang" not in e.attrs and not {"nofollow", "tag"} & set(rel))
    return title, good, dates.of(e) if good else None


def _links(html: str, base: str, now: datetime) -> list[dict]:
    """All anchors of a page in document order."""
    root = parse_html(html)
    rows, dates = [], _Dates(now)
    for e in root.walk():
        if e.tag == "a" and "href" in e.attrs and not e.attrs["href"].strip().lower().startswith(("#", "javascript:", "mailto:")) and e.attrs["href"].strip():
            title, good, at = _anchor(e, dates)
            rows.append({"url": absolute(e.attrs["href"], base), "title": title, "published_at": at, "plausible": good})
    return [r for r in rows if r["url"]]


def _absolute(href: pa.Array, base: pa.Array) -> pa.Array:
    return pa.array([None if h is None else absolute(h, b or "") for h, b in zip(href.to_pylist(), base.to_pylist(), strict=True)], pa.string())


def read_listings(pages: DataFrame, now: datetime) -> DataFrame:
    """Article links of listing pages(page, html, base_url, pattern, exclude_pattern): (page, pos, url, title, published_at).

    Python reads the tree of anchors only; structured data, URL rules, structured-first and first-of-a-key are column expressions. Links of structured data win if any
    passes the rules. Keys are canonical URLs, results keep the original. A pattern that is no regex fails; a null
    exclude_pattern excludes nothing.
    """
    kind = pa.list_(pa.struct([("url", pa.string()), ("title", pa.string()), ("published_at", pa.timestamp("us", "UTC")), ("plausible", pa.bool_())]))

    def run(html: pa.Array, base: pa.Array) -> pa.Array:
        return pa.array([[] if h is None else _links(h, b, now) for h, b in zip(html.to_pylist(), base.to_pylist(), strict=True)], kind)

    links, site = F.arrow_udf(run, f"array<struct<{_RAW}>>"), ["page", "base_url", "pattern", "exclude_pattern"]
    anchors = pages.select(*site, F.posexplode(links("html", "base_url")).alias("at", "l"))
    anchors = anchors.select(*site, F.lit(False).alias("structured"), F.struct(F.lit(0).alias("_node"), "at").alias("pos"), "l.*")
    told = structured_items(pages.select(*site, "html"))
    url = F.arrow_udf(_absolute, "string")("address", "base_url")
    told = told.select(*site, F.lit(True).alias("structured"), F.col("place").alias("pos"), url.alias("url"), "title", "published_at", F.coalesce(F.col("title") != "", F.lit(False)).alias("plausible"))
    found = anchors.unionByName(told).where("url is not null").withColumn("key", U.normalize_url(F.col("url")))
    listing = F.col("base_url")
    ruled = found.where(
        F.col("plausible")
        & F.expr("key rlike pattern")
        & ~U.excluded(F.col("key"), listing)
        & ~F.coalesce(F.expr("key rlike exclude_pattern"), F.lit(False))
        & (F.col("structured") | ~U.is_word_category(F.col("key"), F.col("title")))
    )
    first = ruled.groupBy("page", "structured", "key").agg(F.min_by(F.struct("pos", "url", "title", "published_at"), "pos").alias("i"))
    items = first.groupBy("page").agg(F.array_sort(F.collect_list(F.when(F.col("structured"), F.col("i")))).alias("s"), F.array_sort(F.collect_list(F.when(~F.col("structured"), F.col("i")))).alias("a"))
    chosen = F.when(F.size("s") > 0, F.col("s")).otherwise(F.col("a"))
    return items.select("page", F.posexplode(chosen).alias("pos", "i")).select("page", "pos", "i.url", "i.title", "i.published_at")


def as_feed_items(listing: DataFrame, source_id: str = "page") -> DataFrame:
    """Listing links in the shape of feed items: no categories, no content (R2)."""
    return listing.select(
        F.col(source_id).alias("source_id"),
        "pos",
        "title",
        F.col("url").alias("link"),
        F.lit(None).cast("string").alias("guid"),
        "published_at",
        F.array().cast("array<string>").alias("categories"),
        F.lit(None).cast("string").alias("content_html"),
        F.lit(False).alias("has_full_content"),
    )
