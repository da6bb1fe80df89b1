"""RSS 2.0, Atom and RSS 1.0 documents as feed items."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions.dates import parse_date
from tidemark.functions.text import utf16_length

# Namespaces whose usual prefix names a field, and what items are called by format.
PREFIXES = {
    "http://purl.org/rss/1.0/modules/content/": "content:",
    "http://purl.org/dc/elements/1.1/": "dc:",
    "http://www.w3.org/1999/02/22-rdf-syntax-ns#": "rdf:",
    "http://www.w3.org/2005/Atom": "",
    "http://purl.org/rss/1.0/": "",
}
NOT_XML = "not-xml"


class NotXml(ValueError):
    """The document is no feed."""


def _name(tag: str) -> str:
    space, _, local = tag.rpartition("}")
    return PREFIXES.get(space.lstrip("{"), "other:" if space else "") + local


def _lenient(xml: str) -> str:
    """Entities of HTML as characters, bare ampersands and undeclared prefixes made legal."""

    def entity(m: re.Match) -> str:
        if m[1] in ("amp", "lt", "gt", "quot", "apos"):
            return m[0]
        return html5.get(m[1] + ";", f"&amp;{m[1]};")

    parts = re.split(r"(<!\[CDATA\[.*?\]\]>)", xml, flags=re.S)
    for i in range(0, len(parts), 2):
        parts[i] = re.sub(r"&(?!#\d+;|#x[0-9a-fA-F]+;|\w+;)", "&amp;", re.sub(r"&([A-Za-z]\w*);", entity, parts[i]))
    fixed = "".join(parts)
    used = set(re.findall(r"<(\w+):", fixed)) | set(re.findall(r"\s(\w+):[\w-]+\s*=", fixed))
    known = {prefix.rstrip(":"): uri for uri, prefix in PREFIXES.items() if prefix}
    missing = [p for p in sorted(used) if p not in ("xml", "xmlns") and f"xmlns:{p}" not in fixed]
    declared = "".join(f' xmlns:{p}="{known.get(p, "urn:x-" + p)}"' for p in missing)
    return re.sub(r"<(?![?!])([^\s/>]+)", lambda m: f"<{m[1]}{declared}", fixed, count=1)


def _texts(e: ET.Element, name: str) -> list[str | None]:
    """The text of each child of that name; null for one that only holds elements."""
    return [None if len(c) and not (c.text or "").strip() else (c.text or "").strip() for c in e if _name(c.tag) == name]


def _text(e: ET.Element, *names: str) -> str | None:
    """The first text among the names; an empty one counts as present."""
    return next((t for n in names for t in _texts(e, n)[:1] if t is not None), None)


def _atom_link(e: ET.Element) -> str | None:
    links = [c.attrib for c in e if _name(c.tag) == "link" and c.attrib]
    chosen = next((a for a in links if a.get("rel") == "alternate" and a.get("type") == "text/html"), links[0] if links else {})
    return chosen.get("href")


def _item(e: ET.Element, form: str) -> dict:
    if form == "atom":
        terms = [c.attrib.get("term") for c in e if _name(c.tag) == "category"]
        fields = _atom_link(e), _text(e, "id"), _text(e, "published", "updated"), terms, _text(e, "content", "summary")
    else:
        link = _texts(e, "link")[:1]
        dated = _text(e, "pubDate", "dc:date") if form == "rss2" else _text(e, "dc:date")
        guid = _text(e, "guid") if form == "rss2" else None
        fields = link[0] if link else None, guid, dated, _texts(e, "category"), _text(e, "content:encoded", "description")
    link, guid, dated, categories, content = fields
    return {"title": _text(e, "title") or "", "link": link, "guid": guid, "dated": dated, "categories": [c for c in categories if c], "content_html": content}


def parse_feed(xml: str) -> tuple[str, str | None, list[dict]]:
    """(format, title, items with a link) of a feed document; NotXml if it is none."""
    xml = xml.removeprefix("\ufeff").lstrip()
    if re.match(r"(?i)<!doctype\s+html", xml):
        raise NotXml(NOT_XML)
    try:
        root = ET.fromstring(re.sub(r"^<\?xml[^>]*\?>", "", _lenient(re.sub(r"^<\?xml[^>]*\?>\s*", "", xml))))
    except ET.ParseError:
        raise NotXml(NOT_XML) from None
    name = _name(root.tag)
    channel = next((c for c in root if _name(c.tag) == "channel"), None)
    if name == "rss" and channel is not None and (len(channel) or (channel.text or "").strip()):
        form, title, items = "rss2", _text(channel, "title"), [c for c in channel if _name(c.tag) == "item"]
    elif name == "feed" and (len(root) or (root.text or "").strip()):
        form, title, items = "atom", _text(root, "title"), [c for c in root if _name(c.tag) == "entry"]
    elif name == "rdf:RDF" and len(root):
        form, title = "rdf", _text(channel, "title") if channel is not None else None
        items = [c for c in root if _name(c.tag) == "item"]
    else:
        raise NotXml(NOT_XML)
    found = [_item(e, form) for e in items]
    return form, title, [i for i in found if i["link"]]


_PARSED = (
    "source_id string, pos int, format string, feed_title string, title string, link string, guid string, dated string, "
    "categories array<string>, content_html string, error string"
)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _PARSED.split(", ")]
    for batch in batches:
        rows = []
        for source, body in zip(batch["source_id"], batch["body"], strict=True):
            try:
                form, title, items = parse_feed(body or "")
            except NotXml as e:
                rows.append({"source_id": source, "error": str(e)})
                continue
            rows += [{"source_id": source, "pos": i, "format": form, "feed_title": title} | item for i, item in enumerate(items)]
            if not items:
                rows.append({"source_id": source, "format": form, "feed_title": title})
        out = pd.DataFrame(rows, columns=columns).astype(object)
        yield out.where(out.notna(), None)


def read_feeds(fetches: DataFrame) -> DataFrame:
    """A row per item of each fetched feed, in document order by ``pos``; a feed that does not parse is a row with its error, an empty
    one a row without ``pos``. Dates that do not parse are null: the chosen field has no second try.
    """
    items = fetches.select("source_id", "body").mapInPandas(_parse, _PARSED)
    full = F.coalesce(utf16_length(F.col("content_html")) > C.FULL_CONTENT_CHARS, F.lit(False))
    return items.withColumn("published_at", parse_date(F.col("dated"))).withColumn("has_full_content", full).drop("dated")


def read_feeds_xml(path: str, spark, row_tag: str = "item") -> DataFrame:
    """Items of well-formed RSS files by the built-in XML source, for large dumps: the same columns, without ``pos``."""
    schema = "title string, link string, guid string, pubDate string, `dc:date` string, category array<string>, description string, `content:encoded` string"
    raw = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    content = F.coalesce("`content:encoded`", "description")
    return raw.where("link <> ''").select(
        F.coalesce("title", F.lit("")).alias("title"),
        "link",
        "guid",
        parse_date(F.coalesce("pubDate", "`dc:date`")).alias("published_at"),
        F.filter(F.coalesce("category", F.array().cast("array<string>")), lambda c: c != "").alias("categories"),
        content.alias("content_html"),
        F.coalesce(utf16_length(content) > C.FULL_CONTENT_CHARS, F.lit(False)).alias("has_full_content"),
    )


def in_categories(categories: Column, wanted: Column) -> Column:
    """Whether an item passes a category filter: no filter, no categories, or one in common whatever the case."""
    lower = lambda c: F.transform(c, F.lower)
    return wanted.isNull() | (F.size(categories) == 0) | F.coalesce(F.arrays_overlap(lower(categories), lower(wanted)), F.lit(False))
