"""Articles of ld+json (S7a, F14) as VARIANT columns: scripts, lists, graphs and item lists are opened in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import parse_date
from tidemark.functions.text import SPACE, collapse_space

# Types of structured data that are articles, and what a page is read by; only the second form has a text of its own.
ARTICLE_TYPES = ("BlogPosting", "NewsArticle", "Article")
_TOKENS = r"(?is)<!--.*?-->|<template\b.*?</template\s*>|<script\b[^>]*\btype\s*=\s*[\"']?application/ld\+json\b[^>]*>(.*?)</script\s*>|<(?:script|style)\b.*?</(?:script|style)\s*>"
#: Lists and graphs in each other that are opened; deeper ones fail.
DEPTH = 8


def ld_scripts(html: Column) -> Column:
    """The texts of ld+json scripts in order; not those in comments, templates or other scripts."""
    return F.filter(F.regexp_extract_all(html, F.lit(_TOKENS), F.lit(1)), lambda s: s != "")


def _list(v: Column, path: str = "$") -> Column:
    """The elements at a path; null if there is no list."""
    return F.try_variant_get(v, path, "array<variant>")


def _text(v: Column, path: str = "$") -> Column:
    """The string at a path; null if it is blank or no string."""
    is_text = F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING"
    text = F.try_variant_get(v, path, "string")
    return F.when(is_text & text.rlike(SPACE.replace("[", "[^", 1)), text)


def _inner(v: Column) -> Column:
    return F.coalesce(_list(v), _list(v, '$["@graph"]'))


def with_nodes(pages: DataFrame, name: str) -> DataFrame:
    """``pages(html, ...)`` with the objects of their ld+json, lists and @graph lists opened, in order; broken scripts are left out."""
    whole = F.filter(F.transform(ld_scripts(F.col("html")), F.try_parse_json), lambda v: v.isNotNull())
    opened = pages.withColumn(name, reduce(lambda a, _: F.flatten(F.transform(a, lambda v: F.coalesce(_inner(v), F.array(v)))), range(DEPTH), whole))
    deeper = F.exists(name, lambda v: _inner(v).isNotNull())
    return opened.withColumn(name, F.when(deeper, F.raise_error(F.lit(f"ld+json with lists or graphs more than {DEPTH} deep"))).otherwise(F.col(name)))


def _address(v: Column) -> Column:
    return F.coalesce(_text(v, "$.url"), _text(v, "$.mainEntityOfPage"), _text(v, '$.mainEntityOfPage["@id"]'))


def _described(*nodes: Column) -> Column:
    """The first address, title and date that the nodes have."""
    title = F.coalesce(*(c for n in nodes for c in (_text(n, "$.headline"), _text(n, "$.name"))))
    date = F.coalesce(*(_text(n, "$.datePublished") for n in nodes))
    return F.struct(F.coalesce(*(_address(n) for n in nodes)).alias("address"), collapse_space(title).alias("title"), date.alias("date"))


def _kinds(v: Column) -> Column:
    of = F.coalesce(_list(v, '$["@type"]'), F.array(F.try_variant_get(v, '$["@type"]', "variant")))
    return F.transform(of, lambda k: _text(k))


def structured_items(pages: DataFrame) -> DataFrame:
    """``pages(html, ...)`` without html, a row for each article in ld+json, in order: with ``place``, ``address`` as it is written, ``title`` and ``published_at``.

    Articles are objects of an article type, and the elements of an ItemList or their ``item``. An address is the url, else mainEntityOfPage, else its @id; those
    without one are left out. A title is the headline, else the name. Null html and pages without ld+json have no rows. JSON that repeats a key in an
    object counts as broken.
    """
    others = [c for c in pages.columns if c != "html"]
    nodes = with_nodes(pages, "_nodes").select(*others, F.posexplode("_nodes").alias("_node", "_v"))
    kinds = nodes.withColumn("_kinds", _kinds(F.col("_v")))
    is_list = F.array_contains("_kinds", "ItemList")
    listed = F.transform(F.coalesce(_list(F.col("_v"), "$.itemListElement"), F.array().cast("array<variant>")), lambda x: _described(x, F.try_variant_get(x, "$.item", "variant")))
    alone = F.array(_described(F.col("_v")))
    found = F.when(is_list, listed).when(F.arrays_overlap("_kinds", F.array(*map(F.lit, ARTICLE_TYPES))), alone)
    items = kinds.select(*others, "_node", F.posexplode(found).alias("_at", "_i")).where("_i.address is not null")
    return items.select(*others, F.struct("_node", F.col("_at").alias("at")).alias("place"), "_i.address", "_i.title", parse_date(F.col("_i.date")).alias("published_at"))
