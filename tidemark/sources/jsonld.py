"""Embedded structured data: the JSON of ld+json scripts."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from tidemark.sources.dom import Element


def documents(root: Element) -> Iterator[Any]:
    """The parsed ld+json scripts in order; broken ones are left out."""
    for script in root.walk():
        if script.tag == "script" and script.attrs.get("type") == "application/ld+json":
            try:
                yield json.loads(script.text())
            except ValueError:
                continue


def nodes(value: Any, *, deep: bool) -> Iterator[dict]:
    """The objects of a document: lists and @graph lists opened. ``deep``: an object with a @graph counts itself too."""
    if isinstance(value, list):
        for part in value:
            yield from nodes(part, deep=deep)
    elif isinstance(value, dict):
        graph = value.get("@graph")
        if deep or not isinstance(graph, list):
            yield value
        if isinstance(graph, list):
            yield from nodes(graph, deep=deep)


def text_field(node: Any, name: str) -> str | None:
    value = node.get(name) if isinstance(node, dict) else None
    return value if isinstance(value, str) and value.strip() else None
