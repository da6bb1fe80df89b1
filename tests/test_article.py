"""Golden texts of pages of our own, one for each shape of page that the article is looked for in."""

from __future__ import annotations

from datetime import UTC, datetime

import pytest

from tidemark.sources.article import find_article, page_title
from tidemark.sources.dom import parse_html
from tidemark.sources.page import extract_pages, page_dates, page_texts

STORY = [
    "The queue had been slow for a month, and nobody could say why; every graph that we had looked fine.",
    "So we wrote down what one message goes through, step by step, and put a clock on each of the steps.",
    "Most of the time, as it turned out, went into reading the same small file, again and again, for every message.",
    "A cache of one line would have done, but we took the file out of the path, which was simpler, and safer.",
    "Since then the queue is empty most of the day, and we look at it less, which is the best a queue can do.",
]
TEXT = "\n".join(STORY)


def paragraphs(lines=STORY):
    return "".join(f"\n  <p>{line}</p>" for line in lines)


def links(n=6):
    return "<ul>" + "".join(f'<li><a href="/p/{i}">A post of ours on topic number {i}</a></li>' for i in range(n)) + "</ul>"


PAGES = {
    "blog with sidebar, banner and ads": (
        f'<title>The slow queue</title><nav>{links()}</nav><header><div class="site-banner">Our letter comes weekly, take it!</div></header><div class="layout"><aside class="sidebar"><h3>Related</h3>{links(3)}'
        f'<div class="ad">Here is an advert, placed by us.</div></aside><main><article><h1>The slow queue</h1><p class="byline">By the team, in August</p>{paragraphs()}</article></main></div><footer><p>No rights.</p>{links(2)}</footer>',
        "The slow queue",
        f"By the team, in August\n{TEXT}",
    ),
    "columns without telling tags": (
        f'<title>The slow queue - Site</title><body><div id="top">{links()}</div><table><tr><td width="20%">{links()}</td><td><h2>The slow queue</h2>{paragraphs()}</td><td>{links(3)}</td></tr></table></body>',
        "The slow queue",
        TEXT,
    ),
    "text in divs with line breaks": (
        f'<title>T</title><div class="wrap"><div class="menu">{links()}</div><div class="txt">{"<br><br>".join(STORY)}</div></div>',
        "T",
        TEXT,
    ),
    "a story in three sections": (
        f'<title>T</title><div class="page"><div class="s">{paragraphs(STORY[:2])}</div><div class="s">{paragraphs(STORY[2:4])}</div><div class="s">{paragraphs(STORY[4:])}</div></div><div class="related">{paragraphs(STORY[:1])}</div>',
        "T",
        TEXT,
    ),
    "a story under a name that speaks against it": (
        f'<title>T</title><div class="sidebar-widget">{paragraphs()}</div><div>{links()}</div>',
        "T",
        TEXT,
    ),
    "lists, quotes, code and a heading": (
        f'<title>T</title><article><h2>Steps</h2>{paragraphs(STORY[:3])}<ul><li>read it</li><li>count <b>it</b></li></ul><blockquote>So they said, and left.</blockquote><pre>a = 1\n  b = 2\n</pre>{paragraphs(STORY[3:])}</article>',
        "T",
        "\n".join(["Steps", *STORY[:3], "read it", "count it", "So they said, and left.", "a = 1", "  b = 2", *STORY[3:]]),
    ),
    "hidden text and share buttons": (
        f'<title>T</title><article>{paragraphs(STORY[:4])}<div style="display: none"><p>{STORY[0]}</p></div><p hidden>{STORY[1]}</p><div class="share-bar"><p>Share it, please, with all of your friends.</p></div><div>{links()}</div>{paragraphs(STORY[4:])}</article>',
        "T",
        TEXT,
    ),
    "a short note": ("<title>T</title><div><p>Only this, no more.</p></div>", "T", "Only this, no more."),
    "comments longer than the story": (
        f'<title>T</title><div class="post">{paragraphs()}</div><div id="comments">{"".join(f"<div class=comment>{paragraphs()}</div>" for _ in range(4))}</div>',
        "T",
        TEXT,
    ),
    "nothing": ("", "", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_golden_text(name):
    html, title, text = PAGES[name]
    got = find_article(parse_html(f"<html><head></head>{html}</html>"))
    assert (got.title, got.text) == (title, text)
    assert got.excerpt == text.split("\n", 1)[0]


@pytest.mark.parametrize(
    ("html", "title"),
    [
        ('<meta property="og:title" content=" Shared  name "><title>Other</title><h1>Third</h1>', "Shared name"),
        ("<title>Name of it | Site</title><h1>Name of it</h1>", "Name of it"),
        ("<title>Name of it - Site</title><h1>Else</h1>", "Name of it - Site"),
        ("<h1>Only a heading</h1>", "Only a heading"),
        ("<p>none</p>", ""),
    ],
)
def test_title(html, title):
    assert page_title(parse_html(html)) == title


def test_excerpt_is_the_description():
    assert find_article(parse_html(f'<meta name="description" content="In short.">{paragraphs()}')).excerpt == "In short."


def test_deep_and_broken_pages():
    assert find_article(parse_html("<div>" * 3000 + "<p>Deep, but there.</p>")).text == "Deep, but there."
    assert find_article(parse_html("<p>an <b>open <i>page, that ends")).text == "an open page, that ends"


@pytest.mark.parametrize("day", ["1500-01-01", "0001-01-01", "9999-12-31", "0000-01-01", "2026-09-01"])
def test_far_dates(spark, day):
    """A page of any year is a row, also where pandas has no such date; what is no date is null."""
    rows = [(1, f'<meta property="article:published_time" content="{day}"><p>x</p>'), (2, None), (3, "<p>y</p>")]
    df = spark.createDataFrame(rows, "id int, html string")
    got = dict(page_dates(df, datetime(2026, 9, 10, tzinfo=UTC)).selectExpr("id", "date_format(published_at, 'yyyy-MM-dd')").collect())
    assert got == {1: None if day.startswith("0000") else day, 2: None, 3: None}


def test_only_what_is_selected_is_computed(spark):
    """Text and date are functions of their own, so that neither costs the other's."""
    df = spark.createDataFrame([(1, "<p>x</p>")], "id int, html string")
    both = extract_pages(df, datetime(2026, 9, 10, tzinfo=UTC))
    plan = lambda q: q._jdf.queryExecution().optimizedPlan().toString().count("run(")
    assert plan(both) == 2 and plan(both.select("id", "published_at")) == 1 and plan(both.select("text")) == 1
    assert page_texts(df).columns == ["id", "html", "title", "text", "excerpt"]
