"""Scalar functions against cases with known answers."""

from __future__ import annotations

from datetime import UTC, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import text as X
from tidemark.functions import url as U
from tidemark.functions.html import html_to_text


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


URLS = {
    "http://Example.COM/a": "https://example.com/a",
    " https://example.com/a/ ": "https://example.com/a",
    "https://example.com/": "https://example.com",
    "https://example.com": "https://example.com",
    "https://example.com:443/a": "https://example.com/a",
    "http://example.com:8080/a": "https://example.com:8080/a",
    "https://example.com/a#top": "https://example.com/a",
    "https://me:pw@example.com/a": "https://example.com/a",
    "https://example.com/a?utm_source=x&utm_anything=y": "https://example.com/a",
    "https://example.com/a?source=x&ref=y&mkt_tok=1&fbclid=2&gi=3&id=7": "https://example.com/a?id=7",
    "https://example.com/a?Ref=y": "https://example.com/a?Ref=y",
    "https://example.com/a?x": "https://example.com/a?x=",
    "https://example.com/a?q=a%20b+c&r=%zz": "https://example.com/a?q=a+b+c&r=%25zz",
    "https://example.com/a?&&b=1": "https://example.com/a?b=1",
    "https://example.com/x/../y/./z": "https://example.com/y/z",
    "https://example.com/a//": "https://example.com/a/",
    "not a url": "not a url",
    "": "",
    "https://": "https://",
    "https://exa mple.com/": "https://exa mple.com/",
}


def test_normalize_url(spark):
    assert dict(zip(URLS, column(spark, list(URLS), U.normalize_url), strict=True)) == URLS


def test_normalize_url_is_idempotent(spark):
    once = [u for u in URLS.values() if not u.endswith("//") and not u.endswith("/")]
    assert column(spark, once, U.normalize_url) == once
    assert column(spark, [None], U.normalize_url) == [None]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text("abAB/?&=#%2. :é+", max_size=25), min_size=20, max_size=20))
def test_normalize_url_idempotent_on_random_paths(spark, tails):
    urls = [f"http://h.example/{t}" for t in tails]
    once = column(spark, urls, U.normalize_url)
    stable = [u for u in once if not u.endswith("/") and "/?" not in u]
    assert column(spark, stable, U.normalize_url) == stable if stable else True


def test_url_predicates(spark):
    df = spark.createDataFrame(
        [
            ("https://a.example/blog", "https://a.example/us/en/blog", False, True),
            ("https://a.example/us/en", "https://a.example/us/en/blog", True, False),
            ("https://a.example", "https://a.example/us/en/blog", True, False),
            ("https://a.example/de/blog", "https://a.example/us/en/blog", False, True),
            ("https://a.example/us/en/blog/post-1", "https://a.example/us/en/blog", False, False),
            ("https://b.example/us", "https://a.example/us/en/blog", False, False),
        ],
        "u string, l string, above boolean, variant boolean",
    )
    got = df.select(U.is_listing_or_above(F.col("u"), F.col("l")) == F.col("above"), U.is_locale_variant(F.col("u"), F.col("l")) == F.col("variant")).collect()
    assert all(all(r) for r in got)
    assert column(spark, ["https://a.example/x?page=2", "https://a.example/x?a=1&page=", "https://a.example/page?x=page"], U.has_page_query) == [True, True, False]
    assert column(spark, [" #a", "JavaScript:x", "mailto:a@b", "", "/a"], U.is_ignorable_href) == [True, True, True, True, False]


HTML = {
    "<p>a</p><p>b</p>": "a\nb",
    "a<br>b<BR/>c<br />d": "a\nb\nc\nd",
    "<script>x<y</script>a<style>b</style><!-- <p>c</p> -->d": "ad",
    "&amp;lt; &lt; &#60; &#x3C; &nbsp;. &AMP; &unknown;": "&lt; < < < . & &unknown;",
    "&#38;lt;": "&lt;",
    "&#x1F600;&#xD800;&#99999999;": "😀&#xD800;&#99999999;",
    "a \t b\r\n\r\n\r\n\r\nc": "a b\n\nc",
    "<ul><li>x</li><li>y</li></ul>": "x\ny",
    "": "",
    "no tags & none": "no tags & none",
}


def test_html_to_text(spark):
    assert dict(zip(HTML, column(spark, list(HTML), html_to_text), strict=True)) == HTML
    assert column(spark, [None], html_to_text) == [None]


DATES = {
    "Mon, 01 Sep 2026 10:00:00 +0900": datetime(2026, 9, 1, 1),
    "01 Sep 2026 10:00:00 GMT": datetime(2026, 9, 1, 10),
    "Tue, 1 Sep 2026 10:00:00 EST": datetime(2026, 9, 1, 15),
    "2026-09-01T10:00:00Z": datetime(2026, 9, 1, 10),
    "2026-09-01T10:00:00.123+09:00": datetime(2026, 9, 1, 1, 0, 0, 123000),
    "2026-09-01T10:00:00-0700": datetime(2026, 9, 1, 17),
    "2026-09-01": datetime(2026, 9, 1),
    "2026-09-01 10:30": datetime(2026, 9, 1, 10, 30),
    "September 2, 2026": datetime(2026, 9, 2),
    "Sep 2, 2026 03:04:05": datetime(2026, 9, 2, 3, 4, 5),
    "2026/09/02": datetime(2026, 9, 2),
    "PT8M": None,
    "yesterday": None,
    "2026-13-01": None,
    "31 Foo 2026": None,
    "": None,
}


def test_parse_date_both_ways(spark):
    got = column(spark, list(DATES), D.parse_date)
    assert dict(zip(DATES, got, strict=True)) == DATES
    for s, want in DATES.items():
        assert D.parse_moment(s) == (want.replace(tzinfo=UTC) if want else None)
    assert column(spark, [None], D.parse_date) == [None]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Posted Sep 2, 2026 by us", [(2026, 9, 2)]),
        ("September 12, 2025 and Sept. 3, 2024", [(2025, 9, 12), (2024, 9, 3)]),
        ("2 Sep 2026", [(2026, 9, 2)]),
        ("2026-09-02 and 2026/09/03", [(2026, 9, 2), (2026, 9, 3)]),
        ("version 12026-09-02, 2026-09-02-x, 2026-02-30, 1989-01-01, 2028-01-01", []),
        ("on 3 May 2020 then May 1, 2019", [(2020, 5, 3), (2019, 5, 1)]),
        ("xMay 1, 2019 or May 1, 20190", []),
        ("", []),
    ],
)
def test_dates_in_text(text, want, now):
    assert [(d.year, d.month, d.day) for d in D.dates_in(text, now.replace(tzinfo=UTC))] == want


def test_find_date_texts_column(spark, now):
    got = column(spark, ["2026-09-02T10:00:00+09:00 x", None, "none"], lambda c: D.find_date_texts(c, now))
    assert got == [[datetime(2026, 9, 2, 1)], None, []]


def test_text_functions(spark):
    assert column(spark, ["日本😀", "", None], X.utf16_length) == [4, 0, None]
    assert column(spark, ["ab😀c"], lambda c: X.truncate(c, 3, "…")) == ["ab…"]
    assert column(spark, ["ab😀c"], lambda c: X.truncate(c, 4, "…")) == ["ab😀…"]
    assert column(spark, ["abc", "ab"], lambda c: X.truncate(c, 2, "…")) == ["ab…", "ab"]
    assert column(spark, ["abc"], lambda c: X.truncate(c, -1)) == [""]
    assert column(spark, [" a 　 b \n"], X.collapse_space) == ["a b"]
    assert column(spark, [3.7, float("nan"), -2.0, None], X.clamp, "double") == [3, 0, 0, 0]


SUMMARY = '{"headline":"h","brief":"b","digest":["x","y"],"detail":"d","tags":[]}'


@pytest.mark.parametrize(
    ("text", "ok"),
    [
        (SUMMARY, True),
        (f"Sure:\n```json\n{SUMMARY}\n```", True),
        (SUMMARY.replace('"h"', "1"), False),
        (SUMMARY.replace('["x","y"]', '["x",1]'), False),
        (SUMMARY.replace('"tags":[]', '"tags":"t"'), False),
        (SUMMARY.replace('"brief":"b",', ""), False),
        (SUMMARY.replace('"h"', "null"), False),
        ("no json", False),
        ("{", False),
        ("[1]", False),
        (f"[{SUMMARY}]", False),  # JSON, but no object
        (SUMMARY.replace('["x","y"]', '["x",null]'), False),
        (SUMMARY.replace('["x","y"]', '{"x":1}'), False),
        (None, False),
    ],
)
def test_parse_summary(spark, text, ok):
    (got,) = column(spark, [text], X.parse_summary)
    assert (got is not None) == ok
    if ok:
        assert got["digest"] == ["x", "y"] and got["tags"] == []


def test_prompts(spark):
    df = spark.createDataFrame([("T", "S", "u", datetime(2026, 9, 1, 23), "x" * 10)], "t string, s string, u string, p timestamp, b string")
    c = [F.col(x) for x in "tsup"]
    row = df.select(X.build_summary_user(*c, F.col("b"), F.lit("rss"), 4).alias("user"), X.build_chat_system(*c, F.col("b")).alias("chat")).first()
    assert row["user"].endswith("<article>\nxxxx（以下省略）\n</article>") and "2026-09-01" in row["user"] and "RSS概要" in row["user"]
    assert row["chat"].startswith(X.CHAT_PREFIX) and row["chat"].endswith("\n\n<article>\nxxxxxxxxxx\n</article>")
    s = spark.sql("select named_struct('headline','h','brief','','digest',array('a','b'),'detail','d','tags',array('t')) s")
    assert s.select(X.summary_as_text(F.col("s")).alias("x")).first()["x"] == "h\n\n- a\n- b\n\nd"
