"""Feeds, listings, pages and fetching on documents written for these tests."""

from __future__ import annotations

import threading
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tidemark.sources import fetch as H
from tidemark.sources.dom import parse_html
from tidemark.sources.feed import NotXml, parse_feed, read_feeds, read_feeds_xml
from tidemark.sources.listing import as_feed_items, read_listings
from tidemark.sources.page import date_report, extract_pages, published_at

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/">
<channel><title>Feed</title><link>https://a.example</link>
<item><title>One &amp; only</title><link>https://a.example/1?source=rss</link><guid isPermaLink="false">g1</guid>
<pubDate>Mon, 01 Sep 2026 10:00:00 GMT</pubDate><category>Eng</category><category>Data</category>
<description>short</description><content:encoded><![CDATA[<p>long & raw</p>]]></content:encoded></item>
<item><title>42</title><link>https://a.example/2</link><dc:date>2026-08-01T00:00:00Z</dc:date><description>&lt;b&gt;x&lt;/b&gt;</description></item>
<item><title>No link</title></item>
<item><link>https://a.example/3</link><pubDate>soon</pubDate><dc:date>2026-08-01</dc:date></item>
</channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>Atom</title>
<entry><title type="html">A</title><link rel="self" href="https://b.example/self"/><link rel="alternate" type="text/html" href="https://b.example/a"/>
<id>id-a</id><published>2026-09-01T00:00:00Z</published><updated>2026-09-02T00:00:00Z</updated><category term="x"/><content type="html">body</content></entry>
<entry><title>B</title><link rel="self" href="https://b.example/b"/><updated>2026-09-03T00:00:00+09:00</updated><summary>sum</summary></entry></feed>"""
RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/">
<channel><title>R</title></channel><item><title>X</title><link>https://c.example/x</link><dc:date>2026-09-01</dc:date><dc:subject>s</dc:subject></item></rdf:RDF>"""


def test_formats():
    form, title, items = parse_feed("﻿" + RSS)
    assert (form, title, [i["link"] for i in items]) == ("rss2", "Feed", ["https://a.example/1?source=rss", "https://a.example/2", "https://a.example/3"])
    assert items[0]["categories"] == ["Eng", "Data"] and items[0]["content_html"] == "<p>long & raw</p>" and items[0]["guid"] == "g1"
    assert items[0]["title"] == "One & only" and items[1]["title"] == "42" and items[1]["content_html"] == "<b>x</b>" and items[2]["title"] == ""
    form, _, items = parse_feed(ATOM)
    assert form == "atom" and [i["link"] for i in items] == ["https://b.example/a", "https://b.example/b"]
    assert items[0]["categories"] == ["x"] and items[0]["guid"] == "id-a" and items[1]["content_html"] == "sum"
    form, title, items = parse_feed(RDF)
    assert (form, title, items[0]["guid"], items[0]["categories"]) == ("rdf", "R", None, [])


def test_lenient_xml():
    _, _, items = parse_feed('<rss><channel><title>t</title><item><link>https://a.example/?a=1&b=2</link><title>x &nbsp;&mdash; &foo; y</title><media:thing a="1"/></item></channel></rss>')
    assert items[0]["link"] == "https://a.example/?a=1&b=2" and "—" in items[0]["title"] and "&foo;" in items[0]["title"]


@pytest.mark.parametrize("bad", ["", "garbage", "<!DOCTYPE html><html></html>", "<other/>", "<rss><channel/></rss>", "<feed/>", "<rss><channel><item>"])
def test_not_feeds(bad):
    with pytest.raises(NotXml):
        parse_feed(bad)


def test_read_feeds(spark, tmp_path):
    rows = [("a", RSS), ("b", ATOM), ("c", "<html>"), ("d", None), ("e", "<rss><channel><title>empty</title></channel></rss>")]
    got = read_feeds(spark.createDataFrame(rows, "source_id string, body string"))
    by = {}
    for r in got.orderBy("source_id", "pos").collect():
        by.setdefault(r["source_id"], []).append(r)
    assert [r["pos"] for r in by["a"]] == [0, 1, 2]
    assert by["a"][0]["published_at"] == datetime(2026, 9, 1, 10) and by["a"][2]["published_at"] is None
    assert by["b"][1]["published_at"] == datetime(2026, 9, 2, 15)
    assert by["c"][0]["error"] == by["d"][0]["error"] == "not-xml" and by["e"][0]["pos"] is None and by["e"][0]["error"] is None
    (tmp_path / "f.xml").write_text(RSS)
    xml = {r["link"]: r for r in read_feeds_xml(str(tmp_path), spark).collect()}
    assert len(xml) == 3 and xml["https://a.example/2"]["published_at"] == datetime(2026, 8, 1)


def test_full_content(spark):
    item = lambda n: f"<rss><channel><item><link>l</link><description>{'x' * n}</description></item></channel></rss>"
    got = read_feeds(spark.createDataFrame([("a", item(2000)), ("b", item(2001))], "source_id string, body string")).orderBy("source_id").collect()
    assert [r["has_full_content"] for r in got] == [False, True]


LISTING = """<html><body><nav><a href="/blog/nav-post-1">A long enough navigation text</a></nav>
<ul><li><a href="/blog/first-post/?utm_source=x#c"><h3>First</h3></a><time datetime="2026-09-01">x</time></li>
<li><div><a href="https://a.example/blog/first-post">First again, long enough text</a></div></li>
<li><a href="/blog/second-post">A second post with a long title</a><span>Sep 2, 2026</span></li>
<li><a href="/blog/third-post">short one</a></li>
<li><a href="/blog/category" >Engineering<h2>Engineering</h2></a></li>
<li><a href="/de/blog" >The listing in another language</a></li>
<li><a href="/blog?page=2">The next page of this listing</a></li>
<li><a href="/blog/tagged-1" rel="x TAG">A tag with a long enough title</a></li>
<li><a href="/blog/german-1" hreflang="de">The same post but in German</a></li>
<li><a href="/about-us-1">Nothing that the pattern admits</a></li>
<li><a href="/blog/icon-2" aria-label="ignored"><h4> </h4> A text beside an empty heading</a></li>
<li><a href="#top">A fragment that is long enough</a><a href="javascript:x">Script that is long enough</a></li></ul>
<footer><a href="/blog/foot-1">A long enough footer link text</a></footer></body></html>"""


def _listing(spark, now, html, pattern="/blog/", exclude=None):
    pages = spark.createDataFrame([("p", html, "https://a.example/blog", pattern, exclude)], "page string, html string, base_url string, pattern string, exclude_pattern string")
    return read_listings(pages, now).orderBy("pos").collect()


def test_listing_anchors(spark, now):
    got = _listing(spark, now.replace(tzinfo=UTC), LISTING)
    assert [r["url"] for r in got] == ["https://a.example/blog/first-post/?utm_source=x", "https://a.example/blog/second-post", "https://a.example/blog/icon-2"]
    assert [r["title"] for r in got] == ["First", "A second post with a long title", "A text beside an empty heading"]
    assert [r["published_at"] for r in got][:2] == [datetime(2026, 9, 1), datetime(2026, 9, 2)] and [r["pos"] for r in got] == [0, 1, 2]
    assert [r["url"] for r in _listing(spark, now.replace(tzinfo=UTC), LISTING, exclude="second")] == [got[0]["url"], got[2]["url"]]
    assert _listing(spark, now.replace(tzinfo=UTC), None) == []
    items = as_feed_items(read_listings(spark.createDataFrame([("p", LISTING, "https://a.example/blog", "/blog/", None)], "page string, html string, base_url string, pattern string, exclude_pattern string"), now.replace(tzinfo=UTC)))
    assert items.first()["categories"] == []


def test_listing_structured_data_first(spark, now):
    ld = """<script type="application/ld+json">{broken</script><script type="application/ld+json">{"@graph":[{"@type":"BlogPosting","url":"/blog/a-1","headline":" A  1 ","datePublished":"2026-09-01"},
    {"@type":["Article"],"mainEntityOfPage":{"@id":"https://a.example/blog/b-2"},"name":"B"},{"@type":"BlogPosting","url":"/blog/c-3"},{"@type":"Person","url":"/blog/d-4","name":"D"}]}</script>
    <script type="application/ld+json">[{"@type":"ItemList","itemListElement":[{"item":{"url":"/blog/e-5","name":"E"}},{"url":"/blog?page=3","name":"F"},3]}]</script>"""
    got = _listing(spark, now.replace(tzinfo=UTC), ld + LISTING)
    assert [(r["url"], r["title"]) for r in got] == [("https://a.example/blog/a-1", "A 1"), ("https://a.example/blog/b-2", "B"), ("https://a.example/blog/e-5", "E")]
    assert got[0]["published_at"] == datetime(2026, 9, 1)
    other = '<script type="application/ld+json">{"@type":"Article","url":"/news/1","name":"N"}</script>'
    assert len(_listing(spark, now.replace(tzinfo=UTC), other + LISTING)) == 3


def test_listing_text_guard(spark, now):
    card = '<div><div><a href="/blog/a-1"><h2>T</h2></a></div><span>Sep 2, 2026</span>{}</div>'
    assert _listing(spark, now.replace(tzinfo=UTC), card.format("<script>" + "x" * 25_000 + "</script>"))[0]["published_at"] == datetime(2026, 9, 2)
    assert _listing(spark, now.replace(tzinfo=UTC), card.format("<p>" + "x" * 25_000 + "</p>"))[0]["published_at"] is None


PAGE_DATES = [
    ('<meta property="article:published_time" content="2026-09-01"><meta name="date" content="2026-01-01">', datetime(2026, 9, 1)),
    ('<meta property="article:published_time" content="soon"><meta name="pubdate" content="2026-02-01">', datetime(2026, 2, 1)),
    ('<meta name="date" content=" "><script type="application/ld+json">{"@graph":[{"x":1},{"datePublished":"2026-03-01"}]}</script>', datetime(2026, 3, 1)),
    ('<script>var a = {"publishedAt":"2026-04-01T00:00:00Z"}</script><time datetime="2026-01-01">', datetime(2026, 4, 1)),
    (r'<script>"{\"datePublished\":\"2026-04-02\"}"</script>', datetime(2026, 4, 2)),
    (r'<script>"published_at":"2026-04-03"</script>', datetime(2026, 4, 3)),
    ('<script>{"publishDate":1775174400}</script>', datetime(2026, 4, 3)),
    ('<script>{"publishDate":1775174400000}</script>', datetime(2026, 4, 3)),
    ('<script>{"publishDate":17751744000000}</script>', None),
    ('<script>{"publishDate":"1980-01-01"}</script>', None),
    ('<time datetime="2026-05-02"></time><article><time datetime="PT8M"></time><time datetime="2026-05-01"></time></article>', datetime(2026, 5, 1)),
    ("<div><div><h1>T</h1></div><p>June 1, 2026</p></div><p>June 2, 2026</p>", datetime(2026, 6, 1)),
    ("<p>on 2026-07-01 and 2026-07-02</p>", datetime(2026, 7, 1)),
    ("<p>" + "x" * 3100 + " 2026-07-01</p>", None),
    ("<script>var d = '2026-07-01'</script><template><p>2026-07-02</p></template>", None),
]


@pytest.mark.parametrize(("html", "want"), PAGE_DATES)
def test_page_date(html, want, now):
    got = published_at(parse_html(f"<html><head></head><body>{html}</body></html>"), now.replace(tzinfo=UTC))
    assert got == (want.replace(tzinfo=UTC) if want else None)


def test_main_text(spark, now):
    body = "".join(f"<p>Paragraph {i} of the story about pipelines, with enough words to count as text.</p>" for i in range(14))
    html = f'<html><head><title> A  title </title></head><body><nav>menu</nav><div class="banner">Buy</div><div id="c"><div class="post">{body}</div><div class="ad-box">advert</div></div><footer>foot</footer></body></html>'
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "id int, html string")
    rows = {r["id"]: r for r in extract_pages(df, now.replace(tzinfo=UTC)).collect()}
    assert rows[1]["title"] == "A title" and len(rows[1]["text"]) >= 800 and not any(w in rows[1]["text"] for w in ("menu", "Buy", "foot", "advert"))
    assert rows[2]["text"] is None and rows[3]["text"] == ""


def test_date_report(spark, now):
    html = '<meta name="date" content="2026-01-01"><time datetime="x"></time><p>before 2026-07-01 after</p>' + '<a href="/1"></a>' * 5
    rows = date_report(spark.createDataFrame([("u", html)], "url string, html string"), now.replace(tzinfo=UTC)).collect()
    kinds = {}
    for r in rows:
        kinds.setdefault(r["kind"], []).append(r["value"])
    assert kinds == {"meta": ["2026-01-01"], "time": ["x"], "text": ["before 2026-07-01 after"], "anchor": ["/1"] * 3}


def test_fetch(spark):
    def get(url, etag, last_modified, most=None):
        if "down" in url:
            raise TimeoutError("timed out")
        if etag == "same":
            return {"status": 304}
        return {"status": 200, "content_type": "text/html; charset=utf-8" if "page" in url else "application/json", "etag": "new", "body": url}

    targets = spark.createDataFrame([("a", "page", None, None), ("b", "down", None, None), ("c", "x", "same", None), ("d", "json", None, None)], "source_id string, url string, etag string, last_modified string")
    got = {r["source_id"]: r for r in H.html_only(H.outcome(H.fetch(targets, get=get))).collect()}
    assert [got[k]["kind"] for k in "abcd"] == ["ok", "failed", "not_modified", "ok"]
    assert got["a"]["body"] == "page" and got["d"]["body"] is None and got["b"]["error"] == "timed out"
    fetches = H.fetch(targets, get=get)
    modes = {r["source_id"]: r for r in H.with_fallback(fetches, fetches.where("source_id = 'a'").selectExpr("'b' source_id", "url", "status", "content_type", "etag", "last_modified", "body", "error")).collect()}
    assert modes["a"]["mode"] == "feed" and modes["b"]["mode"] == "listing" and modes["c"]["mode"] == "not_modified"


@pytest.fixture
def web():
    """A web server on this machine: RSS at /f.xml, a large page at /big, an image at /i; the rest is not there."""
    pages = {"/f.xml": ("text/xml", RSS.encode()), "/big": ("text/html; charset=utf-8", b"x" * 300_000), "/i": ("image/png", b"png"), "/odd": ("text/html; charset=no-such-set", "é".encode()), "/once": ("text/html", b"at last")}
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            asked.append(self.path)
            if self.path == "/cut":  # a chunked body that ends within a chunk
                self.wfile.write(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nff\r\nshort")
                return
            if self.path in ("/ftp", "/busy") or self.path == "/once" and asked.count("/once") < 3:
                self.send_response({"/ftp": 302, "/busy": 429, "/once": 503}[self.path])
                self.send_header("Retry-After", "7") if self.path == "/busy" else self.send_header("Location", "ftp://127.0.0.1/x")
                self.end_headers()
                return
            kind, body = pages.get(self.path, (None, b""))
            self.send_response(404 if kind is None else 304 if self.headers.get("If-None-Match") == "e1" else 200)
            if kind:
                self.send_header("Content-Type", kind)
                self.send_header("ETag", "e1")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_http_source(spark, tmp_path, web):
    import json

    (tmp_path / "f.xml").write_text(RSS)
    H.register(spark)
    targets = [{"source_id": i, "url": u} for i, u in (("a", f"{web}/f.xml"), ("b", f"{web}/none"), ("c", (tmp_path / "f.xml").as_uri()))]
    targets.append({"source_id": "d", "url": f"{web}/f.xml", "etag": "e1"})
    rows = {r["source_id"]: r for r in spark.read.format("http_fetch").option("targets", json.dumps(targets)).load().collect()}
    assert rows["a"]["body"] == RSS and rows["a"]["etag"] == "e1" and rows["b"]["error"] == "HTTP 404"
    assert rows["c"]["body"] is None and rows["c"]["error"].startswith("not a web address")
    assert rows["d"]["status"] == 304 and rows["d"]["error"] is None


def test_pages_are_capped_and_html_only(spark, web):
    asked = spark.createDataFrame([("big", f"{web}/big"), ("i", f"{web}/i"), ("none", f"{web}/none"), ("file", "file:///etc/hostname")], "id string, url string")
    got = {r["id"]: r["html"] for r in H.fetch_pages(asked, most=100_000).collect()}
    assert set(got) == {"big", "i"} and got["i"] is None and 100_000 < len(got["big"]) <= 100_000 + (1 << 16)
    assert len({r["id"]: r["html"] for r in H.fetch_pages(asked).collect()}["big"]) == 300_000


def test_failures_are_rows(spark, web):
    """One bad site is a row with its error; the others are fetched."""
    urls = {"cut": f"{web}/cut", "odd": f"{web}/odd", "ftp": f"{web}/ftp", "none": "http://127.0.0.1:9/", "host": "http://no host/", "ok": f"{web}/f.xml"}
    asked = spark.createDataFrame([(k, u, None, None) for k, u in urls.items()], "source_id string, url string, etag string, last_modified string")
    got = {r["source_id"]: r for r in H.outcome(H.fetch(asked)).collect()}
    assert {k: r["kind"] for k, r in got.items()} == {"cut": "failed", "odd": "ok", "ftp": "failed", "none": "failed", "host": "failed", "ok": "ok"}
    assert got["odd"]["body"] == "é" and all(got[k]["error"] and got[k]["body"] is None for k in ("cut", "ftp", "none", "host"))
    assert H.http_get(f"{web}/cut")["error"] and "ftp" in H.http_get(f"{web}/ftp")["error"]


def test_retries(web):
    waits = []
    assert H.get_with_retries(f"{web}/once", sleep=waits.append)["body"] == "at last" and waits == [1.0, 2.0]
    waits.clear()
    assert H.get_with_retries(f"{web}/busy", sleep=waits.append)["status"] == 429 and waits == [7, 7]
    waits.clear()
    for url in (f"{web}/none", "file:///etc/hostname", f"{web}/ftp"):
        assert H.get_with_retries(url, sleep=waits.append)["error"] and waits == []
    assert H.get_with_retries("http://127.0.0.1:9/", attempts=2, sleep=waits.append)["status"] is None and waits == [1.0]


def test_only_asked_targets_are_fetched(spark, web):
    """A filter on the id reaches the source: other pages are not asked for."""
    import json

    H.register(spark)
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        targets = [{"source_id": str(i), "url": f"{web}/{i}"} for i in range(6)] + [{"source_id": "x", "url": f"{web}/f.xml"}]
        read = spark.read.format("http_fetch").option("pushFilters", "true").option("targets", json.dumps(targets)).load()
        assert [r["body"] for r in read.where("source_id = 'x'").collect()] == [RSS]
        assert read.where("source_id in ('1', '2') and status = 404").count() == 2
        reader = H._FilteredReader({"targets": json.dumps(targets)}, read.schema)
        left = list(reader.pushFilters([H.EqualTo(("source_id",), "x"), H.EqualTo(("status",), 200)]))
        assert [t["source_id"] for t in reader.asked.targets] == ["x"] and len(left) == 1
    finally:
        spark.conf.set(key, before)


def test_fetch_stream(spark, tmp_path, web):
    """Rounds by the clock, a task a host, with the validators that are kept after a round."""
    import json
    import time

    H.register(spark)
    targets = [{"source_id": "a", "url": f"{web}/f.xml"}, {"source_id": "b", "url": f"{web}/none"}, {"source_id": "c", "url": web.replace("127.0.0.1", "localhost") + "/i"}]
    assert [[t["source_id"] for t in some] for some in H.by_host(targets)] == [["a", "b"], ["c"]]
    notes, out = str(tmp_path / "notes" / "validators.json"), str(tmp_path / "out")
    stream = spark.readStream.format("http_fetch").schema(H.FETCHES + ", fetched_at timestamp").option("targets", json.dumps(targets)).option("intervalSeconds", "2").option("validators", notes).load()

    def keep(batch, number):
        batch = batch.persist()
        batch.write.mode("overwrite").parquet(f"{out}/n={number}")
        fresh = batch.where("etag is not null").selectExpr("source_id id", "etag", "last_modified")
        if fresh.count():
            H.write_validators(notes, fresh)
        batch.unpersist()

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    try:
        for _ in range(120):
            time.sleep(0.5)
            if len(list(tmp_path.glob("out/n=*/_SUCCESS"))) >= 3:
                break
    finally:
        query.stop()
    rows = spark.read.parquet(out).where("n < 3").collect()
    status = {(r["n"], r["source_id"]): r["status"] for r in rows}
    assert status[0, "a"] == 200 and status[1, "a"] == 304 and status[0, "b"] == 404 and {r["source_id"] for r in rows} == {"a", "b", "c"}
    assert all(r["fetched_at"] for r in rows)
