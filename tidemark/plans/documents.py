"""Parsers and whole runs as queries: documents are wrapped into feeds, listings and pages, so that SQL knows what must come out."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import text as X
from tidemark.operators import enrich as E
from tidemark.operators import views as V
from tidemark.operators.candidates import to_candidates
from tidemark.operators.commit import commit
from tidemark.operators.run import claim, summarize
from tidemark.plans.catalog import NOW, _events, _ntz, _query, _shaped, _t
from tidemark.schemas import ARTICLES, CHATS, SOURCES
from tidemark.sources.feed import read_feeds
from tidemark.sources.listing import read_listings
from tidemark.sources.page import date_report, page_dates, page_texts
from tidemark.sources.store import Store, shared_root
from tidemark.sources.structured import structured_items as read_structured
from tidemark.streaming.ingest import admit_stream
from tidemark.streaming.live import live

_AT = datetime(2024, 2, 1, tzinfo=UTC)
# A day of 2023 for each document, in SQL and as a column.
_DAY_SQL = "(TIMESTAMP '2023-01-01 00:00:00' + INTERVAL 1 DAY * CAST(doc_id % 365 AS INTEGER))"


def _day(key: str = "doc_id") -> Column:
    return F.date_add(F.lit("2023-01-01").cast("date"), (F.col(key) % 365).cast("int"))


def _escaped(c: str) -> Column:
    s = F.col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    # control characters are not allowed in XML, and a parser trims texts
    return F.trim(F.regexp_replace(s, r"[\x00-\x08\x0B-\x1F]", ""))


@_query(
    "SELECT doc_id AS source_id, CASE doc_id % 3 WHEN 0 THEN 'rss2' WHEN 1 THEN 'atom' ELSE 'rdf' END AS format, 'Doc ' || doc_id || ' & more' AS title, 'https://x.example/' || doc_id AS link, "
    f"{_DAY_SQL} AS published_at, CASE WHEN doc_id % 3 = 2 THEN '' ELSE lang END AS category, length(trim(regexp_replace(text, '[\\x00-\\x08\\x0B-\\x1F]', '', 'g'))) > 2000 AS has_full_content FROM documents"
)
def feed_items(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source_id"), "doc_id", "lang", _escaped("text").alias("body"))
    head = F.concat(F.lit("<title>Doc "), F.col("doc_id"), F.lit(" &amp; more</title>"))
    link = F.concat(F.lit("https://x.example/"), F.col("doc_id"))
    mail = F.concat(F.lit("Mon, "), F.date_format(_day(), "dd MMM yyyy"), F.lit(" 09:00:00 +0900"))
    iso = F.date_format(_day(), "yyyy-MM-dd")
    rss = F.concat(
        F.lit("<rss version='2.0'><channel><title>t</title><item>"), head, F.lit("<link>"), link, F.lit("</link><pubDate>"), mail, F.lit("</pubDate><category>"), F.col("lang"),
        F.lit("</category><description>"), F.col("body"), F.lit("</description></item><item><title>no link</title></item></channel></rss>"),
    )
    atom = F.concat(
        F.lit("<feed xmlns='http://www.w3.org/2005/Atom'><title>t</title><entry>"), head, F.lit("<link rel='self' href='no'/><link rel='alternate' type='text/html' href='"), link,
        F.lit("'/><published>"), iso, F.lit("T00:00:00Z</published><category term='"), F.col("lang"), F.lit("'/><content>"), F.col("body"), F.lit("</content></entry></feed>"),
    )
    rdf = F.concat(
        F.lit("<rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#' xmlns='http://purl.org/rss/1.0/' xmlns:dc='http://purl.org/dc/elements/1.1/'><channel/><item>"), head,
        F.lit("<link>"), link, F.lit("</link><dc:date>"), iso, F.lit("</dc:date><description>"), F.col("body"), F.lit("</description></item></rdf:RDF>"),
    )
    kind = F.col("doc_id") % 3
    items = read_feeds(docs.select("source_id", F.when(kind == 0, rss).when(kind == 1, atom).otherwise(rdf).alias("body")))
    got = items.select(F.col("source_id").cast("long").alias("source_id"), "format", "title", "link", "published_at", F.array_join("categories", ",").alias("category"), "has_full_content")
    return _ntz(got, "published_at")


_MONTH_SQL = "|".join([*D.MONTHS, "sept", *(m[:3] for m in D.MONTHS)])
_FOUND_SQL = (
    rf"regexp_extract_all(concat_ws(' . ', text, strftime({_DAY_SQL}, '%B %-d, %Y'), strftime({_DAY_SQL}, '%-d %b %Y'), strftime({_DAY_SQL}, '%Y-%m-%dT03:00:00+01:00'), strftime({_DAY_SQL}, '%Y/%m/%d')), "
    rf"'(?i)\b({_MONTH_SQL})\.?\s+[0-9]{{1,2}},\s+[0-9]{{4}}\b|\b[0-9]{{1,2}}\s+({_MONTH_SQL})\.?\s+[0-9]{{4}}\b|\b[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(T[0-9:.Z+-]+)?|\b[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}\b')"
)
#: A date by its digits, or by its year, month name and day.
_READ_SQL = (
    "CASE WHEN x LIKE '____-__-__T%' AND TRY_CAST(rtrim(x, '.:+-') AS TIMESTAMPTZ) IS NOT NULL THEN TRY_CAST(rtrim(x, '.:+-') AS TIMESTAMPTZ) AT TIME ZONE 'UTC' WHEN regexp_matches(x, '^[0-9]{4}[-/]') THEN TRY_CAST(replace(x[1:10], '/', '-') AS TIMESTAMP) "
    "ELSE TRY_CAST(regexp_extract(x, '[0-9]{4}$') || '-' || lpad(CAST((strpos('janfebmaraprmayjunjulaugsepoctnovdec', lower(regexp_extract(x, '[A-Za-z]{3}'))) + 2) // 3 AS VARCHAR), 2, '0') "
    "|| '-' || lpad(regexp_extract(x, '[0-9]{1,2}'), 2, '0') AS TIMESTAMP) END"
)
_DATES_SQL = (
    f"WITH f AS (SELECT doc_id, list_filter(list_transform({_FOUND_SQL}, lambda x: {_READ_SQL}), lambda t: t IS NOT NULL AND year(t) BETWEEN 1990 AND 2025) AS d FROM documents) "
    "SELECT doc_id, array_to_string(list_transform(d, lambda t: strftime(t, '%Y-%m-%d %H')), ' ') AS dates FROM f"
)


@_query(_DATES_SQL)
def find_dates(spark, d):
    """All dates in all documents, those of the texts and four that are put at their ends, one in each form."""
    return _dates(_t(spark, d, "documents"))


def _dates(docs: DataFrame) -> DataFrame:
    forms = (F.date_format(_day(), "MMMM d, yyyy"), F.date_format(_day(), "d MMM yyyy"), F.concat(F.date_format(_day(), "yyyy-MM-dd"), F.lit("T03:00:00+01:00")), F.date_format(_day(), "yyyy/MM/dd"))
    text = F.concat_ws(" . ", "text", *forms)
    found = docs.select("doc_id", D.find_date_texts(text, _AT).alias("dates"))
    return found.select("doc_id", F.array_join(F.transform("dates", lambda x: F.date_format(x, "yyyy-MM-dd HH")), " ").alias("dates"))


@_query(f"SELECT page_id, {_DAY_SQL.replace('doc_id', 'page_id')} AS published_at FROM pages")
def page_date(spark, d):
    pages = _t(spark, d, "pages").select("page_id", "html")
    iso = F.date_format(_day("page_id"), "yyyy-MM-dd")
    forms = [
        F.concat(F.lit('<meta property="article:published_time" content="'), iso, F.lit('">')),
        F.concat(F.lit('<meta name="date" content="soon"><script type="application/ld+json">{"@graph":[{"datePublished":"'), iso, F.lit('"}]}</script>')),
        F.concat(F.lit(r'<script>x("{\"publishedAt\":\"'), iso, F.lit(r'T00:00:00Z\"}")</script>')),
        F.concat(F.lit('<time datetime="PT8M"></time><article><time datetime="'), iso, F.lit('"></time></article>')),
    ]
    form = F.element_at(F.array(*forms), (F.col("page_id") % 4 + 1).cast("int"))
    got = page_dates(pages.withColumn("html", F.concat(form, F.coalesce("html", F.lit("")))), _AT)
    return _ntz(got.select("page_id", "published_at"), "published_at")


@_query(f"SELECT page_id, {_DAY_SQL.replace('doc_id', 'page_id')} AS published_at FROM pages")
def page_text_date(spark, d):
    """Pages that are dated by their text only: the one date around the first heading, or without a heading the first date of the body; scripts and styles are no text."""
    named, slashed = F.date_format(_day("page_id"), "MMMM d, yyyy"), F.date_format(_day("page_id"), "yyyy/MM/dd")
    unseen = F.lit("<script>var d = 'May 1, 2011';</script><style>/* 2012-01-01 */</style><noscript>2013-01-01</noscript><template><h1>2014-01-01</h1></template>")
    around = F.concat(unseen, F.lit("<section><div><h1>A heading</h1></div><p>Posted "), named, F.lit("</p></section><p>Since 2015-01-01 and 2016-01-01</p>"), F.coalesce("html", F.lit("")))
    first = F.concat(F.lit("$1"), unseen, F.lit("<p>On "), slashed, F.lit(" and on 2016-01-01</p>"))
    bare = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), "(?i)</?h1[^>]*>", ""), F.lit("(?i)^(.*?<body[^>]*>|(?!.*<body))"), first)
    pages = _t(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, around).otherwise(bare).alias("html"))
    return _ntz(page_dates(pages, _AT).select("page_id", "published_at"), "published_at")


@_query("SELECT page_id, CASE WHEN 1980 + page_id % 60 BETWEEN 2002 AND 2025 THEN make_timestamp(1980 + page_id % 60, 7, 1, 0, 0, 0) END AS published_at FROM pages")
def page_epoch(spark, d):
    """Pages dated by a number in a script, in seconds or milliseconds, of years that are plausible or not: before September 2001 they have fewer digits than a date's."""
    year = 1980 + F.col("page_id") % 60
    seconds = F.unix_timestamp(F.make_timestamp(year, F.lit(7), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    number = F.when(F.col("page_id") % 2 == 0, seconds).otherwise(seconds * 1000).cast("string")
    html = F.concat(F.lit('<script>window.x = {"publishedAt":'), number, F.lit("}</script>"), F.coalesce("html", F.lit("")))
    return _ntz(page_dates(_t(spark, d, "pages").select("page_id", html.alias("html")), _AT).select("page_id", "published_at"), "published_at")


@_query("SELECT page_id, lpad(CAST(1000 + page_id * 37 % 9000 AS VARCHAR), 4, '0') || '-12-31' AS day FROM pages")
def page_far_date(spark, d):
    """Pages dated anywhere between the years 1000 and 9999."""
    pages = _t(spark, d, "pages")
    year = F.lpad((1000 + F.col("page_id") * 37 % 9000).cast("string"), 4, "0")
    html = F.concat(F.lit('<meta property="article:published_time" content="'), year, F.lit('-12-31">'), F.coalesce("html", F.lit("")))
    return page_dates(pages.select("page_id", html.alias("html")), _AT).select("page_id", F.date_format("published_at", "yyyy-MM-dd").alias("day"))


_LEAD = "The lead of the story says what it is about, at some length, so that nobody takes it for a caption, a menu or a notice."
_CLOSE = "The last paragraph, which closes the story, is as long as the first one; it ends, as stories do, with a full stop."


@_query(
    "WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[\\s\\x0B\\x1C-\\x1F\\x85\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'))), lambda x: x <> '') AS lines FROM documents) "
    f"SELECT doc_id, 'Story ' || doc_id AS title, array_to_string(list_concat(['{_LEAD}'], lines, ['{_CLOSE}']), chr(10)) AS text, '{_LEAD}' AS excerpt FROM l"
)
def main_text(spark, d):
    """Each document as a story on a page: a paragraph for each of its lines between a lead and a close, amid menus, notices, comments and lists of links.

    The story is in an article element, a div with a telling class, two divs without one, or a table inside a form that holds the whole page.
    """
    docs = _t(spark, d, "documents").select("doc_id", F.split("text", "\r\n?|\n").alias("lines"))
    told = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("<p>"), F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p>\n"))), "")
    lead, close = F.lit(f"<p>{_LEAD}</p>"), F.lit(f"<p>{_CLOSE}</p>")
    heading = F.concat(F.lit("<h1>Story "), F.col("doc_id"), F.lit("</h1>"))
    wrap = lambda before, after: F.concat(F.lit(before), heading, lead, told, close, F.lit(after))
    forms = F.array(
        wrap("<main><article>", "</article></main>"),
        wrap('<div class="layout"><div class="post-content" id="c1">', "</div></div>"),
        F.concat(F.lit("<div><div>"), heading, lead, F.lit("</div><div>"), told, close, F.lit("</div></div>")),
        wrap("<form><table><tr><td>", "</td></tr></table></form>"),
    )
    links = "".join(f'<li><a href="/{i}">Another story of this site, number {i}</a></li>' for i in range(8))
    before = f'<nav><ul>{links}</ul></nav><div class="site-banner">Subscribe to our letter, it comes every week, and it is free!</div><div id="sidebar-left"><h3>Related posts</h3><ul>{links}</ul></div><div class="ad-slot">Buy this, now, and that.</div>'
    comments = "".join(f'<div class="comment"><p>A reader, number {i}, has a long opinion on this, and tells it, at length, here.</p></div>' for i in range(3))
    after = f'<script>var p = "<p>no text, at all, of the page</p>";</script><div class="comments">{comments}</div><footer><p>All rights are reserved, as ever, by those who have them.</p></footer>'
    head = F.concat(F.lit("<html><head><title>Story "), F.col("doc_id"), F.lit(" | The site</title><style>p { margin: 0 }</style></head><body>"))
    body = F.concat(head, F.lit(before), F.element_at(forms, (F.col("doc_id") % 4 + 1).cast("int")), F.lit(after), F.lit("</body></html>"))
    return page_texts(docs.select("doc_id", body.alias("html"))).select("doc_id", "title", "text", "excerpt")


@_query()
def page_main_text(spark, d):
    """The articles of the pages as they are; no SQL knows their text."""
    return page_texts(_t(spark, d, "pages")).select("page_id", "title", "text", "excerpt")


@_query(
    f"SELECT page_id, CAST(0 AS INTEGER) AS pos, 'https://l.example/blog/post-' || page_id || '/?utm_source=x' AS url, 'Post ' || page_id AS title, {_DAY_SQL.replace('doc_id', 'page_id')} AS published_at FROM pages "
    "UNION ALL SELECT page_id, 1, 'https://l.example/blog/second-' || page_id, 'The second post ' || page_id || ' of the page', NULL FROM pages WHERE page_id % 2 = 0"
)
def listing_items(spark, d):
    pages = _t(spark, d, "pages").select("page_id", "html")
    n = F.col("page_id").cast("string")
    card = F.concat(
        F.lit('<nav><a href="/blog/nav-1"><h2>Nav</h2></a></nav><div><a href="/blog/post-'), n, F.lit('/?utm_source=x#c"><h3>Post '), n, F.lit('</h3></a><time datetime="'), F.date_format(_day("page_id"), "yyyy-MM-dd"),
        F.lit('"></time></div><p><a href="/blog/post-'), n, F.lit('">Another link to the same post</a></p><a href="/de/blog">The same list in another language</a><a href="/blog?page=2">The next page of the list</a>'),
    )
    second = F.concat(F.lit('<section><a href="/blog/second-'), n, F.lit('">The second post '), n, F.lit(" of the page</a></section>"))
    html = F.concat(card, F.when(F.col("page_id") % 2 == 0, second).otherwise(""), F.coalesce("html", F.lit("")))
    asked = pages.select(F.col("page_id").alias("page"), html.alias("html"), F.lit("https://l.example/us/en/blog").alias("base_url"), F.lit("^https://l.example/blog/").alias("pattern"), F.lit(None).cast("string").alias("exclude_pattern"))
    got = read_listings(asked, _AT).select(F.col("page").alias("page_id"), "pos", "url", "title", "published_at")
    return _ntz(got, "published_at")


_LINE_SQL = r"trim(regexp_replace(text, '[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', ' ', 'g'))"


@_query(
    f"WITH d AS (SELECT doc_id, CASE WHEN {_LINE_SQL} <> '' THEN {_LINE_SQL} END AS line, {_DAY_SQL} AS day FROM documents) "
    "SELECT doc_id, CAST(0 AS INTEGER) AS at, '/p/' || doc_id AS address, line AS title, day AS published_at FROM d WHERE doc_id % 5 IN (0, 2, 3) "
    "UNION ALL SELECT doc_id, CAST(n AS INTEGER), '/l/' || doc_id || '/' || n, coalesce(line, 'Named'), CASE WHEN n = 1 THEN day END FROM d, range(3) r(n) WHERE doc_id % 5 = 1"
)
def structured_items(spark, d):
    """Each document as the headline of an article in ld+json: in a graph in a list, an item list of three, a list of types with the address in mainEntityOfPage, alone after a broken
    script; every fifth is in a comment, of another type, or has no address that is a string."""
    docs = _t(spark, d, "documents").select("doc_id", "text", F.date_format(_day(), "yyyy-MM-dd").alias("day"))
    i, text, day = F.col("doc_id").cast("string"), F.col("text"), F.col("day")
    json = lambda **fields: F.replace(F.to_json(F.struct(*(F.lit(v).alias(k) if isinstance(v, str) else v.alias(k) for k, v in fields.items()))), F.lit("</"), F.lit("<\\/"))
    at = lambda kind, v: F.concat(F.lit(f'{{"@type":{kind},'), F.substring(v, F.lit(2), F.length(v)))
    script = lambda *parts: F.concat(F.lit('<script type="application/ld+json">'), *parts, F.lit("</script>"))
    post = at('"BlogPosting"', json(url=F.concat(F.lit("/p/"), i), headline=text, name="no", datePublished=day))
    listed = [json(url=F.concat(F.lit("/l/"), i, F.lit("/0")), headline=text, name="Named")]
    listed.append(F.concat(F.lit('{"position":2,"item":'), json(url=F.concat(F.lit("/l/"), i, F.lit("/1")), headline=text, name="Named", datePublished=day), F.lit("}")))
    listed.append(json(url=F.concat(F.lit("/l/"), i, F.lit("/2")), name=F.when(F.trim(X.collapse_space(text)) == "", "Named").otherwise(F.coalesce(text, F.lit("Named"))), datePublished="soon"))
    typed = at('["Thing","Article",3]', json(headline=text, datePublished=day))
    page = F.concat(F.substring(typed, F.lit(1), F.length(typed) - 1), F.lit(',"mainEntityOfPage":{"@id":"/p/'), i, F.lit('"}}'))
    forms = (
        script(F.lit('[{"@context":"x","@graph":[{"@type":"Person","url":"/no","name":"x"},'), post, F.lit("]}]")),
        script(F.lit('{"@type":"ItemList","itemListElement":['), F.concat_ws(",", *listed), F.lit(',7,{"position":4}]}')),
        script(page),
        F.concat(script(F.lit('{"@type":"BlogPosting","url":"/broken"')), F.lit("<script>var s = '<!--';</script>"), F.regexp_replace(script(post), "^<script type", "<SCRIPT async type")),
        F.concat(F.lit("<!-- "), script(F.lit('{"@type":"Article","url":"/hidden"}')), F.lit(" -->"), script(F.lit('{"@type":"Recipe","url":"/r"}')), script(F.lit('{"@type":"Article","url":7,"name":"n"}'))),
    )
    html = reduce(lambda chosen, n: chosen.when(F.col("doc_id") % 5 == n, forms[n]), range(1, 5), F.when(F.col("doc_id") % 5 == 0, forms[0]))  # only the row's own is built
    items = read_structured(docs.select("doc_id", html.alias("html")))
    return _ntz(items.select("doc_id", F.col("place.at").alias("at"), "address", "title", "published_at"), "published_at")


_FOUND_ROWS = (
    ("time", 0, "'PT8M'"), ("time", 1, "day"), ("meta", 0, "day"), ("meta", 1, "'soon'"), ("ld+json", 0, "day"), ("ld+json", 1, "'never'"), ("embedded", 0, "day || 'T00:00:00+00:00'"),
    ("text", 0, "'was made on ' || day || ' and is full of long words'"), ("anchor", 0, "'/one'"), ("anchor", 1, "'/two'"), ("anchor", 2, "'/three'"),
)


@_query(
    f"WITH p AS (SELECT page_id, strftime({_DAY_SQL.replace('doc_id', 'page_id')}, '%Y-%m-%d') AS day FROM pages) "
    + " UNION ALL ".join(f"SELECT page_id, '{kind}' AS kind, {place} AS place, {value} AS value FROM p" for kind, place, value in _FOUND_ROWS)
)
def date_findings(spark, d):
    """The date report of each page, of which the head and the first lines are planted: findings of all six kinds."""
    parts = (
        '<html><head><meta name="pubdate" content="', None, '"><meta property="article:modified" content="soon"><meta name="author" content="x"><script type="application/ld+json">{"datePublished":"', None,
        '","@graph":[{"datePublished":"never"},{"datePublished":3}]}</script><script>x = {"publishedAt":"', None, '"}</script></head><body><p>This page was made on ', None,
        ' and is full of long words, and more of them.</p><time datetime="PT8M"></time><time datetime="', None, '"></time><a href="/one">1</a><a href="/two">2</a><a href="/three">3</a>',
    )
    day = F.date_format(_day("page_id"), "yyyy-MM-dd")
    html = F.concat(*(day if p is None else F.lit(p) for p in parts), F.regexp_replace(F.coalesce("html", F.lit("")), "(?is)^.*?<body[^>]*>", ""))
    found = date_report(_t(spark, d, "pages").select("page_id", html.alias("html")), _AT)
    return found.select("page_id", "kind", "place", F.when(F.col("kind") == "text", F.regexp_replace("value", "^This page |,.*$", "")).otherwise(F.col("value")).alias("value"))


_RUNS_SQL = (
    "WITH w AS (SELECT event_type, event_id, ts, CAST(floor(date_diff('day', TIMESTAMP '2024-01-01', ts) / 16) AS INTEGER) AS week FROM events), "
    "f AS (SELECT event_type, min(week) AS cold FROM w GROUP BY 1), "
    "r AS (SELECT w.*, cold, row_number() OVER (PARTITION BY w.event_type, week ORDER BY ts DESC, event_id) AS newest FROM w JOIN f USING (event_type)) "
    "SELECT event_type AS source_id, count(*) AS stored, max(ts) AS latest_published_at FROM r WHERE week > cold OR newest = 1 GROUP BY 1"
)


def _period() -> Column:
    """16 days, the stretch of events that arrives at once."""
    return F.floor(F.datediff("ts", F.lit("2024-01-01")) / 16)


def _periods(events: DataFrame) -> list[int]:
    """The periods that have events, in order: a few a year."""
    return sorted(r[0] for r in events.select(_period()).distinct().collect())


def _cold_sources(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_type").alias("id")).distinct().withColumn("initialized", F.lit(False))


@_query(_RUNS_SQL)
def run_sequence(spark, d):
    """Events admitted period by period over a store, each but the first twice: cold sources start with their newest, a later run takes all, a repeated one nothing."""
    store = Store(spark, f"{shared_root(spark)}/run-sequence-{uuid.uuid4().hex}")
    events = _events(spark, d)
    store.write(sources=_shaped(_cold_sources(events), SOURCES))
    for turn in _periods(events):
        # a file of few row groups is few tasks, and keying a link costs more than dealing it
        dealt = events.where(_period() == turn).repartition(4 * spark.sparkContext.defaultParallelism, "event_id")
        items = dealt.select(
            F.col("event_type").alias("source_id"), F.col("event_id").cast("int").alias("pos"), F.concat(F.lit("https://e.example/"), F.col("event_id")).alias("link"), F.lit("").alias("title"),
            F.lit(None).cast("string").alias("guid"), F.col("ts").alias("published_at"), F.array().cast("array<string>").alias("categories"), F.lit(None).cast("string").alias("content_html"),
        )
        found = to_candidates(items, store.read("sources")).persist()
        for batch in [str(turn)] * (1 + bool(store.batch())):
            sources = store.read("sources")
            done = commit(found, sources, store.lookup("articles", found.select("id")), NOW, limit=None)
            store.write(batch, append={"articles": done.articles}, sources=done.sources)
            done.release()
        found.unpersist()
    counts = store.read("articles").groupBy("source_id").agg(F.count("*").alias("stored"))
    got = counts.join(store.read("sources").select(F.col("id").alias("source_id"), "latest_published_at"), "source_id")
    return _ntz(got, "latest_published_at")


@_query(_RUNS_SQL)
def stream_commit(spark, d):
    """The same admission by a stream: events arrive period by period, and marks and admitted keys are keyed state."""
    got = _streamed(spark, d, _period(), None).groupBy("source_id").agg(F.count("*").alias("stored"), F.max("published_at").alias("latest_published_at"))
    return _ntz(got, "latest_published_at")


#: Events of eight days arrive at once, and a source admits a quarter of what comes on average.
_WEEKS, _CAP = 8, 4


@_query(
    f"WITH w AS (SELECT event_type, event_id, ts, date_diff('day', TIMESTAMP '2024-01-01', ts) // {_WEEKS} AS week FROM events), "
    "f AS (SELECT event_type, min(week) AS cold FROM w GROUP BY 1), c AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id::VARCHAR) AS place FROM w JOIN f USING (event_type) WHERE week > cold), "
    f"p AS (SELECT DISTINCT week FROM w), n AS (SELECT CAST(count(*) // (5 * {_CAP} * (SELECT count(*) FROM p)) AS BIGINT) + 1 AS cap FROM w), "
    # what came up to a batch, and what may be admitted after it: the least of these sums is what was admitted
    "a AS (SELECT t.event_type, p.week, (SELECT count(*) FROM c WHERE c.event_type = t.event_type AND c.week <= p.week) AS came, count(*) FILTER (c.week = p.week) > 0 AS has FROM f t JOIN p ON p.week > t.cold LEFT JOIN c ON c.event_type = t.event_type AND c.week = p.week GROUP BY ALL), "
    "b AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY week DESC) - 1 AS later, count(*) OVER (PARTITION BY event_type) AS batches FROM a WHERE has), "
    "k AS (SELECT event_type, least(min(came + later * cap), any_value(batches) * any_value(cap)) AS admitted FROM b, n GROUP BY 1), "
    "r AS (SELECT event_type, event_id, ts FROM c JOIN k USING (event_type) WHERE place <= admitted "
    "UNION ALL SELECT event_type, event_id, ts FROM (SELECT w.*, row_number() OVER (PARTITION BY w.event_type ORDER BY ts DESC, event_id::VARCHAR DESC) AS newest FROM w JOIN f USING (event_type) WHERE week = cold) WHERE newest = 1) "
    "SELECT event_type AS source_id, CAST(event_id AS VARCHAR) AS id, ts AS published_at FROM r"
)
def stream_cap(spark, d):
    """A stream with a cap: of what arrives in eight days a source admits some, the oldest first, and what waits is keyed state."""
    weeks = F.floor(F.datediff("ts", F.lit("2024-01-01")) / _WEEKS)
    rows, many = _events(spark, d).agg(F.count("*"), F.count_distinct(weeks)).first()
    return _ntz(_streamed(spark, d, weeks, rows // (5 * _CAP * max(1, many)) + 1), "published_at")


@_query(
    f"WITH w AS (SELECT event_type, date_diff('day', TIMESTAMP '2024-01-01', ts) // {_WEEKS} AS week FROM events), t AS (SELECT week, CAST(dense_rank() OVER (ORDER BY week) AS BIGINT) AS version FROM (SELECT DISTINCT week FROM w)) "
    "SELECT version, event_type AS source_id, count(*) AS articles FROM t JOIN w ON w.week <= t.week GROUP BY ALL"
)
def live_counts(spark, d):
    """What a live query shows of a store that grows by eight days of events a write: after each write the articles of each source."""
    root = f"{shared_root(spark)}/live-{uuid.uuid4().hex}"
    store = Store(spark, f"{root}/store")
    events = _events(spark, d).withColumn("week", F.floor(F.datediff("ts", F.lit("2024-01-01")) / _WEEKS))
    rows = events.select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("source_id"), "week")
    counts = lambda s: s.read("articles").groupBy("source_id").agg(F.count("*").alias("articles"))
    show = lambda version, view: view.withColumn("version", F.lit(version).cast("long")).write.mode("overwrite").parquet(f"{root}/shown/version={version}")
    query = live(store, counts, show, f"{root}/checkpoint", every="0 seconds")
    try:
        for turn in sorted(r[0] for r in events.select("week").distinct().collect()):
            store.write(append={"articles": _shaped(rows.where(F.col("week") == turn).drop("week"), ARTICLES)})
            query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema("version long, source_id string, articles long").parquet(f"{root}/shown").select("version", "source_id", "articles")


def _streamed(spark, d, period: Column, limit: int | None) -> DataFrame:
    """What a stream of all events admits that arrive period by period."""
    root = f"{shared_root(spark)}/stream-commit-{uuid.uuid4().hex}"
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = _events(spark, d).select(F.col("event_type").alias("source_id"), F.col("event_id").cast("string").alias("id"), F.col("ts").alias("published_at"), period.alias("period"))
    schema = "source_id string, id string, published_at timestamp"
    try:
        for turn in sorted(r[0] for r in events.select("period").distinct().collect()):
            events.where(F.col("period") == turn).drop("period").write.mode("append").parquet(f"{root}/in")
            admitted = admit_stream(spark.readStream.schema(schema).parquet(f"{root}/in"), limit)
            run = admitted.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
            run.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(schema).parquet(f"{root}/out")


@_query(
    "SELECT doc_id AS id, CASE WHEN len(text) >= 200 THEN 'rss' ELSE 'none' END AS content_source, CASE WHEN text = '' OR doc_id % 10 = 0 THEN 'error' ELSE 'done' END AS status, "
    "CASE WHEN text = '' OR doc_id % 10 = 0 THEN 1 ELSE 0 END AS attempts, CASE WHEN NOT (text = '' OR doc_id % 10 = 0) THEN 'h' || doc_id END AS headline FROM documents"
)
def enrich_batch(spark, d):
    def model(row: dict) -> str:
        return "none" if int(row["id"]) % 10 == 0 else f'{{"headline":"h{row["id"]}","brief":"","digest":[],"detail":"","tags":[]}}'

    docs = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("source_id"), F.lit("t").alias("title"), F.lit("u").alias("url"), F.col("text").alias("rss_summary"), F.lit("summarizing").alias("status"), F.lit(0).alias("attempts"))
    pages = docs.select("id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("timestamp").alias("published_at")).where(F.lit(False))
    done = E.enrich(_shaped(docs, ARTICLES), pages, spark.createDataFrame([], SOURCES), model, NOW)
    return done.select(F.col("id").cast("long").alias("id"), "content_source", "status", "attempts", F.col("summary.headline").alias("headline"))


@_query(
    "SELECT doc_id AS id, CASE WHEN doc_id % 4 = 2 THEN 'summarizing' WHEN doc_id % 4 = 3 THEN 'new' WHEN coalesce(text, '') = '' OR doc_id % 10 = 0 THEN 'error' ELSE 'done' END AS status, "
    "CASE WHEN doc_id % 4 < 2 AND (coalesce(text, '') = '' OR doc_id % 10 = 0) THEN 1 ELSE 0 END AS attempts, doc_id % 4 = 2 AS is_claimed, CASE WHEN doc_id % 4 < 2 AND NOT (coalesce(text, '') = '' OR doc_id % 10 = 0) THEN 'h' || doc_id END AS headline FROM documents"
)
def claim_and_recover(spark, d):
    """Documents as waiting articles, by the rest of their id: 0 claimed by a job that dies, 1 never claimed, 2 claimed by a job that is still alive, 3 beyond the last job's limit.

    A last job, 16 minutes after the first and 4 after the second, finds what the dead one left and takes as many as are of rest 0 and 1.
    """

    def model(row: dict) -> str:
        return "none" if int(row["id"]) % 10 == 0 else f'{{"headline":"h{row["id"]}","brief":"","digest":[],"detail":"","tags":[]}}'

    store = Store(spark, f"{shared_root(spark)}/claims-{uuid.uuid4().hex}")
    rest = F.col("doc_id") % 4
    # by date the claims of the dead job come first, then those of the living one
    day = F.when(rest == 0, 3).when(rest == 2, 2).when(rest == 1, 1).otherwise(0)
    docs = _t(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("source_id"), F.lit("t").alias("title"), F.lit("u").alias("url"), F.col("text").alias("rss_summary"),
        F.lit("new").alias("status"), F.lit(0).alias("attempts"), F.date_add(F.lit("2024-01-01").cast("date"), day).cast("timestamp").alias("published_at"), F.lit(False).alias("published_at_provisional"),
    )
    store.write(articles=_shaped(docs, ARTICLES), sources=spark.createDataFrame([], SOURCES))
    many = dict(_t(spark, d, "documents").groupBy(rest).agg(F.count("*")).collect())
    claim(store, NOW, limit=many.get(0, 0))
    claim(store, NOW + timedelta(minutes=12), limit=many.get(2, 0))
    pages = docs.select("id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("timestamp").alias("published_at")).where(F.lit(False))
    summarize(store, pages, model, NOW + timedelta(minutes=16), limit=many.get(0, 0) + many.get(1, 0))
    claimed = F.col("summarizing_at").isNotNull()
    return store.read("articles").select(F.col("id").cast("long").alias("id"), "status", "attempts", claimed.alias("is_claimed"), F.col("summary.headline").alias("headline"))


@_query(
    "WITH a AS (SELECT event_id, event_type, event_id % 2 = 0 AS moves, ts + INTERVAL 1 DAY * CAST(event_id % 9 - 6 AS INTEGER) AS real_ts, ts FROM events), m AS (SELECT event_type, TIMESTAMP '2024-01-15' AS mark FROM a GROUP BY 1) "
    "SELECT event_id AS id, CASE WHEN moves THEN real_ts ELSE ts END AS published_at FROM a JOIN m USING (event_type) WHERE NOT (moves AND real_ts <= mark - INTERVAL 3 DAYS)"
)
def redate_provisional(spark, d):
    e = _events(spark, d).withColumn("id", F.col("event_id").cast("string"))
    rows = e.select("id", F.col("event_type").alias("source_id"), F.col("ts").alias("published_at"), (F.col("event_id") % 2 == 0).alias("published_at_provisional"))
    pages = e.select("id", F.lit("").alias("text"), F.expr("ts + make_dt_interval(cast(event_id % 9 - 6 as int))").alias("published_at"))
    marks = e.select(F.col("event_type").alias("id")).distinct().withColumn("latest_published_at", F.lit("2024-01-15").cast("timestamp"))
    kept, _, _ = E.redate(_shaped(rows, ARTICLES), pages, _shaped(marks, SOURCES), drop_old=True)
    return _ntz(kept.select(F.col("id").cast("long").alias("id"), "published_at"), "published_at")


@_query(
    "SELECT conv_id AS article_id, count(*) AS n, array_to_string(list(role ORDER BY turn), ',') AS roles FROM conversations WHERE role <> 'system' GROUP BY conv_id"
)
def chat_append(spark, d):
    """Threads grown by two appends, first and later turns; refused answers (here: system turns) are not kept."""
    turns = _t(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("article_id"), F.col("turn").alias("pos"), "role", F.col("text").alias("content"), (F.col("role") == "system").alias("refused"))
    chats = V.append_messages(spark.createDataFrame([], CHATS), turns.where("pos <= 1"), NOW)
    chats = V.append_messages(chats, turns.where("pos > 1"), NOW)
    roles = F.array_join(F.transform(V.history(F.col("messages")), lambda m: m["role"]), ",")
    return chats.where(F.size("messages") > 0).select(F.col("article_id").cast("long").alias("article_id"), F.size("messages").cast("long").alias("n"), roles.alias("roles"))


@_query(
    "SELECT page_id, url, CASE WHEN length(s) > 60 THEN substr(s, 1, 59) || '…' ELSE s END AS cell FROM (SELECT page_id, url, trim(regexp_replace(coalesce(html, ''), '[\\s\\x0B]+', ' ', 'g')) AS s FROM pages)"
)
def report_table(spark, d):
    cells = V.report_cells(_t(spark, d, "pages").select("page_id", "url", F.col("html").alias("cell")))
    return cells.withColumn("page_id", F.col("page_id").cast("long"))


@_query(
    "WITH t AS (SELECT CAST(s_suppkey AS VARCHAR) AS name, true AS p, s_suppkey % 4 <> 0 AS ok, s_suppkey % 8 = 0 AS saved FROM supplier) "
    "SELECT count(*) FILTER (p AND ok) AS ok, count(*) FILTER (p) AS total, "
    "(SELECT array_to_string(list(name ORDER BY name), ',') FROM (SELECT DISTINCT name FROM t WHERE p AND NOT ok AND saved ORDER BY name LIMIT 30)) AS rescued, "
    "CAST(count(*) FILTER (p) - count(*) FILTER (p AND ok) - count(DISTINCT CASE WHEN p AND NOT ok AND saved THEN name END) AS BIGINT) AS unrescued FROM t"
)
def health_summary(spark, d):
    s = _t(spark, d, "supplier")
    tests = s.select(F.col("s_suppkey").cast("string").alias("name"), F.lit(True).alias("is_primary"), (F.col("s_suppkey") % 4 != 0).alias("ok"))
    return V.health(tests, s.where("s_suppkey % 8 = 0").select(F.col("s_suppkey").cast("string").alias("name"))).withColumns({"unrescued": F.col("unrescued").cast("long"), "rescued": F.array_join("rescued", ",")})
