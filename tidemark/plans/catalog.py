"""Every operator as a query over the driver's tables, with the DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions import text as X
from tidemark.functions import url as U
from tidemark.functions.html import html_to_text
from tidemark.operators import enrich as E
from tidemark.operators import views as V
from tidemark.operators.commit import commit, first_of_key, fresh_rows
from tidemark.operators.sources import upsert_sources
from tidemark.schemas import ARTICLES, SOURCES
from tidemark.sources.feed import in_categories

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: The time of all runs of these queries.
NOW = datetime(2024, 2, 1)


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Canonical URL of the pages table in SQL: its URLs have at most one tracking parameter, a page number and plain values.
_N = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '^http:', 'https:'), "
    "'([?&])(utm_[a-z]*|ref|source|gi|fbclid|mkt_tok)=[^&]*', '\\1', 'g'), '[?&]+$', ''), '/$', '')"
)
# Text of the pages table in SQL: tokens, then lines, then paragraphs.
_TOKENS = "(?is)<!--.*?-->|" + "".join(f"<{t}\\b[^>]*>.*?</{t}\\s*>|" for t in ("script", "style", "noscript", "template")) + "<[^>]+>|[^<]+|<"
_FLAT = (
    f"array_to_string(list_transform(regexp_extract_all(html, '{_TOKENS}'), lambda t: CASE WHEN regexp_matches(t, '(?i)^<(br\\s*/?|/(p|div|li|tr|h[1-6])\\s*)>$') THEN chr(10) "
    "WHEN len(t) > 1 AND t[1] = '<' THEN '' ELSE t END), '')"
)
for _name, _char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("nbsp", " "), ("amp", "&")):
    _FLAT = f"replace({_FLAT}, '&{_name};', '{_char}')"
_LINES = f"list_transform(string_split_regex({_FLAT}, '\\r\\n?|\\n'), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g')))"
_H = f"trim(array_to_string(list_filter(string_split_regex(array_to_string({_LINES}, chr(10)), '\\n\\n+'), lambda p: p <> ''), chr(10) || chr(10)), ' ' || chr(10))"


@_query(f"SELECT page_id, {_N} AS canonical FROM pages")
def normalize_url(spark, d):
    return _t(spark, d, "pages").select("page_id", U.normalize_url(F.col("url")).alias("canonical"))


@_query(f"SELECT page_id, sha256({_N}) AS key FROM pages")
def url_key(spark, d):
    return _t(spark, d, "pages").select("page_id", U.url_key(F.col("url")).alias("key"))


@_query(f"SELECT page_id, {_H} AS text FROM pages")
def html_to_text_pages(spark, d):
    return _t(spark, d, "pages").select("page_id", html_to_text(F.col("html")).alias("text"))


def _variants(spark, d) -> DataFrame:
    """Each page under its URL and under a variant that names the same page."""
    pages = _t(spark, d, "pages").select("page_id", "url")
    other = F.concat(F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "[?].*$", ""), F.lit("?utm_medium=x#again"))
    both = pages.withColumn("copy", F.lit(0)).unionByName(pages.select((F.col("page_id") + 1_000_000).alias("page_id"), other.alias("url"), F.lit(1).alias("copy")))
    return both


@_query(
    f"WITH v AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id + 1000000, regexp_replace(regexp_replace(url, '#.*$', ''), '[?].*$', '') || '?utm_medium=x#again' FROM pages), "
    f"k AS (SELECT page_id, url, sha256({_N}) AS id FROM v) "
    "SELECT id, page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY page_id) AS r FROM k) WHERE r = 1"
)
def page_dedupe_first_wins(spark, d):
    keyed = _variants(spark, d).select("page_id", "url", U.url_key(F.col("url")).alias("id"))
    return first_of_key(keyed, "id", order="page_id").select("id", "page_id", "url")


@_query(
    f"SELECT page_id, regexp_matches({_N}, '[?&]page(=|&|$)') AS paged, regexp_matches({_N}, '/en/[0-9]+') AS included, "
    f"regexp_matches({_N}, 'spam|pills') AS rejected, regexp_matches({_N}, '[?&]page(=|&|$)') OR regexp_matches({_N}, '/(en|fr)/[0-9]*7$') AS excluded FROM pages"
)
def url_exclusions(spark, d):
    key = U.normalize_url(F.col("url"))
    return _t(spark, d, "pages").select("page_id", U.has_page_query(key).alias("paged"), key.rlike("/en/[0-9]+").alias("included"), key.rlike("spam|pills").alias("rejected"), U.excluded(key, F.lit("https://l.example/"), "/(en|fr)/[0-9]*7$").alias("excluded"))


@_query(
    f"WITH s AS (SELECT page_id, list_filter(string_split(regexp_replace(regexp_replace({_N}, '^https://[^/]*', ''), '[?].*$', ''), '/'), lambda p: p <> '') AS seg FROM pages) "
    "SELECT page_id, array_to_string(CASE WHEN len(seg) > 0 AND regexp_matches(seg[1], '^[a-zA-Z]{2}(-[a-zA-Z]{2})?$') THEN seg[2:] ELSE seg END, '/') AS rest FROM s"
)
def locale_strip(spark, d):
    parts = U.without_locale(U.segments(U.normalize_url(F.col("url"))))
    return _t(spark, d, "pages").select("page_id", F.array_join(parts, "/").alias("rest"))


@_query(
    "WITH j AS (SELECT doc_id, text, html FROM documents LEFT JOIN pages ON doc_id = page_id) "
    f"SELECT doc_id, CASE WHEN len(coalesce({_H}, '')) >= 800 THEN 'page' WHEN len(text) >= 200 THEN 'rss' ELSE 'none' END AS content_source, "
    f"CAST(len(CASE WHEN len(coalesce({_H}, '')) >= 800 THEN {_H} ELSE text END) AS BIGINT) AS chars FROM j"
)
def content_source(spark, d):
    pages = _t(spark, d, "pages").select(F.col("page_id").alias("doc_id"), html_to_text(F.col("html")).alias("page"))
    both = _t(spark, d, "documents").select("doc_id", "text").join(pages, "doc_id", "left").withColumn("c", X.choose_content(F.col("page"), F.col("text")))
    return both.select("doc_id", F.col("c.content_source").alias("content_source"), F.length("c.text").cast("long").alias("chars"))


@_query("SELECT doc_id, CASE WHEN len(text) <= 500 THEN text ELSE substr(text, 1, 500) || '（以下省略）' END AS cut FROM documents")
def truncate_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.truncate(F.col("text"), 500, X.OMITTED).alias("cut"))


@_query("SELECT sha256(text) AS id, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def exact_dedupe_text(spark, d):
    keyed = _t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("id"))
    copies = keyed.groupBy("id").agg(F.count("*").alias("copies"))
    return first_of_key(keyed, "id", order="doc_id").join(copies, "id").select("id", "doc_id", "copies")


@_query(
    "SELECT doc_id, len(c) = 0 OR list_has_any(list_transform(c, lambda x: lower(x)), ['en', 'src3']) AS kept FROM "
    "(SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN []::VARCHAR[] ELSE [upper(lang), source] END AS c FROM documents)"
)
def category_overlap(spark, d):
    none = F.array().cast("array<string>")
    categories = F.when(F.col("doc_id") % 7 == 0, none).otherwise(F.array(F.upper("lang"), F.col("source")))
    wanted = F.array(F.lit("EN"), F.lit("Src3"))
    return _t(spark, d, "documents").select("doc_id", in_categories(categories, wanted).alias("kept"))


# Events as candidates: the event type is the source, an event's time its date. Half of the types have a mark.
_MARKS = "SELECT event_type, CASE WHEN event_type < 'm' THEN TIMESTAMP '2024-01-20 00:00:00' END AS mark FROM (SELECT DISTINCT event_type FROM events)"


def _shaped(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with all columns of a schema, null where it has none."""
    fields = df.sparkSession.createDataFrame([], schema).schema.fields
    return df.select(*(F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields))


def _events(spark, d) -> DataFrame:
    return _t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _mark() -> F.Column:
    return F.when(F.col("event_type") < "m", F.lit("2024-01-20 00:00:00").cast("timestamp"))


def _ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@_query("SELECT event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS r FROM events) WHERE r = 1")
def newest_per_source(spark, d):
    items = _events(spark, d).select("event_type", F.col("event_id").alias("pos"), F.col("ts").alias("published_at"))
    return _ntz(V.newest_dated(items, "event_type").select("event_type", F.col("pos").alias("event_id"), F.col("published_at").alias("ts")), "ts")


def _candidates(events: DataFrame) -> DataFrame:
    """Events as candidates: the type is the source, the id the key, the time the date."""
    return events.select(
        F.col("event_type").alias("source_id"),
        F.col("event_id").cast("int").alias("pos"),
        F.col("event_id").cast("string").alias("id"),
        F.lit("").alias("link"),
        F.lit("").alias("title"),
        F.lit(None).cast("string").alias("guid"),
        F.col("ts").alias("published_at"),
        F.lit(None).cast("string").alias("content_html"),
    )


def _marked_sources(events: DataFrame) -> DataFrame:
    return events.select("event_type").distinct().select(F.col("event_type").alias("id"), _mark().isNotNull().alias("initialized"), _mark().alias("latest_published_at"))


@_query(f"SELECT e.event_id FROM events e JOIN ({_MARKS}) m USING (event_type) WHERE m.mark IS NULL OR e.ts > m.mark - INTERVAL 3 DAYS")
def grace_threshold(spark, d):
    events = _events(spark, d)
    none = events.limit(0).select(F.col("event_id").cast("string").alias("id"))
    rows = fresh_rows(_candidates(events), _marked_sources(events).withColumn("mode", F.lit("feed")), none)
    return rows.where("fresh").select(F.col("id").cast("long").alias("event_id"))


def _commit(spark, d):
    """The commit of all events at a cap of 20: every third event is stored, marks as above."""
    events = _events(spark, d)
    stored = events.where("event_id % 3 = 0").select(F.col("event_id").cast("string").alias("id"))
    base = _marked_sources(events)
    candidates = _candidates(events)
    return commit(candidates, _shaped(base, SOURCES), stored, NOW, limit=20)


_OPEN = (
    f"WITH m AS ({_MARKS}), f AS (SELECT e.event_type, e.event_id, e.ts, m.mark, e.event_id % 3 = 0 AS stored FROM events e JOIN m USING (event_type) "
    "WHERE m.mark IS NULL OR e.ts > m.mark - INTERVAL 3 DAYS), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY event_type, stored ORDER BY ts, event_id) AS oldest, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS newest, "
    "sum(CASE WHEN stored THEN 0 ELSE 1 END) OVER (PARTITION BY event_type) AS waiting FROM f), "
    "t AS (SELECT * FROM r WHERE NOT stored AND CASE WHEN mark IS NULL THEN newest = 1 ELSE oldest <= 20 END) "
)


@_query(_OPEN + "SELECT event_type AS source_id, CAST(event_id AS VARCHAR) AS id, ts AS published_at FROM t")
def cap_oldest_first(spark, d):
    return _ntz(_commit(spark, d).articles.select("source_id", "id", "published_at"), "published_at")


@_query(
    _OPEN + "SELECT event_type AS source_id, CAST((SELECT count(*) FROM t WHERE t.event_type = r.event_type) AS INTEGER) AS added, "
    "CAST(max(CASE WHEN mark IS NULL THEN 0 ELSE greatest(0, waiting - 20) END) AS INTEGER) AS carried_over FROM r GROUP BY event_type"
)
def carried_over(spark, d):
    return _commit(spark, d).metrics.select("source_id", "added", "carried_over")


@_query(
    _OPEN + "SELECT event_type AS id, greatest(max(mark), max(CASE WHEN mark IS NULL AND newest = 1 THEN ts WHEN mark IS NOT NULL AND waiting > 20 AND NOT stored AND oldest <= 20 THEN ts "
    "WHEN mark IS NOT NULL AND waiting <= 20 THEN ts END)) AS latest_published_at FROM r GROUP BY event_type"
)
def high_water_mark(spark, d):
    return _ntz(_commit(spark, d).sources.select("id", "latest_published_at"), "latest_published_at")


@_query("SELECT CAST(event_id AS VARCHAR) AS id, ts FROM events WHERE event_type <> 'view' ORDER BY ts DESC, CAST(event_id AS VARCHAR) LIMIT 30")
def topn_global(spark, d):
    queue = _events(spark, d).where("event_type <> 'view'").select(F.col("event_id").cast("string").alias("id"), F.col("ts").alias("published_at"))
    return _ntz(E.choose(queue, 30)[0].select("id", F.col("published_at").alias("ts")), "ts")


@_query(
    "SELECT event_id, CASE WHEN s = 'summarizing' AND TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 15 MINUTES >= coalesce(ts, TIMESTAMP '1970-01-01') THEN 'new' ELSE s END AS status "
    "FROM (SELECT event_id, ts, CASE event_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'summarizing' WHEN 2 THEN 'done' ELSE 'error' END AS s FROM events)"
)
def orphans(spark, d):
    status = F.expr("CASE event_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'summarizing' WHEN 2 THEN 'done' ELSE 'error' END")
    rows = _events(spark, d).select("event_id", status.alias("status"), F.col("ts").alias("summarizing_at"))
    return E.recover(rows, datetime(2024, 1, 20, 12)).select("event_id", "status")


@_query(
    "SELECT CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'https://o.example/' || s_suppkey ELSE 'https://f.example/' || s_suppkey END AS feed_url, "
    "CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 5 <> 0 AND s_suppkey % 2 = 0 THEN 'e' || s_suppkey END AS etag, s_suppkey % 3 = 0 AS initialized FROM supplier"
)
def source_upsert(spark, d):
    supplier = _t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), "s_suppkey", "s_name")
    seed = _shaped(supplier.select("id", F.col("s_name").alias("name"), F.concat(F.lit("https://f.example/"), "id").alias("feed_url")), SOURCES)
    old_host = F.when(F.col("s_suppkey") % 2 == 0, "https://f.example/").otherwise("https://old.example/")
    stored = supplier.where("s_suppkey % 3 = 0").select("id", F.concat(old_host, "id").alias("feed_url"), F.concat(F.lit("e"), "id").alias("etag"), F.lit(True).alias("initialized"))
    overrides = supplier.where("s_suppkey % 5 = 0").select("id", F.concat(F.lit("https://o.example/"), "id").alias("feed_url"))
    return upsert_sources(seed, _shaped(stored, SOURCES), overrides).select("id", "feed_url", "etag", "initialized")


@_query(
    "SELECT CAST(o_orderkey AS VARCHAR) AS id, coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS source_name, o_orderpriority AS headline, o_orderdate AS published_at, o_orderstatus = 'P' AS is_read "
    "FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey IN (1, 2, 3) AND o_orderstatus <> 'P'"
)
def article_view(spark, d):
    customer = _t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("string").alias("source_id"))
    orders = _t(spark, d, "orders").join(customer, "o_custkey")
    given = orders.select(
        F.col("o_orderkey").cast("string").alias("id"),
        "source_id",
        F.col("o_orderpriority").alias("title"),
        F.col("o_orderdate").cast("timestamp").alias("published_at"),
        F.lit("done").alias("status"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate").cast("timestamp")).alias("read_at"),
    )
    articles = _shaped(given, ARTICLES)
    nations = _t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    cards = V.article_list(articles, nations, source_ids=["1", "2", "3"], unread_only=True, status="done")
    return _ntz(cards.select("id", "source_name", "headline", "published_at", "is_read"), "published_at")


@_query(
    "SELECT count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type = 'click') AS failed, (SELECT array_to_string(list_sort(list(error)), ',') "
    "FROM (SELECT user_id || ': ' || event_id AS error FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 30)) AS errors FROM events"
)
def batch_status(spark, d):
    """The status of all events as one batch, with the report's first errors."""
    rows = _batch(_events(spark, d))
    return V.batch_status(rows, rows.select("id")).withColumn("errors", F.array_join("errors", ","))


def _batch(e: DataFrame) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "click", "error").otherwise("new")
    return e.select("event_id", F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("title"), status.alias("status"), F.col("event_id").cast("string").alias("error"))


@_query("SELECT count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type = 'click') AS failed FROM events")
def batch_counts(spark, d):
    rows = _batch(_events(spark, d))
    return V.batch_counts(rows, rows.select("id"))


@_query("SELECT event_id AS id, user_id || ': ' || event_id AS error FROM events WHERE event_type = 'click'")
def batch_errors(spark, d):
    rows = _batch(_events(spark, d))
    return V.batch_errors(rows, rows.select("id"))


@_query(
    "SELECT event_type AS source_id, count(*) AS items, count(CASE WHEN event_id % 2 = 0 THEN ts END) AS dated, min(event_id) AS first_item, "
    "arg_max(event_id, (CASE WHEN event_id % 2 = 0 THEN ts ELSE TIMESTAMP '1970-01-01' END, -event_id)) AS newest FROM events GROUP BY 1"
)
def health_report(spark, d):
    items = _events(spark, d).select(
        F.col("event_type").alias("source_id"),
        F.col("event_id").alias("pos"),
        F.col("event_id").cast("string").alias("title"),
        F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("published_at"),
        F.lit("rss2").alias("format"),
        F.lit(None).cast("string").alias("error"),
    )
    as_id = lambda c: F.col(c).cast("long")
    return V.feed_tests(items).select("source_id", "items", "dated", as_id("first.title").alias("first_item"), as_id("newest.title").alias("newest"))


@_query(
    "SELECT conv_id, array_to_string(list(turn || '|' || role || '|' || text ORDER BY turn), chr(10)) AS thread, count(*) AS n FROM conversations GROUP BY conv_id"
)
def thread_assembly(spark, d):
    told = V.threads(_t(spark, d, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", "turn", "role", "text")
    line = F.transform("messages", lambda m: F.concat_ws("|", m["turn"].cast("string"), m["role"], m["text"]))
    return told.select("conv_id", F.array_join(line, "\n").alias("thread"), "n")


@_query(
    "SELECT doc_id AS id, coalesce(nullif(CASE WHEN doc_id % 4 = 0 THEN text END, ''), CASE WHEN doc_id % 4 = 1 THEN 'h' || chr(10) || chr(10) || '- ' || source || chr(10) || '- ' || lang || chr(10) || chr(10) || 'd' END, "
    "nullif(CASE WHEN doc_id % 4 = 2 THEN lang ELSE '' END, ''), source) AS context FROM documents"
)
def chat_context(spark, d):
    kind = F.col("doc_id") % 4
    summary = F.struct(F.lit("h").alias("headline"), F.lit("").alias("brief"), F.array("source", "lang").alias("digest"), F.lit("d").alias("detail"), F.array("lang").alias("tags"))
    rows = _t(spark, d, "documents").select(
        F.col("doc_id").alias("id"),
        F.when(kind == 0, F.col("text")).alias("content_text"),
        F.when(kind == 1, summary).alias("summary"),
        F.when(kind == 2, F.col("lang")).otherwise("").alias("rss_summary"),
        F.col("source").alias("title"),
    )
    return V.chat_context(rows)


@_query("SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS tags FROM events GROUP BY user_id")
def array_distinct_tags(spark, d):
    tags = _events(spark, d).groupBy("user_id").agg(F.collect_list("event_type").alias("t"))
    return tags.select("user_id", X.filter_key(F.array_distinct("t")).alias("tags"))


@_query(
    "SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN 'h' || event_id END AS headline FROM events"
)
def json_strict(spark, d):
    good = F.concat(F.lit('{"headline":"h'), F.col("event_id"), F.lit('","brief":"b","digest":["x"],"detail":"d","tags":[]}'))
    text = (
        F.when(F.col("event_id") % 4 == 0, good)
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit("Here it is: "), good, F.lit(" done.")))
        .when(F.col("event_id") % 4 == 2, F.regexp_replace(good, '"b"', "1"))
        .otherwise(F.col("props"))
    )
    return _events(spark, d).select("event_id", X.parse_summary(text)["headline"].alias("headline"))


@_query("SELECT event_id, CAST(json_extract(props, '$.ab') AS VARCHAR) AS ab, coalesce(CAST(greatest(0, least(100, floor(value))) AS BIGINT), 0) AS clamped FROM events")
def json_and_clamp(spark, d):
    raw = F.try_variant_get(F.try_parse_json("props"), "$.ab", "string")
    return _events(spark, d).select("event_id", F.when(raw.isNotNull(), F.concat(F.lit('"'), raw, F.lit('"'))).alias("ab"), X.clamp(F.col("value"), 0, 100).cast("long").alias("clamped"))


@_query(
    "WITH c AS (SELECT page_id, url FROM pages) SELECT page_id, regexp_matches(lower(url), '^(javascript|mailto):') OR url = '' AS ignorable, "
    "regexp_replace(url, '^([a-z]+://[^/]*).*$', '\\1') AS origin FROM c"
)
def url_parts(spark, d):
    return _t(spark, d, "pages").select("page_id", U.is_ignorable_href(F.col("url")).alias("ignorable"), U.origin(F.col("url")).alias("origin"))


_SPACES_SQL = r"SELECT doc_id, trim(regexp_replace(text, '[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', ' ', 'g')) AS line, CAST(len(text) + len(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g')) AS INTEGER) AS units FROM documents"


@_query(_SPACES_SQL)
def space_and_units(spark, d):
    return _spaces(_t(spark, d, "documents"))


def _spaces(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", X.collapse_space(F.col("text")).alias("line"), X.utf16_length(F.col("text")).alias("units"))


@_query("SELECT user_id, count(*) AS read FROM events WHERE event_type = 'view' GROUP BY 1")
def read_counts(spark, d):
    e = _events(spark, d)
    rows = e.select(F.col("event_id").alias("id"), "user_id", F.lit(None).cast("timestamp").alias("read_at"))
    marked = V.mark_read(rows, e.where("event_type = 'view'").select(F.col("event_id").alias("id")), NOW)
    return marked.where("read_at is not null").groupBy("user_id").agg(F.count("*").alias("read"))


