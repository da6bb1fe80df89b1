"""State, messages and reports as queries over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import url as U
from tidemark.operators import enrich as E
from tidemark.operators import settings as O
from tidemark.operators import sources as S
from tidemark.operators import views as V
from tidemark.operators.commit import commit
from tidemark.plans.catalog import NOW, _candidates, _events, _marked_sources, _ntz, _query, _shaped, _t
from tidemark.schemas import ARTICLES, CHATS, SOURCES
from tidemark.sources.fetch import with_fallback
from tidemark.sources.listing import as_feed_items
from tidemark.sources.store import Store, get, shared_root


def _articles(events: DataFrame) -> DataFrame:
    """Events as articles: the type is the source, the id the key."""
    return _shaped(events.select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("source_id"), F.col("ts").alias("published_at"), F.col("props").alias("title"), _status().alias("status")), ARTICLES)


def _status() -> Column:
    return F.expr("CASE event_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'summarizing' WHEN 2 THEN 'done' ELSE 'error' END")


def _nations(spark, d) -> DataFrame:
    """Nations as sources; every third has a listing."""
    n = _t(spark, d, "nation")
    listing = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("https://l.example/"), "n_nationkey"))
    return _shaped(n.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), listing.alias("listing_url"), F.lit("/p/").alias("listing_link_pattern")), SOURCES)


def _as_bigint(*columns: str) -> list[Column]:
    return [F.col(c).cast("long").alias(c) for c in columns]


_TRACE_SQL = (
    "WITH c AS (SELECT c_nationkey AS k, count(*) AS n, max(o_orderdate) AS m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), "
    # the second run sees what is within grace of the newest, which the first has stored
    "w AS (SELECT c_nationkey AS k, count(*) - 1 AS waiting FROM orders JOIN customer ON o_custkey = c_custkey JOIN c ON c.k = c_nationkey WHERE o_orderdate > m - INTERVAL 3 DAYS GROUP BY 1), "
    "s AS (SELECT n_nationkey AS k, n_name AS name, n, m, waiting, n IS NOT NULL AS ran, n_nationkey = 8 AS was_reset, n_nationkey % 5 = 0 AS failed FROM nation LEFT JOIN c ON c.k = n_nationkey LEFT JOIN w ON w.k = n_nationkey) "
    "SELECT CAST(k AS VARCHAR) AS id, name, CASE WHEN k = 2 THEN 'https://moved.example/2' ELSE 'https://f.example/' || k END AS feed_url, CASE WHEN k % 3 = 0 THEN 'https://l.example/' || k END AS listing_url, '/p/' AS listing_link_pattern, "
    "ran AND NOT was_reset AS initialized, CASE WHEN ran AND waiting <= 5 AND NOT was_reset AND k <> 2 THEN 'e' || k END AS etag, CASE WHEN ran AND waiting <= 5 AND NOT was_reset AND k <> 2 THEN 'm' || k END AS last_modified, "
    "CASE WHEN failed THEN TIMESTAMP '2024-02-01 02:00:00' WHEN ran THEN TIMESTAMP '2024-02-01 01:00:00' END AS last_fetched_at, CASE WHEN was_reset THEN NULL WHEN failed THEN 'error' WHEN ran THEN 'ok' END AS last_status, "
    "CASE WHEN failed AND NOT was_reset THEN 'HTTP 500' END AS last_error, CAST(CASE WHEN NOT was_reset THEN n END AS BIGINT) AS last_item_count, CASE WHEN NOT was_reset THEN m END AS latest_published_at, CASE WHEN ran AND NOT was_reset THEN 'feed' END AS last_fetch_mode, "
    "CAST(CASE WHEN ran AND NOT was_reset THEN 1 + least(waiting, 5) ELSE 0 END AS BIGINT) AS articles, k < 10 AS is_enabled, 4::BIGINT AS summary_concurrency, 1000::BIGINT AS max_content_chars, 1::BIGINT AS max_new_per_source_per_run, 900::BIGINT AS interval_seconds, "
    "(SELECT count(*) FROM nation) AS after_reset, 0::BIGINT AS articles_after_reset, 4::BIGINT AS concurrency_after_reset FROM s"
)


@_query(_TRACE_SQL)
def state_trace(spark, d):
    """Nations as sources through a script over a store: seed, two runs with validators, failures, settings, a source reset, an address that moves; then all is reset.

    A row a source has all its state after the script, its articles, the settings, and what a full reset leaves.
    """
    store = Store(spark, f"{shared_root(spark)}/trace-{uuid.uuid4().hex}")
    seed = _nations(spark, d).withColumn("feed_url", F.concat(F.lit("https://f.example/"), "id"))
    store.write(sources=S.upsert_sources(seed, spark.createDataFrame([], SOURCES)))
    orders = _t(spark, d, "orders").join(_t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("string").alias("source_id")), "o_custkey")
    found = orders.select(
        "source_id", F.col("o_orderkey").cast("int").alias("pos"), F.col("o_orderkey").cast("string").alias("id"), F.lit("l").alias("link"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("guid"),
        F.col("o_orderdate").cast("timestamp").alias("published_at"), F.lit(None).cast("string").alias("content_html"),
    ).persist()
    for hour in (0, 1):
        before = store.read("sources")
        done = commit(found, before, store.lookup("articles", found.select("id")), NOW + timedelta(hours=hour), limit=5)
        fetches = seed.select(F.col("id").alias("source_id"), F.concat(F.lit("e"), "id").alias("etag"), F.concat(F.lit("m"), "id").alias("last_modified"))
        store.write(append={"articles": done.articles}, sources=S.save_validators(done.sources, fetches, done.metrics))
        done.release()
    found.unpersist()
    failures = seed.where("int(id) % 5 = 0").select(F.col("id").alias("source_id"), F.lit("HTTP 500").alias("error"))
    store.write(sources=S.record_failures(store.read("sources"), failures, NOW + timedelta(hours=2)))
    ids = [r["id"] for r in seed.where("int(id) < 10").select("id").collect()]
    O.save_settings(store, {"enabled_sources": ids, "summary_concurrency": 9, "max_content_chars": 0})
    settings = O.save_settings(store, {"max_new_per_source_per_run": 0.5, "interval_minutes": 1})
    sources, articles, chats, _ = S.reset_source("8", store.read("sources"), store.read("articles"), store.read("chats"))
    store.write(sources=sources, articles=articles, chats=chats)
    moved = spark.createDataFrame([("2", "https://moved.example/2")], "id string, feed_url string")
    store.write(sources=S.upsert_sources(seed, store.read("sources"), moved))
    state, stored = store.read("sources"), store.read("articles").groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("articles"))
    sources, articles, chats = S.reset_all(seed, state, store.read("articles"), store.read("chats"))
    empty = Store(spark, f"{store.root}-reset")
    empty.write(sources=sources, articles=articles, chats=chats)
    O.save_settings(empty, {"summary_concurrency": settings.summary_concurrency})
    enabled = S.enabled(state, spark.createDataFrame([(i,) for i in settings.enabled_sources], "id string")).select("id", F.lit(True).alias("is_enabled"))
    rows = state.join(stored, "id", "left").join(enabled, "id", "left")
    told = {"summary_concurrency": settings.summary_concurrency, "max_content_chars": settings.max_content_chars, "max_new_per_source_per_run": settings.max_new_per_source_per_run, "interval_seconds": O.trigger_seconds(settings)}
    told |= {"after_reset": empty.read("sources").count(), "articles_after_reset": empty.read("articles").count(), "concurrency_after_reset": O.load_settings(empty).summary_concurrency}
    got = rows.select(
        "id", "name", "feed_url", "listing_url", "listing_link_pattern", "initialized", "etag", "last_modified", "last_fetched_at", "last_status", "last_error", *_as_bigint("last_item_count"), "latest_published_at",
        "last_fetch_mode", F.coalesce("articles", F.lit(0).cast("long")).alias("articles"), F.coalesce("is_enabled", F.lit(False)).alias("is_enabled"), *(F.lit(v).cast("long").alias(k) for k, v in told.items()),
    )
    return _ntz(_ntz(got, "last_fetched_at"), "latest_published_at")


@_query(
    "SELECT CAST(s_suppkey AS VARCHAR) AS source_id, CASE s_suppkey % 5 WHEN 0 THEN 'feed' WHEN 1 THEN 'not_modified' WHEN 2 THEN 'listing' END AS mode, "
    "CASE s_suppkey % 5 WHEN 3 THEN 'HTTP 500; timed out' WHEN 4 THEN 'timed out' END AS error FROM supplier"
)
def fallback_modes(spark, d):
    """Suppliers as feeds that are read, unchanged, or failed: with a listing that is read, one that fails too, or none."""
    rest = F.col("s_suppkey") % 5
    none = F.lit(None).cast("string")
    shape = lambda status, error: [F.col("s_suppkey").cast("string").alias("source_id"), F.lit("u").alias("url"), status.cast("int").alias("status"), *(none.alias(c) for c in ("content_type", "etag", "last_modified", "body")), error.alias("error")]
    suppliers = _t(spark, d, "supplier")
    feeds = suppliers.select(*shape(F.when(rest == 1, 304).when(rest.isin(0, 2), F.when(rest == 0, 200).otherwise(404)).when(rest == 3, 500), F.when(rest == 2, "HTTP 404").when(rest == 3, "HTTP 500").when(rest == 4, "timed out")))
    listings = suppliers.where(rest.isin(2, 3)).select(*shape(F.when(rest == 2, 200), F.when(rest == 3, "timed out")))
    return with_fallback(feeds, listings)


@_query(
    "SELECT CAST(s_nationkey AS VARCHAR) AS source_id, count(*) AS items, count(*) FILTER (s_suppkey % 2 = 0) AS dated, 'Post ' || min(s_suppkey) AS first_title, 'https://l.example/p/' || min(s_suppkey) AS first_link, "
    "'Post ' || coalesce(min(s_suppkey) FILTER (s_suppkey % 2 = 0), min(s_suppkey)) AS newest_title FROM supplier GROUP BY 1"
)
def listing_report(spark, d):
    """Suppliers as links of the listing of their nation, every other one dated, the first of those newest: the listing's test, by way of feed items."""
    s = _t(spark, d, "supplier")
    day = F.when(F.col("s_suppkey") % 2 == 0, F.expr("timestamp '2024-01-01' - make_dt_interval(cast(s_suppkey as int))"))
    links = s.select(F.col("s_nationkey").cast("string").alias("page"), F.col("s_suppkey").cast("int").alias("pos"), F.concat(F.lit("https://l.example/p/"), "s_suppkey").alias("url"), F.concat(F.lit("Post "), "s_suppkey").alias("title"), day.alias("published_at"))
    items = as_feed_items(links)
    first = items.groupBy("source_id").agg(F.min_by("link", "pos").alias("first_link"))
    tests = V.feed_tests(items.withColumns({"format": F.lit("listing"), "error": F.lit(None).cast("string")}))
    return tests.join(first, "source_id").select("source_id", "items", "dated", F.col("first.title").alias("first_title"), "first_link", F.col("newest.title").alias("newest_title"))


@_query("SELECT CAST(s_suppkey AS VARCHAR) AS name FROM supplier WHERE s_suppkey % 8 = 0")
def rescued_names(spark, d):
    """Every failed primary that a listing rescues, a row each; ``health_summary`` names the first of them."""
    s = _t(spark, d, "supplier")
    tests = s.select(F.col("s_suppkey").cast("string").alias("name"), F.lit(True).alias("is_primary"), (F.col("s_suppkey") % 4 != 0).alias("ok"))
    return V.rescued_names(tests, s.where("s_suppkey % 8 = 0 or s_suppkey % 4 <> 0").select(F.col("s_suppkey").cast("string").alias("name")))


@_query(
    "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_nationkey % 2 = 0 AS is_seeded, CASE WHEN n_nationkey % 3 = 0 THEN TIMESTAMP '2024-01-01' END AS latest_published_at FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey % 3 = 0"
)
def seed_and_stored(spark, d):
    """Sources that are seeded, stored, or both: what is stored stays where the seed knows nothing of it."""
    all_of = _nations(spark, d)
    stored = all_of.where("int(id) % 3 = 0").withColumns({"latest_published_at": F.lit("2024-01-01").cast("timestamp"), "feed_url": F.lit("u"), "name": F.lit("stored")})
    seed = all_of.where("int(id) % 2 = 0").withColumn("feed_url", F.lit("u"))
    got = S.upsert_sources(seed, stored)
    return _ntz(got.select("id", (F.col("name") != "stored").alias("is_seeded"), "latest_published_at"), "latest_published_at")


@_query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def format_dates(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", X.format_date(F.col("o_orderdate").cast("timestamp")).alias("day"))


@_query("SELECT CASE event_id % 4 WHEN 2 THEN '' WHEN 3 THEN 'error' ELSE 'summarizing' END AS label, count(*) AS n FROM events GROUP BY 1")
def status_labels(spark, d):
    return _events(spark, d).select(V.status_label(_status()).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@_query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey < 3)")
def enabled_sources(spark, d):
    ids = _t(spark, d, "nation").join(_t(spark, d, "region").where("r_regionkey < 3"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("string").alias("id"))
    return S.enabled(_nations(spark, d), ids).select("id", "name")


@_query("SELECT CAST(c_custkey AS VARCHAR) AS id, event_type AS source_id FROM customer LEFT JOIN events ON event_id = c_custkey")
def multi_get(spark, d):
    ids = _t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    return get(_articles(_events(spark, d)).select("id", "source_id"), ids)


@_query("SELECT count(*) AS deleted, (SELECT count(*) FROM events WHERE event_type IS DISTINCT FROM 'click') AS left_over, (SELECT count(*) FROM conversations WHERE conv_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')) AS messages FROM events WHERE event_type = 'click'")
def source_reset(spark, d):
    """One source reset: its articles and their chats go; a row of counts."""
    turns = _t(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("article_id"), F.col("turn").alias("pos"), "role", F.col("text").alias("content"), F.lit(False).alias("refused"))
    chats = V.append_messages(spark.createDataFrame([], CHATS), turns, NOW)
    _, articles, left, deleted = S.reset_source("click", _shaped(_marked_sources(_events(spark, d)), SOURCES), _articles(_events(spark, d)), chats)
    none = F.lit(0).cast("long")
    parts = deleted.select("deleted", none.alias("left_over"), none.alias("messages"))
    parts = parts.unionByName(articles.agg(F.count("*").alias("left_over")).select(none.alias("deleted"), "left_over", none.alias("messages")))
    parts = parts.unionByName(left.agg(F.sum(F.size("messages")).cast("long").alias("messages")).select(none.alias("deleted"), none.alias("left_over"), "messages"))
    return parts.agg(*(F.sum(c).alias(c) for c in ("deleted", "left_over", "messages")))


@_query(
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'APIキーが無効です' WHEN 1 THEN 'レート制限中です' WHEN 2 THEN 'APIエラー (' || CAST(400 + event_id % 3 AS VARCHAR) || '): Credit balance is low' WHEN 3 THEN 'boom' ELSE '' END AS told, "
    "CASE WHEN event_id % 5 = 2 THEN event_id % 3 IN (0, 1) ELSE false END AS stops FROM events"
)
def error_messages(spark, d):
    kind = F.expr("CASE event_id % 5 WHEN 0 THEN 'auth' WHEN 1 THEN 'rate_limit' END")
    status = F.when(F.col("event_id") % 5 == 2, 400 + F.col("event_id") % 3)
    message = F.expr("CASE event_id % 5 WHEN 2 THEN 'Credit balance is low' WHEN 3 THEN 'boom' END")
    return _events(spark, d).select("event_id", X.error_message(kind, status, message).alias("told"), X.is_billing_or_auth(status, message).alias("stops"))


@_query(
    "SELECT o_orderkey, 'タイトル: ' || o_orderpriority || chr(10) || 'ソース名: ' || o_orderstatus || chr(10) || 'URL: https://o.example/' || o_orderkey || chr(10) || '公開日: ' || strftime(o_orderdate, '%Y-%m-%d') || chr(10) || '本文の取得元: ページ本文' || chr(10) || chr(10) || '<article>' || chr(10) "
    "|| CASE WHEN len(o_orderpriority) > 6 THEN o_orderpriority[1:6] || '（以下省略）' ELSE o_orderpriority END || chr(10) || '</article>' AS prompt FROM orders"
)
def summary_prompts(spark, d):
    url = F.concat(F.lit("https://o.example/"), "o_orderkey")
    prompt = X.build_summary_user(F.col("o_orderpriority"), F.col("o_orderstatus"), url, F.col("o_orderdate").cast("timestamp"), F.col("o_orderpriority"), F.lit("page"), 6)
    return _t(spark, d, "orders").select("o_orderkey", prompt.alias("prompt"))


@_query("SELECT s_nationkey AS source_id, 'https://a.example/' || min(s_suppkey) AS url FROM supplier WHERE s_acctbal > 0 GROUP BY 1")
def working_alternates(spark, d):
    tests = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("source_id"), F.col("s_suppkey").alias("pos"), F.concat(F.lit("https://a.example/"), "s_suppkey").alias("url"), (F.col("s_acctbal") > 0).alias("ok"))
    return S.first_working_alternate(tests)


@_query(
    "WITH e AS (SELECT event_type, event_id, CASE WHEN event_id % 2 = 0 THEN ts END AS dated, event_id % 3 = 0 AS stored FROM events), m AS (SELECT event_type, CASE WHEN event_type < 'm' THEN TIMESTAMP '2024-01-20' END AS mark FROM e GROUP BY 1), "
    "f AS (SELECT e.*, mark FROM e JOIN m USING (event_type)), fresh AS (SELECT * FROM f WHERE dated IS NOT NULL AND (mark IS NULL OR dated > mark - INTERVAL 3 DAYS)), "
    "old AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY dated, event_id) AS r FROM fresh WHERE mark IS NOT NULL AND NOT stored), "
    "new AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY dated DESC, event_id) AS r FROM fresh WHERE mark IS NULL), "
    "un AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM f WHERE dated IS NULL), "
    "t AS (SELECT event_type, event_id, false AS undated FROM old WHERE r <= 20 UNION ALL SELECT event_type, event_id, false FROM new WHERE r = 1 AND NOT stored "
    "UNION ALL SELECT event_type, event_id, true FROM un WHERE r = 1 AND NOT stored AND (mark IS NOT NULL OR event_type NOT IN (SELECT event_type FROM new))) "
    "SELECT event_type AS source_id, CAST(event_id AS VARCHAR) AS id, undated FROM t"
)
def undated_listing(spark, d):
    """Events as listing links, every other one without a date: of those the first of a page is taken, if it is not stored."""
    events = _events(spark, d)
    links = _candidates(events).withColumn("published_at", F.when(F.col("pos") % 2 == 0, F.col("published_at")))
    stored = events.where("event_id % 3 = 0").select(F.col("event_id").cast("string").alias("id"))
    base = _shaped(_marked_sources(events), SOURCES)
    done = commit(links, base, stored, NOW, limit=20, modes=base.select(F.col("id").alias("source_id"), F.lit("listing").alias("mode")))
    return done.articles.select("source_id", "id", F.col("published_at_provisional").alias("undated"))


@_query(
    "WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '/+$', '') AS path, page_id % 2 = 0 AS one FROM pages) "
    "SELECT page_id, path <> '' AND NOT regexp_matches(regexp_extract(path, '[^/]*$'), '[-0-9]') AND one AS category, path = '' AS root FROM p"
)
def word_categories(spark, d):
    """Links whose last part and title are one word, and links to the root, which is above every listing of a site."""
    title = F.when(F.col("page_id") % 2 == 0, "Engineering").otherwise("Two words")
    listing = F.concat(U.origin(F.col("url")), F.lit("/blog/all"))
    above = U.is_listing_or_above(F.col("url"), listing)
    return _t(spark, d, "pages").select("page_id", U.is_word_category(F.col("url"), title).alias("category"), above.alias("root"))


@_query("SELECT count(*) AS orphans FROM events WHERE event_id % 4 = 0 OR event_id % 4 = 1 AND ts <= TIMESTAMP '2024-01-20 11:45:00'")
def orphan_counts(spark, d):
    rows = _events(spark, d).select(_status().alias("status"), F.col("ts").alias("summarizing_at"))
    return E.orphan_count(rows, datetime(2024, 1, 20, 12))


@_query("SELECT event_id AS id, coalesce(n, 0) AS messages FROM events LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) ON conv_id = event_id")
def article_threads(spark, d):
    turns = _t(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("article_id"), F.col("turn").alias("pos"), "role", F.col("text").alias("content"), F.lit(False).alias("refused"))
    both = V.with_chat(_articles(_events(spark, d)), V.append_messages(spark.createDataFrame([], CHATS), turns, NOW))
    return both.select(F.col("id").cast("long").alias("id"), F.coalesce(F.size("messages"), F.lit(0)).cast("long").alias("messages"))


@_query("SELECT n_name AS name, 'https://l.example/' || n_nationkey AS listing_url FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 4 <> 0)")
def failed_primaries(spark, d):
    names = _t(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("name"))
    tests = _t(spark, d, "supplier").join(names, "s_nationkey").select("name", F.lit(True).alias("is_primary"), (F.col("s_suppkey") % 4 == 0).alias("ok"))
    return V.failed_primaries(tests, _nations(spark, d)).select("name", "listing_url")


@_query("SELECT max(len(p_name)) AS name, max(least(60, len(p_type || p_name || p_type))) AS told FROM part")
def column_widths(spark, d):
    cells = V.report_cells(_t(spark, d, "part").select(F.col("p_name").alias("name"), F.concat("p_type", "p_name", "p_type").alias("told")))
    return V.column_widths(cells).select(*(F.col(c).cast("long").alias(c) for c in ("name", "told")))


@_query("SELECT CAST(event_id AS VARCHAR) AS id FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, CAST(event_id AS VARCHAR)) AS r FROM events) WHERE r > 30")
def queue_remainder(spark, d):
    """What is carried over of the queue after the newest 30."""
    queue = _events(spark, d).select(F.col("event_id").cast("string").alias("id"), F.col("ts").alias("published_at"))
    return E.choose(queue, 30)[1].select("id")


@_query(
    "SELECT (SELECT CAST(sum(CASE WHEN c > 20 THEN 20 ELSE c END) AS BIGINT) FROM (SELECT count(*) AS c FROM events GROUP BY event_type)) AS new, count(*) FILTER (event_type = 'purchase') AS done, "
    "count(*) FILTER (event_type = 'click') AS failed, true AS notify FROM events"
)
def run_report(spark, d):
    """One row on a run over all events: what was added at a cap of 20 a source, and how the batch ended."""
    events = _events(spark, d)
    added = events.groupBy(F.col("event_type").alias("source_id")).agg(F.least(F.lit(20), F.count("*")).cast("int").alias("added"))
    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "click", "error").otherwise("new")
    rows = events.select(F.col("event_id").alias("id"), status.alias("status"))
    return V.run_summary(added, V.batch_counts(rows, rows.select("id")))


@_query("SELECT event_id, ts AS published_at FROM events WHERE event_type = 'view'")
def view_order(spark, d):
    """The newest first; SQL has the rows, tests their order."""
    cards = V.article_list(_articles(_events(spark, d)), _nations(spark, d), source_ids=["view"])
    return _ntz(cards.select(F.col("id").cast("long").alias("event_id"), "published_at"), "published_at")
