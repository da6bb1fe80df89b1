"""Admission scenarios, the store, runs in sequence, enrichment, views and streams."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import enrich as E
from tidemark.operators import sources as S
from tidemark.operators import views as V
from tidemark.operators.candidates import to_candidates
from tidemark.operators.commit import commit
from tidemark.operators.run import claim, finish, refresh, resummarize, summarize
from tidemark.sources.store import Fenced, Store, append_new, get, merge
from tidemark.operators import settings as O
from tidemark.sources.seed import seed_sources, targets
from tidemark.streaming.ingest import admit_stream, ingest_stream
from tidemark.streaming.live import live

DAY = timedelta(days=1)
BASE = datetime(2026, 9, 1)


def sources(spark, *rows):
    """rows: (id, initialized, latest_published_at)."""
    empty = spark.createDataFrame([], schemas.SOURCES)
    given = spark.createDataFrame(list(rows), "id string, initialized boolean, latest_published_at timestamp")
    return given.select(*(F.col(f.name) if f.name in given.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema.fields))


def articles(spark, *rows):
    """rows: dicts of columns."""
    empty = spark.createDataFrame([], schemas.ARTICLES)
    return spark.createDataFrame([tuple(r.get(f.name) for f in empty.schema.fields) for r in rows], empty.schema)


def candidates(spark, *rows):
    """rows: (id, days or None) of source s in document order, or (source, id, days)."""
    full = [(("s", *r) if len(r) == 2 else r) for r in rows]
    data = [(s, i, k, f"https://x.example/{k}", k, None, None if d is None else BASE + d * DAY, None) for i, (s, k, d) in enumerate(full)]
    return spark.createDataFrame(data, schemas.CANDIDATES)


def run(spark, cands, state=("s", True, BASE), stored=(), *, limit=20, mode="feed", now=datetime(2026, 10, 1)):
    modes = spark.createDataFrame([("s", mode)], "source_id string, mode string")
    done = commit(cands, sources(spark, state), articles(spark, *({"id": i} for i in stored)), now, limit=limit, modes=modes)
    m = done.metrics.first()
    return sorted(r["id"] for r in done.articles.collect()), m["added"], m["carried_over"], m["latest_published_at"]


COLD, EMPTY_MARK = ("s", False, None), ("s", True, None)
SCENARIOS = {
    "cold start takes the newest of three": ([("a", 1), ("b", 3), ("c", 2)], {"state": COLD}, (["b"], 1, 0, BASE + 3 * DAY)),
    "initialized without a mark is cold": ([("a", 1), ("b", 3)], {"state": EMPTY_MARK}, (["b"], 1, 0, BASE + 3 * DAY)),
    "ties go to the first": ([("a", 3), ("b", 3)], {"state": COLD}, (["a"], 1, 0, BASE + 3 * DAY)),
    "cold with the newest stored moves the mark only": ([("a", 1), ("b", 3)], {"state": COLD, "stored": ["b"]}, ([], 0, 0, BASE + 3 * DAY)),
    "the threshold is strict": ([("a", -3), ("b", -2.9), ("c", 1)], {}, (["b", "c"], 2, 0, BASE + DAY)),
    "late items within grace leave the mark": ([("a", -1)], {}, (["a"], 1, 0, BASE)),
    "stored ones are skipped but count": ([("a", 1), ("b", 5)], {"stored": ["b"]}, (["a"], 1, 0, BASE + 5 * DAY)),
    "feeds drop unknown dates": ([("a", None), ("b", 1)], {}, (["b"], 1, 0, BASE + DAY)),
    "cap: oldest first": ([("e", 5), ("a", 1), ("d", 4), ("b", 2), ("c", 3)], {"limit": 3}, (["a", "b", "c"], 3, 2, BASE + 3 * DAY)),
    "stored rows take no place": ([("a", 1), ("b", 2), ("c", 3)], {"limit": 1, "stored": ["a"]}, (["b"], 1, 1, BASE + 2 * DAY)),
    "a stored newer row does not pass carried ones": ([("a", 1), ("b", 2), ("z", 9)], {"limit": 1, "stored": ["z"]}, (["a"], 1, 1, BASE + DAY)),
    "limit 0 carries all": ([("a", 1)], {"limit": 0}, ([], 0, 1, BASE)),
    "first wins": ([("a", 1), ("a", 5)], {}, (["a"], 1, 0, BASE + DAY)),
    "listing: first unknown only": ([("u", None), ("v", None), ("a", 1)], {"mode": "listing"}, (["a", "u"], 2, 0, BASE + DAY)),
    "listing: a stored first unknown does not fall through": ([("u", None), ("v", None)], {"mode": "listing", "stored": ["u"]}, ([], 0, 0, BASE)),
    "listing cold: known beats unknown": ([("u", None), ("a", 1)], {"mode": "listing", "state": COLD}, (["a"], 1, 0, BASE + DAY)),
    "listing cold: unknown alone": ([("u", None), ("v", None)], {"mode": "listing", "state": COLD}, (["u"], 1, 0, None)),
    "nothing at all": ([("a", -9)], {}, ([], 0, 0, BASE)),
}


@pytest.mark.parametrize("name", SCENARIOS)
def test_commit(spark, name):
    rows, options, want = SCENARIOS[name]
    assert run(spark, candidates(spark, *rows), **options) == want


def test_commit_rows_and_state(spark):
    now = datetime(2026, 10, 1)
    cands = candidates(spark, ("a", 1), ("u", None)).withColumn("content_html", F.lit("<p>x &amp; y</p>"))
    modes = spark.createDataFrame([("s", "listing"), ("quiet", "feed")], "source_id string, mode string")
    done = commit(cands, sources(spark, ("s", True, BASE), ("quiet", False, None), ("off", True, BASE)), articles(spark), now, modes=modes)
    rows = {r["id"]: r for r in done.articles.collect()}
    assert rows["a"]["rss_summary"] == "x & y" and rows["a"]["status"] == "new" and not rows["a"]["published_at_provisional"]
    assert rows["u"]["published_at"] == rows["u"]["created_at"] == now and rows["u"]["published_at_provisional"]
    assert done.articles.schema.simpleString() == spark.createDataFrame([], schemas.ARTICLES).schema.simpleString()
    state = {r["id"]: r for r in done.sources.collect()}
    assert state["s"]["last_item_count"] == 2 and state["s"]["last_fetch_mode"] == "listing" and state["s"]["last_fetched_at"] == now
    assert state["quiet"]["initialized"] and state["quiet"]["last_item_count"] == 0 and state["off"]["last_fetched_at"] is None


def test_commit_of_nothing(spark):
    done = commit(candidates(spark, ("a", 1)).limit(0), sources(spark, ("s", True, BASE)), articles(spark), BASE)
    assert done.articles.count() == 0 and done.metrics.count() == 0 and done.sources.count() == 1


def test_runs_in_sequence(spark):
    """Capped runs admit everything in order, marks only rise, and a rerun changes nothing."""
    cands = candidates(spark, *((f"k{i:02d}", i) for i in range(7)))
    state, stored, marks, seen = sources(spark, ("s", True, BASE)), articles(spark), [], []
    for _ in range(5):
        done = commit(cands, state, stored, BASE, limit=3)
        new = [r["id"] for r in done.articles.orderBy("id").collect()]
        seen.append(new)
        stored = articles(spark, *({"id": r["id"]} for r in stored.select("id").collect()), *({"id": i} for i in new))
        (row,) = done.sources.collect()
        marks.append(row["latest_published_at"])
        state = sources(spark, ("s", True, row["latest_published_at"]))
    assert seen == [["k00", "k01", "k02"], ["k03", "k04", "k05"], ["k06"], [], []]
    assert marks == sorted(marks)


def test_candidates(spark):
    items = spark.createDataFrame(
        [("s", 0, "A", "https://a.example/1/?ref=x", ["Engineering", "Backend"]), ("s", 1, "B", "https://a.example/2", ["Marketing"]), ("s", 2, "C", "https://a.example/3", []), ("t", 0, "D", "", ["x"]), ("gone", 0, "E", "l", ["x"])],
        "source_id string, pos int, title string, link string, categories array<string>",
    ).selectExpr("*", "null guid", "cast(null as timestamp) published_at", "'' content_html")
    state = sources(spark, ("s", True, BASE), ("t", True, BASE)).withColumn("category_filter", F.expr("if(id = 's', array('ENGINEERING'), null)"))
    got = to_candidates(items, state).orderBy("pos").collect()
    assert [r["title"] for r in got] == ["A", "C"] and got[0]["link"].endswith("?ref=x") and len(got[0]["id"]) == 64


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.read("articles").count() == 0
    store.write("1", articles=articles(spark, {"id": "a", "title": "x"}), sources=sources(spark, ("s", True, BASE)))
    store.write("1", articles=articles(spark))
    old = store.read("articles")
    assert [r["id"] for r in old.collect()] == ["a"]
    both = merge(append_new(old, articles(spark, {"id": "a", "title": "no"}, {"id": "b"})), articles(spark, {"id": "b", "title": "new"}))
    store.write("2", articles=both)
    assert {r["id"]: r["title"] for r in store.read("articles").collect()} == {"a": "x", "b": "new"}
    store.vacuum()
    assert len(list((tmp_path / "store" / "articles").iterdir())) == 2  # a write that is under way may still list a young folder
    store.vacuum(timedelta())
    assert store.read("articles").count() == 2 and len(list((tmp_path / "store" / "articles").iterdir())) == 1
    assert [r["title"] for r in get(store.read("articles"), spark.createDataFrame([("b",), ("z",)], "id string")).orderBy("id").collect()] == ["new", None]


def test_settings_and_lock(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert O.load_settings(store) == O.Settings() and len(O.Settings().enabled_sources) == 15
    saved = O.save_settings(store, {"summary_concurrency": 9, "max_content_chars": 0, "max_new_per_source_per_run": float("nan"), "unknown": 1})
    assert (saved.summary_concurrency, saved.max_content_chars, saved.max_new_per_source_per_run) == (4, 1000, 1)
    assert O.save_settings(store, {"interval_minutes": 5}).summary_concurrency == 4
    assert O.trigger_seconds(O.load_settings(store)) == 900 and O.trigger_seconds(O.Settings(interval_minutes=0)) is None
    first = O.acquire(store, BASE)
    assert first and not O.acquire(store, BASE + timedelta(minutes=19)) and O.release(store, first)
    second = O.acquire(store, BASE)
    third = O.acquire(store, BASE + timedelta(minutes=20))
    assert first < second < third and not O.release(store, third)


def test_two_at_a_stale_lock(spark, tmp_path, monkeypatch):
    """Both see it stale; one gets the next number."""
    store = Store(spark, str(tmp_path / "store"))
    O.acquire(store, BASE)
    seen = O._holder(store, BASE + timedelta(minutes=30))
    monkeypatch.setattr(O, "_holder", lambda *_: seen)
    later = BASE + timedelta(minutes=30)
    assert sorted([O.acquire(store, later), O.acquire(store, later)], key=str) == [2, None]
    monkeypatch.undo()
    assert O.is_locked(store, later) and not O.is_locked(store, later + timedelta(minutes=20))


def test_an_empty_lock_is_stale_by_its_file(spark, tmp_path):
    """A writer that died after it made the file: the lock is held for 20 minutes from then, not for ever."""
    import os
    import time

    store = Store(spark, str(tmp_path / "store"))
    store.create("_lock/000000000001", "")
    assert O.acquire(store, datetime(2034, 1, 1)) is None
    old = time.time() - 60 * 20
    os.utime(tmp_path / "store" / "_lock" / "000000000001", (old, old))
    assert O.acquire(store, datetime(2034, 1, 1)) == 2


def test_a_late_holder_changes_nothing(spark, tmp_path):
    """What was thought dead neither writes nor gives back the lock of the one after it."""
    store = Store(spark, str(tmp_path / "store"))
    store.write(articles=articles(spark, {"id": "a", "title": "x"}))
    one = O.acquire(store, BASE)
    late = store.fenced(one)
    late.write("1", append={"articles": articles(spark, {"id": "b"})})
    two = O.acquire(store, BASE + timedelta(minutes=21))
    for attempt in (lambda: late.write("2", append={"articles": articles(spark, {"id": "c"})}), lambda: late.compact("articles"), late.raise_fence):
        with pytest.raises(Fenced):
            attempt()
    assert not O.release(store, one) and O.is_locked(store, BASE + timedelta(minutes=22))
    store.fenced(two).write("3", append={"articles": articles(spark, {"id": "d"})})
    assert sorted(r["id"] for r in store.read("articles").collect()) == ["a", "b", "d"]
    assert not O.release(store, two) and not O.is_locked(store, BASE + timedelta(minutes=22))
    O.acquire(store, BASE + timedelta(minutes=23))
    assert O.acquire(store, BASE + timedelta(minutes=24)) is None and O.release(store, 3)  # a request came meanwhile


def test_many_locks_leave_few_files(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for i in range(9):
        O.release(store, O.acquire(store, BASE + i * DAY))
    assert len(store.numbers("_lock")) <= 5 and len(store.numbers("_released")) <= 5


def test_seed(spark):
    seed = seed_sources(spark)
    assert seed.count() == 15 and seed.where("listing_link_pattern is not null").count() == 2
    assert targets(seed).count() == 15 and targets(seed, alternates=True).where("source_id = 'uber'").count() == 5
    page = "https://www.uber.com/us/en/blog/"
    row = seed.where("id = 'uber'").first()
    keys = spark.createDataFrame([(page + "a-post",), (page + "engineering",), (page + "a/b",)], "k string")
    kept = keys.where(F.col("k").rlike(row["listing_link_pattern"]) & ~F.col("k").rlike(row["listing_exclude_pattern"]))
    assert [r["k"] for r in kept.collect()] == [page + "a-post"]


def test_source_mutations(spark):
    seed = sources(spark, ("a", None, None), ("b", None, None)).withColumn("feed_url", F.concat(F.lit("u-"), "id"))
    stored = sources(spark, ("a", True, BASE), ("z", True, BASE)).withColumns({"feed_url": F.lit("u-a"), "etag": F.lit("e")})
    got = {r["id"]: r for r in S.upsert_sources(seed, stored).collect()}
    assert got["a"]["etag"] == "e" and got["a"]["initialized"] and not got["b"]["initialized"] and got["z"]["latest_published_at"] == BASE
    moved = {r["id"]: r for r in S.upsert_sources(seed, stored, spark.createDataFrame([("a", "other")], "id string, feed_url string")).collect()}
    assert moved["a"]["feed_url"] == "other" and moved["a"]["etag"] is None and moved["a"]["latest_published_at"] == BASE
    assert S.enabled(seed, spark.createDataFrame([("b",)], "id string")).count() == 1
    arts = articles(spark, {"id": "1", "source_id": "a"}, {"id": "2", "source_id": "z"})
    chats = spark.createDataFrame([("1", [], BASE), ("2", [], BASE)], schemas.CHATS)
    state, left, talk, n = S.reset_source("a", stored.withColumn("last_fetched_at", F.lit(BASE)), arts, chats)
    a = state.where("id = 'a'").first()
    assert (a["latest_published_at"], a["etag"], a["initialized"], a["last_fetched_at"]) == (None, None, False, BASE)
    assert [left.first()["id"], talk.first()["article_id"], n.first()["deleted"]] == ["2", "2", 1]
    with pytest.raises(RuntimeError):
        S.reset_source("a", stored, arts, chats, running=True)
    assert [x.count() for x in S.reset_all(seed, stored, arts, chats)] == [2, 0, 0]
    tests = spark.createDataFrame([("a", 0, "x", False), ("a", 1, "y", True), ("a", 2, "z", True)], "source_id string, pos int, url string, ok boolean")
    assert S.first_working_alternate(tests).first()["url"] == "y"


def test_queue(spark):
    now = datetime(2026, 9, 1, 12)
    rows = articles(
        spark,
        {"id": "a", "status": "new", "published_at": BASE},
        {"id": "b", "status": "summarizing", "summarizing_at": now - timedelta(minutes=15), "published_at": BASE + DAY},
        {"id": "c", "status": "summarizing", "summarizing_at": now - timedelta(minutes=14), "published_at": BASE},
        {"id": "d", "status": "summarizing"},
        {"id": "e", "status": "error"},
    )
    assert {r["id"]: r["status"] for r in E.recover(rows, now).collect()} == {"a": "new", "b": "new", "c": "summarizing", "d": "new", "e": "error"}
    top, rest = E.choose(rows.where(E.is_orphan(now)), 2)
    assert [r["id"] for r in top.collect()] == ["b", "a"] and [r["id"] for r in rest.collect()] == ["d"]
    assert E.choose(rows, -1)[0].count() == 0
    assert E.lock_is_active(True, now - timedelta(minutes=19), now) and not E.lock_is_active(True, now - timedelta(minutes=20), now) and not E.lock_is_active(True, None, now)


def test_enrich(spark, now):
    class Refused(Exception):
        kind, status = "auth", 401

    good = '{"headline":"h","brief":"b","digest":[],"detail":"d","tags":["t","t"]}'

    def model(row):
        if row["title"] == "bad":
            return "no json"
        if row["title"] == "auth":
            raise Refused("nope")
        return good

    base = {"source_id": "s", "status": "summarizing", "attempts": 0, "url": "u"}
    rows = articles(spark, *({**base, "id": t, "title": t, "rss_summary": r} for t, r in (("page", None), ("rss", "r" * 200), ("short", "r"), ("empty", ""), ("bad", "r"), ("auth", "r"))))
    pages = spark.createDataFrame([("page", "p" * 800, None), ("rss", "p" * 799, None)], "id string, text string, published_at timestamp")
    got = {r["id"]: r for r in E.enrich(rows, pages, sources(spark, ("s", True, BASE)), model, now, max_chars=500).collect()}
    assert {k: (r["status"], r["content_source"], r["attempts"]) for k, r in got.items()} == {
        "page": ("done", "page", 0), "rss": ("done", "rss", 0), "short": ("done", "none", 0), "empty": ("error", "none", 1), "bad": ("error", "none", 1), "auth": ("error", "none", 1),
    }
    assert got["page"]["content_chars"] == 500 and got["empty"]["error"] == E.SKIPPED and got["auth"]["stops_batch"] and not got["bad"]["stops_batch"]
    assert E.extractive_stub("t", "One. Two. Three.")["digest"] == ["One", "Two", "Three."]


def test_redate(spark):
    rows = articles(
        spark,
        {"id": "old", "source_id": "s", "published_at": BASE, "published_at_provisional": True},
        {"id": "new", "source_id": "s", "published_at": BASE, "published_at_provisional": True},
        {"id": "sure", "source_id": "s", "published_at": BASE, "published_at_provisional": False},
    )
    pages = spark.createDataFrame([("old", "", BASE - 3 * DAY), ("new", "", BASE + DAY), ("sure", "", BASE - 9 * DAY)], "id string, text string, published_at timestamp")
    kept, after, dropped = E.redate(rows, pages, sources(spark, ("s", True, BASE)), drop_old=True)
    assert {r["id"]: r["published_at"] for r in kept.collect()} == {"new": BASE + DAY, "sure": BASE}
    assert after.first()["latest_published_at"] == BASE + DAY and dropped.first()["id"] == "old"
    kept, _, dropped = E.redate(rows, pages, sources(spark, ("s", True, BASE)), drop_old=False)
    assert kept.where("id = 'old'").first()["published_at"] == BASE - 3 * DAY and dropped.count() == 0


def test_views(spark, now):
    rows = articles(
        spark,
        {"id": "a", "source_id": "s", "title": "A", "status": "done", "published_at": BASE, "summary": ("H", "b", ["x"], "d", ["t", "u", "t"])},
        {"id": "b", "source_id": "gone", "title": "B", "status": "error", "error": "e", "published_at": BASE + DAY, "read_at": BASE},
        {"id": "c", "source_id": "s", "title": "C", "status": "new", "published_at": BASE + DAY},
    )
    names = sources(spark, ("s", True, BASE)).withColumn("name", F.lit("S"))
    cards = V.article_list(rows, names).collect()
    assert [(r["id"], r["headline"], r["source_name"]) for r in cards] == [("b", "B", "gone"), ("c", "C", "S"), ("a", "H", "S")] and cards[2]["tags"] == ["t", "u"]
    assert [r["id"] for r in V.article_list(rows, names, unread_only=True, status="summarizing").collect()] == ["c"]
    assert [r["id"] for r in V.article_list(rows, names, source_ids=["gone"], status="error").collect()] == ["b"]
    status = V.batch_status(rows, spark.createDataFrame([("a",), ("b",), ("z",)], "id string"))
    assert tuple(status.first()) == (1, 1, ["B: e"])
    ids = spark.createDataFrame([("a",), ("b",), ("z",)], "id string")
    assert tuple(V.batch_counts(rows, ids).first()) == (1, 1) and [tuple(r) for r in V.batch_errors(rows, ids).collect()] == [("b", "B: e")]
    metrics = spark.createDataFrame([("s", 2), ("t", 1)], "source_id string, added int")
    assert tuple(V.run_summary(metrics, status).first()) == (3, 1, 1, True)
    chats = V.append_messages(spark.createDataFrame([], schemas.CHATS), spark.createDataFrame([("a", "user", "q", False), ("a", "assistant", "no", True)], "article_id string, role string, content string, refused boolean"), now)
    assert [m["content"] for m in chats.first()["messages"]] == ["q"]
    more = V.append_messages(chats, spark.createDataFrame([("a", "assistant", "r", False)], "article_id string, role string, content string, refused boolean"), now)
    assert [m["content"] for m in more.select(V.history(F.col("messages")).alias("h")).first()["h"]] == ["q", "r"]
    assert V.clear_chats(more, spark.createDataFrame([("a",)], "article_id string")).count() == 0
    read = {r["id"]: r["read_at"] for r in V.mark_read(rows, spark.createDataFrame([("a",), ("b",)], "id string"), now).collect()}
    assert read == {"a": now, "b": BASE, "c": None}


def test_reports(spark):
    items = spark.createDataFrame([("s", 0, "first", None), ("s", 1, "tie", BASE), ("s", 2, "tied", BASE), ("e", None, None, None)], "source_id string, pos int, title string, published_at timestamp").selectExpr("*", "'rss2' format", "cast(null as string) error")
    rows = {r["source_id"]: r for r in V.feed_tests(items).collect()}
    assert rows["s"]["first"]["title"] == "first" and rows["s"]["newest"]["title"] == "tie" and (rows["s"]["items"], rows["s"]["dated"]) == (3, 2)
    assert rows["e"]["items"] == 0 and rows["e"]["newest"] is None
    tests = spark.createDataFrame([("a", True, True), ("b", True, False), ("c", True, False), ("b", False, True)], "name string, is_primary boolean, ok boolean")
    assert tuple(V.health(tests, spark.createDataFrame([("b",), ("b",)], "name string")).first()) == (1, 3, ["b"], 1)
    cells = V.report_cells(spark.createDataFrame([("a \n b", "u" * 80, "w" * 80)], "x string, url string, y string"))
    row = cells.first()
    assert row["x"] == "a b" and len(row["url"]) == 80 and row["y"] == "w" * 59 + "…" and V.column_widths(cells).first()["y"] == 60


def _feed(*days):
    items = "".join(f"<item><link>https://a.example/{d}</link><title>t{d}</title><pubDate>{(BASE + d * DAY).isoformat()}</pubDate></item>" for d in days)
    return f"<rss><channel><title>x</title>{items}</channel></rss>"


def _fetch(spark, *rows):
    """rows: (source, status, etag, body, error)."""
    return spark.createDataFrame([(s, "u", st, None, e, None, b, err) for s, st, e, b, err in rows], schemas.FETCHES)


def test_refresh_and_summarize(spark, tmp_path):
    now = datetime(2026, 10, 1)
    store = Store(spark, str(tmp_path / "store"))
    state = sources(spark, ("a", True, BASE), ("b", True, BASE), ("c", True, BASE), ("d", True, BASE))
    state = state.withColumns({"listing_url": F.expr("if(id in ('b', 'd'), 'https://b.example/blog', null)"), "listing_link_pattern": F.expr("if(id in ('b', 'd'), '/blog/', null)")})
    store.write(sources=state)
    listing = '<a href="/blog/p-1"><h2>P</h2></a>'
    feeds = _fetch(spark, ("a", 200, "e1", _feed(1, 2, 3), None), ("b", None, None, None, "boom"), ("c", 304, None, None, None), ("d", 200, None, "<html>", None))
    listings = _fetch(spark, ("b", 200, None, listing, None), ("d", 500, None, None, "HTTP 500"))
    m = {r["source_id"]: (r["added"], r["carried_over"]) for r in refresh(store, feeds, listings, now, limit=2, batch="1").collect()}
    assert m == {"a": (2, 1), "b": (1, 0)}
    got = {r["id"]: r for r in store.read("sources").collect()}
    assert got["a"]["etag"] is None and got["a"]["latest_published_at"] == BASE + 2 * DAY and got["b"]["last_fetch_mode"] == "listing"
    assert got["c"]["last_fetched_at"] is None and got["d"]["last_error"] == "not-xml; HTTP 500" and got["d"]["last_status"] == "error"
    m = refresh(store, feeds.where("source_id = 'a'"), None, now, limit=2, batch="2").first()
    assert (m["added"], m["carried_over"]) == (1, 0) and store.read("sources").where("id = 'a'").first()["etag"] == "e1"
    assert refresh(store, feeds.where("source_id = 'a'"), None, now, batch="3").first()["added"] == 0 and store.read("articles").count() == 4

    ids = {r["title"]: r["id"] for r in store.read("articles").collect()}
    pages = spark.createDataFrame([(ids["t1"], "x" * 900, None), (ids["P"], "x" * 900, BASE - 30 * DAY)], "id string, text string, published_at timestamp")
    asked = summarize(store, pages, lambda r: '{"headline":"h","brief":"b","digest":[],"detail":"d","tags":[]}', now, batch="4")
    after = {r["title"]: r["status"] for r in store.read("articles").collect()}
    assert after == {"t1": "done", "t2": "error", "t3": "error"} and asked.count() == 3


def test_ingest_stream(spark, tmp_path):
    schema = schemas.FETCHES + ", fetched_at timestamp"
    inbox, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    store.write(sources=sources(spark, ("a", True, BASE)))
    for turn, days in enumerate(((1, 2), (2, 3, -9), (3,))):
        spark.createDataFrame([("a", "u", 200, None, None, None, _feed(*days), None, BASE + (10 + turn) * DAY)], schema).coalesce(1).write.mode("append").parquet(str(inbox))
        stream = spark.readStream.schema(schema).parquet(str(inbox))
        ingest_stream(stream, store, str(tmp_path / "ck")).awaitTermination()
    assert sorted(r["title"] for r in store.read("articles").collect()) == ["t1", "t2", "t3"]
    assert store.read("sources").first()["latest_published_at"] == BASE + 3 * DAY


@pytest.mark.parametrize("at_once", [True, False])
def test_ingest_stream_reads_a_backlog_whole(spark, tmp_path, at_once):
    """Items that left the feed by its last fetch are admitted, whether the fetches meet in one batch or not."""
    schema = schemas.FETCHES + ", fetched_at timestamp"
    inbox, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    store.write(sources=sources(spark, ("a", True, BASE), ("b", False, None)))
    fetched = [(200, "e1", _feed(1, 2)), (200, "e2", _feed(3)), (304, None, None)]
    rows = [("a", "u", status, None, etag, None, body, None, BASE + (10 + turn) * DAY) for turn, (status, etag, body) in enumerate(fetched)]
    rows += [("b", "u", 200, None, None, None, _feed(*days).replace("a.example", "b.example"), None, BASE + (10 + turn) * DAY) for turn, days in enumerate([(4, 5), (6, 7)])]
    for some in [rows] if at_once else [[r for r in rows if r[-1] == BASE + (10 + turn) * DAY] for turn in range(3)]:
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(inbox))
        ingest_stream(spark.readStream.schema(schema).parquet(str(inbox)), store, str(tmp_path / "ck")).awaitTermination()
    assert sorted(r["title"] for r in store.read("articles").collect()) == ["t1", "t2", "t3", "t5", "t6", "t7"]
    state = {r["id"]: (r["etag"], r["latest_published_at"]) for r in store.read("sources").collect()}
    assert state == {"a": ("e2", BASE + 3 * DAY), "b": (None, BASE + 7 * DAY)}
    if at_once:  # a replay of the batch changes nothing
        ingest_stream(spark.readStream.schema(schema).parquet(str(inbox)), store, str(tmp_path / "ck2")).awaitTermination()
        assert store.read("articles").count() == 6 and store.batch() == "0.3"


def test_a_writer_that_dies_loses_nothing(spark, tmp_path, monkeypatch):
    """Whatever step a write dies at, readers see what was before it, and the next write goes on from there."""
    from tidemark.sources import store as S

    root = tmp_path / "store"
    store = Store(spark, str(root))
    titles = lambda: sorted(r["title"] for r in store.read("articles").collect())
    store.write("1", articles=articles(spark, {"id": "a", "title": "x"}))
    real = Store.create

    def dies(self, name, text):
        if step == "before the list":
            raise OSError("lost")
        real(self, name, text[: len(text) // 2] if step == "within the list" else "")
        raise OSError("lost")

    for step in ("before the list", "within the list", "at an empty list"):
        monkeypatch.setattr(S.Store, "create", dies)
        with pytest.raises(OSError, match="lost"):
            store.write("2", append={"articles": articles(spark, {"id": "b", "title": "y"})})
        monkeypatch.setattr(S.Store, "create", real)
        assert titles() == ["x"] and store.batch() == "1"
    store.write("2", append={"articles": articles(spark, {"id": "b", "title": "y"})})
    assert titles() == ["x", "y"] and store.batch() == "2"
    store.vacuum(timedelta())
    assert titles() == ["x", "y"] and len(list((root / "articles").iterdir())) == 2
    store.compact("articles")
    assert titles() == ["x", "y"] and store.batch() == "2"
    # two writers that read the same list cannot both add the next one
    monkeypatch.setattr(S.Store, "numbers", lambda self, name: [1])
    with pytest.raises(RuntimeError, match="another writer"):
        store.write(articles=articles(spark))


def test_store_writes_only_what_changes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for i in "abc":
        store.write(i, "one", append={"articles": articles(spark, {"id": i, "title": i})})
    folders = lambda: {p.name for p in (tmp_path / "store" / "articles").iterdir()}
    before = folders()
    ids = spark.createDataFrame([("c",)], "id string")
    store.write("d", "two", upsert={"articles": (articles(spark, {"id": "b", "title": "B"}, {"id": "d", "title": "D"}), ids)})
    assert sorted(r["title"] for r in store.read("articles").collect()) == ["B", "D", "a"] and len(folders() - before) == 1
    new = spark.read.parquet(str(tmp_path / "store" / "articles" / (folders() - before).pop()))
    taken = spark.read.schema("gone string").parquet(*(str(p) for p in (tmp_path / "store" / "_gone" / "articles").iterdir()))
    assert new.count() == 2 and sorted(r["gone"] for r in taken.collect()) == ["b", "c", "d"]  # what changed, and no other row
    store.vacuum(timedelta())
    assert before < folders() and sorted(r["title"] for r in store.read("articles").collect()) == ["B", "D", "a"]
    # rows of an id that went come back when they are written again, and go again
    store.write("f", "two", append={"articles": articles(spark, {"id": "c", "title": "C"})})
    assert sorted(r["title"] for r in store.read("articles").collect()) == ["B", "C", "D", "a"]
    store.write("g", "two", upsert={"articles": (articles(spark), ids)})
    store.compact("articles")
    store.vacuum(timedelta())
    assert sorted(r["title"] for r in store.read("articles").collect()) == ["B", "D", "a"] and len(folders()) == 1
    assert list((tmp_path / "store" / "_gone" / "articles").iterdir()) == []
    # a batch is known by its writer: another one's of the same name is written, its own again is not
    store.write("d", "one", append={"articles": articles(spark, {"id": "e", "title": "e"})})
    store.write("d", "one", append={"articles": articles(spark, {"id": "f", "title": "f"})})
    assert sorted(r["title"] for r in store.read("articles").collect()) == ["B", "D", "a", "e"] and store.batch("two") == "g"


def test_lookup_opens_few_folders(spark, tmp_path):
    """Of many folders only those that may hold an asked key are opened, whatever their sizes; what is gone stays gone."""
    store = Store(spark, str(tmp_path / "store"))
    for turn, n in enumerate((1, 3, 40, 200, 8, 9, 17)):
        store.write(append={"articles": articles(spark, *({"id": f"{turn}-{i}", "title": f"{turn}"} for i in range(n)))})
    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "id string")
    got = store.lookup("articles", ids("2-39", "5-0", None, "none"))
    assert len(store.opened) == 2 and {r["title"] for r in got.collect()} == {"2", "5"} and got.count() == 49
    assert store.lookup("articles", ids("none", "other")).count() == 0 and store.opened == []
    every = [f"{turn}-{i}" for turn, n in enumerate((1, 3, 40, 200, 8, 9, 17)) for i in range(n)]
    assert store.lookup("articles", ids(*every)).count() == len(every) and len(store.opened) == 7
    store.write(upsert={"articles": (articles(spark, {"id": "2-0", "title": "new"}), ids("2-39"))})
    got = store.lookup("articles", ids("2-39", "2-0")).where("id in ('2-39', '2-0')")
    assert [(r["id"], r["title"]) for r in got.collect()] == [("2-0", "new")]
    far = store.lookup("articles", ids(*(f"far-{i}" for i in range(500))))
    assert far.count() <= 200 and len(store.opened) <= 1  # a false hit is rare


def test_runs_key_their_candidates_once(spark, monkeypatch):
    """The lookup and the admission read candidates that were keyed once, in many tasks whatever the files."""
    from tidemark.plans import QUERIES

    asked, lookup = [], Store.lookup

    def watched(self, table, ids):
        asked.append(ids._jdf.queryExecution().withCachedData().toString())
        return lookup(self, table, ids)

    monkeypatch.setattr(Store, "lookup", watched)
    assert sum(r["stored"] for r in QUERIES["run_sequence"](spark, "/root/testdata/sf0.001").collect()) > 100
    assert len(asked) == 3 and all("InMemoryRelation" in plan and "REPARTITION_BY_NUM" in plan for plan in asked)


def test_a_patch_that_dies_loses_nothing(spark, tmp_path, monkeypatch):
    """An upsert that dies after its rows, after its list of ids, or before its entry leaves the rows that were there."""
    store = Store(spark, str(tmp_path / "store"))
    store.write(articles=articles(spark, {"id": "a", "title": "x"}, {"id": "b", "title": "y"}))
    patch = {"articles": (articles(spark, {"id": "a", "title": "X"}), spark.createDataFrame([("b",)], "id string"))}
    rows = lambda: sorted((r["id"], r["title"]) for r in store.read("articles").collect())
    for step in ("_piece", "_gone", "_put"):
        real = getattr(Store, step)

        def dies(self, *args, real=real, step=step):
            if step != "_put":
                real(self, *args)
            raise OSError("lost")

        monkeypatch.setattr(Store, step, dies)
        with pytest.raises(OSError, match="lost"):
            store.write(upsert=patch)
        monkeypatch.setattr(Store, step, real)
        assert rows() == [("a", "x"), ("b", "y")]
    store.write(upsert=patch)
    assert rows() == [("a", "X")]


def test_live_view(spark, tmp_path):
    """Each write is shown; a query that is started again goes on after the last one that it showed."""
    store, shown = Store(spark, str(tmp_path / "store")), []
    show = lambda version, view: shown.append((version, view.count()))

    def writes(*names):
        query = live(store, lambda s: s.read("articles"), show, str(tmp_path / "ck"), every="0 seconds")
        try:
            for n in names:
                store.write(append={"articles": articles(spark, {"id": n})})
                query.processAllAvailable()
        finally:
            query.stop()

    writes("a", "b")
    assert shown == [(1, 1), (2, 2)]
    store.write(append={"articles": articles(spark, {"id": "c"})})  # while nobody looks
    writes("d")
    assert shown[-1] == (4, 4) and len({v for v, _ in shown}) == len(shown)


class _Refused(Exception):
    status = 401


def test_a_batch_stops_at_a_billing_error(spark):
    asked = []

    def model(row):
        asked.append(row["id"])
        if len(asked) == 2:
            raise _Refused("no key")
        return "{}"

    rows = spark.createDataFrame([(i, "t", "u", "s", "page", "x") for i in "abcd"], "id string, title string, url string, source_name string, content_source string, text string")
    got = {r["id"]: (r["answer"], r["error_kind"], r["error_status"]) for r in E.ask(rows, model, 1).collect()}
    assert sorted(got.values(), key=str) == sorted([("{}", None, None), (None, None, 401), (None, "stopped", None), (None, "stopped", None)], key=str)
    assert E.stops(400, "Your Credit Balance is low") and not E.stops(400, "x") and not E.stops(None, None)


def _waiting(spark, tmp_path, n):
    """A store with n waiting articles of their own text, newest first by number, and no page for them."""
    store = Store(spark, str(tmp_path / "store"))
    rows = [{"id": f"{i:02d}", "source_id": "s", "title": "t", "url": "u", "rss_summary": "r" * 300, "status": "new", "attempts": 0, "published_at": BASE - i * DAY, "published_at_provisional": False} for i in range(n)]
    store.write(sources=sources(spark, ("s", True, BASE)), articles=articles(spark, *rows))
    return store, spark.createDataFrame([], "id string, text string, published_at timestamp")


def _statuses(store):
    return {r["id"]: r["status"] for r in store.read("articles").collect()}


ANSWER = '{"headline":"h","brief":"b","digest":[],"detail":"d","tags":[]}'


def test_a_job_that_dies_between_claim_and_result(spark, tmp_path):
    now, (store, none) = datetime(2026, 10, 1), _waiting(spark, tmp_path, 4)

    def dies(row):
        raise SystemExit("the executor is gone")  # no error of an article: the task itself ends

    with pytest.raises(Exception, match="SystemExit|exit|gone|Python worker"):
        summarize(store, none, dies, now, limit=2, batch="1")
    assert _statuses(store) == {"00": "summarizing", "01": "summarizing", "02": "new", "03": "new"}
    early = claim(store, now + timedelta(minutes=14), limit=9)
    assert {r["id"] for r in early.collect()} == {"02", "03"}
    assert E.orphan_count(store.read("articles"), now + timedelta(minutes=15)).first()[0] == 2
    summarize(store, none, lambda r: ANSWER, now + timedelta(minutes=15), limit=1, batch="2")
    assert _statuses(store) == {"00": "done", "01": "new", "02": "summarizing", "03": "summarizing"}  # a lost claim beyond the limit is new again
    summarize(store, none, lambda r: ANSWER, now + timedelta(minutes=29), batch="3")
    assert set(_statuses(store).values()) == {"done"}


def test_no_task_asks_after_a_billing_error(spark, tmp_path):
    """All tasks look at the marker: after the error each has asked at most the one that was under way; what was not asked about is new again."""
    import time

    now, (store, none) = datetime(2026, 10, 1), _waiting(spark, tmp_path, 40)
    log = tmp_path / "asked"
    log.mkdir()

    def model(row):
        from uuid import uuid4

        first = not any(log.iterdir())
        (log / uuid4().hex).write_text(row["id"])
        if first:
            raise _Refused("no key")
        time.sleep(0.3)
        return ANSWER

    summarize(store, none, model, now, limit=40, parallelism=4)
    got = _statuses(store)
    asked = sum(1 for _ in log.iterdir())
    assert asked <= 8 and len(got) == 40 and set(got.values()) <= {"new", "done"}
    assert sum(s == "done" for s in got.values()) == asked - 1
    summarize(store, none, lambda r: ANSWER, now + timedelta(minutes=1), limit=40)
    assert set(_statuses(store).values()) == {"done"}


def test_a_repeated_claim_claims_nothing(spark, tmp_path):
    now, (store, none) = datetime(2026, 10, 1), _waiting(spark, tmp_path, 3)
    first = {r["id"] for r in claim(store, now, limit=1, batch="1.claim", writer="w").collect()}
    again = {r["id"] for r in claim(store, now, limit=1, batch="1.claim", writer="w").collect()}
    assert first == again == {"00"} and sorted(_statuses(store).values()) == ["new", "new", "summarizing"]
    finish(store, claim(store, now, limit=1, batch="1.claim", writer="w"), none, lambda r: ANSWER, now)
    assert _statuses(store)["00"] == "done"


def test_resummarize(spark, tmp_path):
    now, store = datetime(2026, 10, 1), Store(spark, str(tmp_path / "store"))
    store.write(sources=sources(spark, ("s", True, BASE)), articles=articles(spark, {"id": "a", "source_id": "s", "title": "x", "status": "done", "content_text": "old", "attempts": 0}, {"id": "b", "source_id": "s", "title": "y", "status": "done", "attempts": 0}))
    pages = spark.createDataFrame([("a", "p" * 900, None)], "id string, text string, published_at timestamp")

    def fails(row):
        raise ValueError("down")

    resummarize(store, "a", pages, fails, now, refetch=True)
    got = {r["id"]: r for r in store.read("articles").collect()}
    assert (got["a"]["status"], got["a"]["attempts"], got["a"]["content_text"]) == ("error", 1, None) and got["b"]["status"] == "done"
    resummarize(store, "a", pages, lambda r: '{"headline":"h","brief":"b","digest":[],"detail":"d","tags":[]}', now)
    got = {r["id"]: r for r in store.read("articles").collect()}
    assert got["a"]["status"] == "done" and got["a"]["content_text"] == "p" * 900 and got["a"]["summary"]["headline"] == "h" and len(got) == 2


def test_messages_go_by_position(spark, now):
    schema = "article_id string, pos int, role string, content string, refused boolean"
    new = spark.createDataFrame([("a", i, "user", str(i), None) for i in (3, 1, 2)], schema).repartition(3)
    chats = V.append_messages(spark.createDataFrame([], schemas.CHATS), new, now)
    assert [m["content"] for m in chats.first()["messages"]] == ["1", "2", "3"]
    with pytest.raises(Exception, match="need pos"):
        V.append_messages(chats, new.drop("pos"), now).collect()


def test_listings_are_fetched_for_failed_feeds_only(spark, tmp_path):
    now, store, asked = datetime(2026, 10, 1), Store(spark, str(tmp_path / "store")), []
    state = sources(spark, ("a", True, BASE), ("b", True, BASE)).withColumns({"listing_url": F.expr("'https://b.example/blog'"), "listing_link_pattern": F.expr("'/blog/'")})
    store.write(sources=state)

    def get(targets):
        asked.extend((r["source_id"], r["url"]) for r in targets.collect())
        return _fetch(spark, ("b", 200, None, '<a href="/blog/p-1"><h2>P</h2></a>', None))

    feeds = _fetch(spark, ("a", 200, "e1", _feed(1), None), ("b", None, None, None, "boom"))
    m = {r["source_id"]: r["added"] for r in refresh(store, feeds, get, now).collect()}
    assert m == {"a": 1, "b": 1} and asked == [("b", "https://b.example/blog")]


def test_admit_stream(spark, tmp_path):
    schema = "source_id string, id string, published_at timestamp"
    for turn, rows in enumerate(([("a", "1", BASE), ("a", "2", BASE + DAY), ("b", "9", BASE)], [("a", "2", BASE + DAY), ("a", "3", BASE + 2 * DAY), ("a", "0", BASE - 9 * DAY)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = admit_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None, turn
    got = sorted((r["source_id"], r["id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", "2"), ("a", "3"), ("b", "9")]


@pytest.mark.parametrize("limit", [None, 5000])
def test_admission_asks_state_for_lists(limit, monkeypatch):
    """However many keys a batch has, state is asked some times a day and part; batches that are gathered in several tables admit the same."""
    from types import SimpleNamespace

    import pandas as pd

    from tidemark.streaming import ingest as I

    calls = []

    def counted(of):
        return lambda self, *a: calls.append(of) or of(self, *a)

    class Kept(dict):
        getValue, updateValue, removeKey, containsKey = map(counted, (dict.__getitem__, dict.__setitem__, dict.pop, dict.__contains__))  # noqa: N815
        exists = lambda self: len(self) > 0
        keys = lambda self: list(dict.keys(self))
        update, get = lambda self, v: self.__setitem__("v", v), lambda self: self["v"]

    def run():
        admission = I._Admission(limit)
        admission.init(SimpleNamespace(getValueState=lambda *_: Kept(), getMapState=lambda *_: Kept()))
        day, out = 86_400_000_000, []
        for n, batch in enumerate(([(0, "a")], [(i * day // 10000, f"k{i % 19000}") for i in range(20000)], [(2 * day + i, f"k{i}") for i in range(20000)])):
            parts = [pd.DataFrame(batch[i : i + 1000], columns=["at", "id"]) for i in range(0, len(batch), 1000)]
            calls.clear()
            got = [i for d in admission.handleInputRows(("s",), iter(parts), None) for i in d["id"]]
            assert len(got) == len(set(got)) and not set(got) & {i for g in out for i in g}, n
            out.append(sorted(got))
        return out, len(calls)

    whole, many = run()
    assert many < 2000
    assert limit or [len(g) for g in whole] == [1, 19000, 1000]
    monkeypatch.setattr(I, "_AT_ONCE", 3000)
    assert run()[0] == whole


@pytest.mark.parametrize("limit", [0, 2, 3])
def test_capped_stream_equals_capped_runs(spark, tmp_path, limit):
    """Batch by batch what ``commit`` admits when each run sees again what was carried over; late, repeated and undated candidates included."""
    schema = "source_id string, id string, published_at timestamp"
    turns = [
        [("a", "1", 0), ("a", "2", 1), ("b", "9", 0)],
        [("a", "2", 1), ("a", "3", 2), ("a", "4", 3), ("a", "5", 4), ("a", "0", -9), ("a", "u", None), ("b", "8", -1), ("b", "8", -1)],
        [("a", "6", 5), ("a", "3", 2), ("a", "7", 1.5), (None, "n", 1), ("b", "7", 3)],
        [("a", "8", 30), ("a", "9", 20), ("b", "6", 9), ("c", "5", 1)],
        [("a", "6", 5), ("b", "7", 3), ("a", "x", 31), ("c", "4", -1)],
    ]
    turns = [[(s, f"{s}{i}", d) for s, i, d in rows] for rows in turns]
    state = sources(spark, ("a", False, None), ("b", False, None), ("c", False, None))
    stored, carried, cold = [], [], set()
    for turn, rows in enumerate(turns):
        known = [(s, i, d) for s, i, d in rows if s and d is not None]
        seen = [*carried, *known]
        cands = candidates(spark, *seen) if seen else candidates(spark, ("z", 1)).limit(0)
        cands = cands.join(spark.createDataFrame([(s,) for s in {s for s, *_ in known}], "source_id string"), "source_id", "left_semi")  # a source without input waits
        done = commit(cands, state, articles(spark, *({"id": i} for i in stored)), BASE, limit=limit)
        new = {r["id"] for r in done.articles.collect()}
        marks = {r["id"]: r["latest_published_at"] for r in done.sources.collect()}
        begun = {s for s, *_ in known} - cold
        cold |= begun
        old = {r["id"]: r["latest_published_at"] for r in state.collect()}
        fresh = lambda s, d: s not in begun and (old[s] is None or BASE + d * DAY > old[s] - 3 * DAY)  # noqa: B023, E731
        stored += sorted(new)
        carried = [(s, i, d) for s, i, d in dict.fromkeys(seen) if i not in stored and fresh(s, d)]
        state = sources(spark, *((s, s in cold, m) for s, m in marks.items()))
        spark.createDataFrame([(s, i, None if d is None else BASE + d * DAY) for s, i, d in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        admitted = admit_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), limit)
        admitted.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        assert sorted(r["id"] for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()) == sorted(stored), turn
