from __future__ import annotations

import gzip
import hashlib
import io
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import fingerprint as P
from tidemark.llm import knn
from tidemark.llm import warc as A
from tidemark.llm.knn import top_k
from tidemark.llm.mixing import PACKET, mix, mixed_documents
from tidemark.llm.ordering import running_total
from tidemark.llm.scratch import Scratch


def targets_of(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Water filling by hand over sizes by source in order, null last."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in stopped]
        level = (total - sum(stopped.values())) / sum(weight[s] for s in free) if free else 0
        above = [s for s in free if weight[s] * level >= cap * sizes[s]]
        if not above:
            return stopped | {s: weight[s] * level for s in free}
        stopped |= {s: cap * sizes[s] for s in above}


def make_docs(seed=1, n=120):
    rng = random.Random(seed)
    return [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([0, 1, 5, 30, 200]))), "en", rng.choice(["a", "a", "a", "b", "c", "Z", "é", None])) for i in range(n)]


def test_mix_meets_targets(spark, docs):
    rows = make_docs()
    got = mix(docs(*rows)).collect()
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = targets_of(sizes)
    taken = {}
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["size"] == len(rows[r["doc_id"]][1].split()) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= PACKET for s in sizes) and sum(taken.values()) == int(1.5 * sum(sizes.values()))
    again = mix(docs(*reversed(rows)).repartition(7)).select("doc_id", "taken").collect()
    assert sorted(again) == sorted((r["doc_id"], r["taken"]) for r in got)


def fair_queue(rows, budget, cap=2):
    """{(doc_id, shuffle_key): words taken} by a queue served one packet after the other."""
    packets = []
    for source in {r["source"] for r in rows}:
        at = 0
        own = sorted((r for r in rows if r["source"] == source), key=lambda r: (r["shuffle_key"], r["doc_id"]))
        for _ in range(cap):
            for r in own:
                for first in range(0, r["size"], PACKET):
                    words = min(PACKET, r["size"] - first)
                    at += words
                    packets.append((at / r["target"], source is None, source or "", r["shuffle_key"], r["doc_id"], words))
    taken = {}
    for *_, key, i, words in sorted(packets):
        taken[i, key] = taken.get((i, key), 0) + min(words, budget)
        budget -= min(words, budget)
    return taken


@pytest.mark.parametrize("budget", [None, 3000])
def test_mix_is_a_fair_queue(spark, docs, budget):
    """Row by row what a queue in Python takes; sorted by anything but finish time, it takes something else."""
    rng = random.Random(2)
    rows = [*make_docs(7), *((500 + i, "v " * rng.choice([300, 1000, 4000]), "en", rng.choice("abc")) for i in range(12))]
    got = mix(docs(*rows), budget=budget).collect()
    whole = int(1.5 * sum(r["size"] for r in got))
    want = fair_queue(got, whole if budget is None else budget)
    taken = {(r["doc_id"], r["shuffle_key"]): r["taken"] for r in got if r["size"]}
    assert taken == {k: want.get(k, 0) for k in taken} and sum(taken.values()) == (budget or whole)
    other = mix(docs(*rows), budget=budget, seed=8).collect()
    assert {r["doc_id"]: r["taken"] for r in other} != {r["doc_id"]: r["taken"] for r in got}
    last_first = [r.asDict() | {"target": -r["target"]} for r in got]
    assert fair_queue(last_first, whole if budget is None else budget) != want


def test_mix_repeated_rows_lose_no_word(spark, docs):
    rows = [(3, "x y z", "en", "a")] * 301 + [(4, "u v", "en", "b")] * 7 + [(5, "w " * 3000, "en", "c")]
    got = mix(docs(*rows)).collect()
    total = 903 + 14 + 3000
    assert len(got) == len(rows) and sum(r["taken"] for r in got) == int(1.5 * total) and all(r["taken"] <= 2 * r["size"] for r in got)
    out = mixed_documents(docs(*rows)).collect()
    assert sum(len(r["text"].split()) for r in out) == int(1.5 * total)
    assert sum(r["text"] not in ("x y z", "u v", "w " * 3000) for r in out) <= 1


def test_mix_budget_and_edges(spark, docs):
    rows = make_docs(3)
    got = mix(docs(*rows), budget=500).collect()
    assert sum(r["taken"] for r in got) == 500
    by = {}
    for r in got:
        by.setdefault(r["source"], [0, r["target"]])[0] += r["taken"]
    share = 500 / sum(t for _, t in by.values())
    assert all(abs(n - t * share) <= 200 for n, t in by.values())
    assert mix(docs("a").limit(0)).count() == 0
    odd = mix(docs((1, None), (2, ""), (None, "a b"), (3, "x y"), (3, "x y"), (3, "x y"))).collect()
    assert len(odd) == 6 and sorted(r["taken"] for r in odd)[:2] == [0, 0] and sum(r["taken"] for r in odd) == 12
    assert [r["taken"] for r in mix(docs((1, None))).collect()] == [0]


def test_mixed_documents(spark, docs):
    rows = [*make_docs(5), (500, "x y z", "en", "a"), (500, "x y z", "en", "a")]
    df = docs(*rows)
    out = mixed_documents(df)
    assert out.columns == df.columns and out.schema["n_chars"].dataType == df.schema["n_chars"].dataType
    want, got, texts = {}, {}, dict((i, t) for i, t, *_ in rows)
    for r in mix(df).collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["taken"]
    for r in out.collect():
        words = r["text"].split()
        assert words == texts[r["doc_id"]].split()[: len(words)] and r["n_chars"] == len(r["text"])
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(words)
    assert got == {k: v for k, v in want.items() if v}


def test_running_total(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), (F.col("id") % 5).alias("v"))
    got = running_total(df, [F.col("k").asc()], "v", "t", Scratch(spark, "t"), "r").orderBy("k").collect()
    assert [r["t"] for r in got] == np.cumsum([r["v"] for r in got]).tolist()


def test_top_k_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 3, (12, 8))
    vecs = [(i, [float(x) for x in centres[i % 12] + rng.normal(0, 0.3, 8)]) for i in range(700)]
    vecs += [(i, vecs[3][1]) for i in range(700, 1400)]
    vecs += [(2000, None), (2050, [1.0, None] + [0.0] * 6), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (2200, []), (2250, [1.0, 2.0]), (2300, vecs[3][1]), (2300, vecs[3][1]), (None, vecs[3][1])]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<float>").selectExpr("*", "'x' v", "'y' cell", "0 rank", "1 ring", "2 part", "3 block", "4 least")
    fine = {}
    for i, v in vecs:
        if i is not None and v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v):
            fine[i] = np.pad(np.floor(256 * np.array([np.float32(x) for x in v], np.float64)), (0, 8 - len(v))).astype(np.int64)
    want = set()
    for q in (i for i in fine if i % 50 == 0):
        best = sorted((-int(fine[q] @ v), i) for i, v in fine.items() if i != q)[:5]
        want |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    got = [tuple(r) for r in top_k(df, pivots=16, sample=64).select("query_id", "rank", "vec_id", "score").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    monkeypatch.setattr(knn, "BLOCK", 40)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 3)
    assert {tuple(r) for r in top_k(df).collect()} == want
    assert top_k(df.limit(0)).count() == 0 and top_k(df.where("vec_id = 50")).count() == 0
    few = top_k(df.where("vec_id in (50, 51, 52)")).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2]


PAGES = "page_id long, url string, html string"


def test_warc_round_trip(spark):
    big, small = "é" * 600, "x" * 999
    rows = [(1, "http://a/1", big), (2, "http://a/ 2\r\n", big), (9, None, big), (3, "u", small), (4, "u", small), (5, "u", None), (6, "u", ""), (7, "u", "y" * 1000), (None, "u", big), (9, None, big), (8, "u", "WARC/1.0\r\n\r\n\r\n" * 100)]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' digest", "'y' top", "'z' capture")
    got = A.archive_and_read(df).collect()
    assert len(got) == len(rows)
    seen = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in got), key=str)
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        revisit = html == big and i in (1, 2)
        want.append((i, "revisit" if revisit else "response", 9 if revisit else None, len(raw), hashlib.sha1(raw).hexdigest()))
    assert seen == sorted(want, key=str)
    assert A.archive_and_read(df.limit(0)).count() == 0


def test_warc_files_and_captures(spark, tmp_path):
    scratch = Scratch(spark, "t")
    A.write_archives(spark.createDataFrame([(1, "http://a/1", "<p>1</p>"), (2, "http://a/2", "z" * 2000), (3, "http://a/3", "z" * 2000)], PAGES), str(tmp_path / "w"), scratch)
    found = {}
    for f in (tmp_path / "w").glob("*.gz"):
        for headers, block in A.parse_records(io.BufferedReader(gzip.open(f))):
            found.setdefault(headers["warc-type"], []).append((headers, block))
    assert {k: len(v) for k, v in found.items()} == {"request": 3, "response": 2, "revisit": 1, "metadata": 3}
    ids = [h["warc-record-id"] for v in found.values() for h, _ in v]
    assert len(set(ids)) == 9 and all(re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", i) for i in ids)
    records = A.read_archives(spark, str(tmp_path / "w"))
    rows = {r["metadata"]["page_id"]: r for r in A.captures(records).collect()}
    assert bytes(rows[1]["response"]["payload"]) == b"<p>1</p>" and rows[1]["request"]["target_uri"] == "http://a/1"
    assert rows[2]["response"]["record_type"] == "revisit" and rows[2]["response"]["payload"] is None
    lone = records.where("record_type = 'metadata'")
    assert [r["response"] for r in A.captures(lone).collect()] == [None] * 3


def test_warc_reads_plain_and_member_wise_files(spark, tmp_path):
    one = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: 23\r\n\r\nHTTP/1.1 200 OK\r\n\r\nbody"
    two = b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <b>\r\nWARC-Concurrent-To: <a>\r\nContent-Length: 11\r\n\r\npage-id: 4\n"
    (tmp_path / "p.warc").write_bytes(one + b"\r\n\r\n" + two + b"\r\n\r\n")
    (tmp_path / "m.warc.gz").write_bytes(b"".join(gzip.compress(x + b"\r\n\r\n") for x in (one.replace(b"<a>", b"<c>"), two.replace(b"<a>", b"<c>").replace(b"<b>", b"<d>"))))
    rows = A.captures(A.read_archives(spark, str(tmp_path))).collect()
    assert sorted((r["capture_id"], bytes(r["response"]["payload"]), r["metadata"]["page_id"]) for r in rows) == [("<a>", b"body", 4), ("<c>", b"body", 4)]


def test_warc_damaged_records(spark, tmp_path):
    """Repeated and folded headers are kept; damage is told, costs its own record only, and stays out of captures."""
    one = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nWARC-Target-URI: http://a/\r\n 1\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n"
    two = b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <b>\r\nWARC-Concurrent-To: <a>\r\nWARC-Concurrent-To: <c>\r\nContent-Length: 11\r\n\r\npage-id: 4\n\r\n\r\n"
    cut = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <c>\r\nContent-Length: 999\r\n\r\nshort"
    (tmp_path / "d.warc").write_bytes(b"noise\r\n" + one + two + cut)
    (tmp_path / "e.warc").write_bytes(b"")
    records = A.read_archives(spark, str(tmp_path))
    found = sorted((r["problem"] or "", r["record_id"] or "", r["target_uri"] or "") for r in records.collect())
    assert found == [("", "<a>", "http://a/ 1"), ("", "<b>", ""), ("skipped", "", ""), ("truncated", "<c>", "")]
    got = {r["capture_id"]: r for r in A.captures(records).collect()}
    assert set(got) == {"<a>", "<c>"} and got["<a>"]["response"] and got["<c>"]["response"] is None and got["<c>"]["metadata"]["page_id"] == 4


def test_warc_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(A, "FILE_BYTES", 4096)
    monkeypatch.setattr(A, "SMALL_PAGE", 1024)
    rng = random.Random(1)
    rows = [(i, f"http://a/{i}", "".join(rng.choice("abcdefgh") for _ in range(rng.choice([10, 900, 1500, 40_000])))) for i in range(60)]
    A.write_archives(spark.createDataFrame(rows, PAGES), str(tmp_path / "w"), Scratch(spark, "t"))
    seen = set()
    for f in (tmp_path / "w").glob("*.gz"):
        payloads = [b for h, b in A.parse_records(io.BufferedReader(gzip.open(f))) if h["warc-type"] == "response"]
        assert len(payloads) <= 1 or sum(map(len, payloads)) <= 4096 + 200 * len(payloads)
        seen |= {b.split(b"\r\n\r\n", 1)[1].decode() for b in payloads}
    assert seen == {h for *_, h in rows}


def shingles_of(text):
    from tests.llm.test_minhash import sets_of

    return sets_of(text, 5)


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_equal_brute_force(spark, docs):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.choice([0, 1, 4, 5, 40, 90]))) for _ in range(60)] + [None, "😀é" * 20, "\n \t"]
    ids = list(range(0, 3 * len(texts), 3))
    rng.shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    got = {r["doc_id"]: r for r in P.edit_fingerprints(docs(*rows)).collect()}
    ordered = sorted(rows, reverse=True)
    prints = {}
    for (i, t), (j, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = (t[:-half] if half else t) + after[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        for near, other in ((r["near_edited"], edited), (r["near_next"], after)):
            a, b = shingles_of(t), shingles_of(other)
            assert near == pytest.approx(jaccard(a, b), abs=1e-9 if len(a | b) <= P.K else 0.1)
        assert r["distinct_shingles"] == len(shingles_of(t))
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        prints.setdefault(edited, r["edited_fingerprint"])
        assert prints[edited] == r["edited_fingerprint"]
    assert len(got) == len(rows)


def test_fingerprint_edges(spark, docs):
    (one,) = P.edit_fingerprints(docs("a b c d e f")).collect()
    assert one["near_next"] == 1.0
    assert P.edit_fingerprints(docs("a").limit(0)).count() == 0
    rows = [(1, "b"), (1, "a"), (None, "n"), (None, None), (2, "c" * 100_000)]
    assert sorted(str(r["doc_id"]) for r in P.edit_fingerprints(docs(*rows)).collect()) == ["1", "1", "2", "None", "None"]


def test_sketches_estimate_and_merge(spark):
    words = [f"w{i}" for i in range(4000)]
    a, b, both = (P.sketches([" ".join(words[x:y])])[0] for x, y in ((0, 3000), (1000, 4000), (0, 4000)))
    assert len(a) == P.K and abs(P.resemblance(a, b) - 0.5) < 0.15 and abs(P.containment(a, both) - 1) < 0.2
    assert abs(P.distinct_shingles(a) / 2996 - 1) < 0.3
    assert (P.merged(a, b) == both).all() and (P.decode(P.encode(a)) == a).all() and P.encode(P.decode("")) == ""
    df = spark.createDataFrame([("k", P.encode(a)), ("k", P.encode(b)), ("k", P.encode(a)), ("l", None)], "key string, fingerprint string")
    got = {r["key"]: r["fingerprint"] for r in P.merge_fingerprints(df, "key").collect()}
    assert got == {"k": P.encode(both), "l": ""}
    row = spark.createDataFrame([(P.encode(a), P.encode(b))], "a string, b string").select(P.resemblance_of("a", "b").alias("r"), P.containment_of("a", "b").alias("c"), P.distinct_of("a").alias("d")).first()
    assert row["r"] == P.resemblance(a, b) and row["c"] == P.containment(a, b) and row["d"] == P.distinct_shingles(a)
