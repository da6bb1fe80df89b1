from __future__ import annotations

import random
import re
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import minhash
from tidemark.llm.components import connected_components
from tidemark.llm.minhash import band_keys, drop_near_duplicates, near_groups, signatures
from tidemark.llm.scratch import Scratch
from tidemark.llm.words import column_sets


def words_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def sets_of(text, size):
    w = words_of(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows, size, percent):
    """{doc_id: (n_shingles, component_id)} by comparing all pairs; rows with distinct ids."""
    sets = {i: sets_of(t, size) for i, t in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = top(a), top(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in sets}


def check(df, rows, **options):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_groups(df, **options).collect()}
    assert got == brute(rows, options["shingle"], options["percent"])


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.random()}"
    return " ".join(out)


def test_groups_equal_brute_force(spark, docs):
    rng = random.Random(4)
    bases = [[f"w{rng.randrange(300)}" for _ in range(rng.randrange(3, 160))] for _ in range(25)]
    rows = []
    for b in bases:
        for _ in range(rng.randrange(1, 7)):
            rows.append(edited(rng, b, rng.randrange(0, 1 + len(b) // 12)))
    rows += ["", None, "one", "One", "two words", " two\twords ", "A b C", "a B c"]
    rng.shuffle(rows)
    check(docs(*rows), list(enumerate(rows)), shingle=3, percent=85)
    check(docs(*rows), list(enumerate(rows)), shingle=5, percent=80)


def test_one_large_family(spark, docs):
    """Many copies of one text, so unlike each other that most pairs of a bucket are no links: large buckets are finished in blocks."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    rows = [edited(rng, base, rng.randrange(2, 9)) for _ in range(150)]
    check(docs(*rows), list(enumerate(rows)), shingle=3, percent=85)


@pytest.mark.parametrize("rounds", [0, 2])
def test_many_blocks(spark, docs, monkeypatch, rounds):
    """Large buckets in many blocks, with and without new pivots before, give what all pairs give."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 4)
    monkeypatch.setattr(minhash, "PIVOT_ROUNDS", rounds)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    rows = [edited(rng, base, rng.randrange(2, 11)) for _ in range(120)]
    check(docs(*rows), list(enumerate(rows)), shingle=3, percent=85)


def test_block_links_span_components():
    """Four alike members of three components outside of the largest: links enough to join all, not all pairs."""
    rows = pd.DataFrame({"id": [1, 2, 3, 4, 1, 2, 3, 4, 5], "component": [1, 1, 3, 4, 1, 1, 3, 4, 5], "is_first": [True] * 4 + [False] * 5, "shingles": [np.arange(20)] * 8 + [np.arange(50, 70)]})
    got = minhash._block_links(80)(rows)
    assert len(got) == 2 and {x for r in got.itertuples(index=False) for x in r} <= {1, 2, 3, 4}


def test_one_id_with_two_texts(spark, docs):
    """Both texts' groups are one through the shared doc_id, and true links are not lost to bounds."""
    a, b, c = ("p q r s t u v w x y", "a b c d e f g h i j", "k l m n o")
    rows = [(9, a), (9, b), (3, a), (4, b), (5, c), (5, a), (7, "z")]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_groups(docs(*rows), shingle=3, percent=85).collect()}
    assert got == {(9, 3, False), (3, 3, True), (4, 3, False), (5, 3, False), (7, 7, True)}
    left = drop_near_duplicates(docs(*rows), shingle=3, percent=85).collect()
    assert sorted(r["doc_id"] for r in left) == [3, 7]


def test_edges(spark, docs):
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (7, "A B C D"), (9, None), (8, " \n "), (6, "x " * 30_000)]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_groups(docs(*rows), shingle=3, percent=85).collect()), key=str)
    assert got == sorted([(5, 2, 5, True), (5, 2, 5, True), (None, 2, None, True), (7, 2, 5, False), (9, 0, 9, True), (8, 0, 8, True), (6, 1, 6, True)], key=str)
    assert near_groups(docs("a").limit(0)).count() == 0


def test_drop(spark, docs):
    df = docs((3, "a b c d e f"), (1, "A b c d e f"), (1, "A b c d e f"), (2, "other"), (None, "a b c d e f"))
    left = drop_near_duplicates(df)
    assert left.columns == df.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "2", "None"]


def test_signatures_estimate_jaccard():
    a, b = (np.unique(np.concatenate([np.arange(900), np.arange(lo, lo + 100)])).astype(np.uint64) for lo in (1000, 2000))
    from tidemark.llm.words import mix

    sig = signatures([np.sort(mix(a)), np.sort(mix(b))], 512)
    assert abs((sig[0] == sig[1]).mean() - 900 / 1100) < 0.05
    assert len(set(band_keys(sig)[0])) == 1024 // 5


def test_word_hashes_depend_on_words_only():
    import pyarrow as pa

    texts = ["ab c", "x ab  c", None, "", "AB\tc", "aé中 b", "ab c"]
    sets = [set(s.tolist()) for s in column_sets(pa.array(texts), 1)]
    assert sets[0] == sets[4] and sets[0] < sets[1] and sets[2] == sets[3] == set() and len(sets[6]) == 1
    sliced = [set(s.tolist()) for s in column_sets(pa.array(texts).slice(1), 1)]
    assert sliced == sets[1:]


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(2)
    pairs = {"path": [(i, i + 1) for i in range(60)], "star": [(99, i) for i in range(50)], "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]}[shape]
    up = {}

    def top(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in pairs:
        if a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    df = spark.createDataFrame([*pairs, (1, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df, Scratch(spark, "t")).collect()}
    assert got == {i: top(i) for i in up}
    assert connected_components(df.where(F.lit(False)), Scratch(spark, "t")).count() == 0


def test_shingle_sets_hold_little_at_once():
    """The memory that a Python worker needs above a column's own bytes is that of a chunk of its texts."""
    column = pa.array(["some words of a text " * 100] * 2000)
    list(column_sets(column.slice(0, 1), 5))
    tracemalloc.start()
    for _ in column_sets(column, 5):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20
