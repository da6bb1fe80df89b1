from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from tidemark.llm import centroids as K
from tidemark.llm import queries as Q
from tidemark.llm import rules as R
from tidemark.llm import spelling as S

# clustering


def brute_clusters(rows, k=8, rounds=10, width=64, scale=1024, seed=3):
    """[(vec_id, cluster, distance, cluster_inertia, inertia, sha)] in plain integers."""
    import math

    fit = lambda e: e is not None and len(e) == width and all(x is not None and math.isfinite(x) for x in e)
    kept = [(i, [math.floor(scale * x) for x in e]) for i, e in rows if fit(e)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), i, v) for i, v in kept if i is not None)[:k]
    centres = [v for _, _, v in first]
    if not centres:
        return []
    gap = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    assign = lambda: [min((gap(v, c), j) for j, c in enumerate(centres)) for _, v in kept]
    for _ in range(rounds):
        near = [j for _, j in assign()]
        for j in set(near):
            own = [v for (_, v), x in zip(kept, near, strict=True) if x == j]
            centres[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = assign()
    of = Counter()
    for d, j in found:
        of[j] += d
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, j, d, of[j], sum(of.values()), shas[j]) for (i, _), (d, j) in zip(kept, found, strict=True)]


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, e, "x", 1) for i, e in rows], f"vec_id long, embedding array<{kind}>, key string, ids int")


def in_order(rows):
    return sorted(tuple(r) for r in rows)


def test_clusters_equal_plain_integers(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=64).round(2)]) for i in range(150)]
    rows += [(1000 + i, rows[0][1]) for i in range(75)]  # a third are copies
    rows += [(7, rows[7][1]), (8, rows[9][1])]  # a row again, and a vec_id with another vector
    rows += [(2000, None), (2001, []), (2002, [0.5] * 63), (2003, [None] + [0.5] * 63), (2004, [float("nan")] * 64), (2005, [float("inf")] + [0.0] * 63), (2006, [0.5] * 65)]
    got = K.cluster(vectors(spark, rows).repartition(5)).collect()
    assert in_order(got) == in_order(brute_clusters(rows))


def test_clusters_of_few_and_none(spark):
    few = [(i, [float(i)] * 64) for i in range(3)]
    assert in_order(K.cluster(vectors(spark, few)).collect()) == in_order(brute_clusters(few))
    tied = [(i, [0.25] * 64) for i in range(20)]  # all centroids alike: the first takes all, the others are empty and stay
    assert in_order(K.cluster(vectors(spark, tied, "double")).collect()) == in_order(brute_clusters(tied))
    for rows in ([], [(1, None)], [(None, [0.5] * 64)]):
        none = K.cluster(vectors(spark, rows))
        assert none.collect() == [] and none.columns == [c.split()[0] for c in K.LABELS.split(", ")]


def test_rows_without_id_and_huge_components(spark):
    rng = np.random.default_rng(6)
    rows = [(i if i % 3 else None, [float(x) for x in rng.normal(size=64)]) for i in range(60)]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, K.cluster(vectors(spark, rows, "double")).collect()), key=key) == sorted(brute_clusters(rows), key=key)
    wide = [(i, [1e300 * (-1) ** i] + [0.0] * 63) for i in range(12)]
    got = K.cluster(vectors(spark, wide, "double"), k=2).collect()
    assert len(got) == 12 and {r["distance"] for r in got} <= {0, K.MOST_DIFFERENCE**2}


def test_a_table_has_each_occurring_number_once():
    batch = pa.RecordBatch.from_pydict({"vec_id": list(range(4)), "embedding": [[0.0, 1.0], [0.0, 2.0], [0.0, 1.0], [3.0, 1.0]], "key": list("abcd")})
    block = next(K._blocks(K._encode(2, 1, 2)(iter([batch]))))
    assert block.sizes.tolist() == [2, 2] and block.numbers.tolist() == [0, 3, 1, 2]
    centres = np.array([[0, 0], [3, 1]])
    assert block.tables(centres).tolist() == [[0, 9], [9, 0], [1, 0], [4, 1]]
    cluster, distance = block.nearest(centres)
    assert cluster.tolist() == [0, 0, 0, 1] and distance.tolist() == [1, 4, 1, 0]
    sums = {(c, d): (n, (high << 32) + low) for c, d, n, high, low in block.sums(cluster, 2)}
    assert sums == {(0, 0): (3, 0), (0, 1): (3, 4), (1, 0): (1, 3), (1, 1): (1, 1)}
    assert K.moved(np.array([[9, 9]]), [(0, 0, 2, -1, 2**32 - 3), (0, 1, 2, 0, 5)]).tolist() == [[-2, 2]]  # floors of -3/2 and 5/2


def test_rounds_end_where_nothing_moves(spark):
    found = K.Clustering(vectors(spark, [(i, [float(i % 2)] * 64) for i in range(10)]), k=2, width=64, scale=1024, seed=3)
    turns = [found.round() for _ in range(4)]
    assert turns[-1] is False
    plan = found.labels()._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" not in plan


# spelling


def edits(a, b):
    """Whether one insertion, deletion or replacement makes b of a."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_counts(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            if i is not None and (h := zlib.crc32(f"{i}:{w}".encode())) % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute_variants(counts):
    near = {w: [v for v in counts if edits(w, v)] for w in counts}
    form = {}
    for w, all_of in near.items():
        best = min(all_of, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def spelled(seed, n=220):
    """Texts of words that are one edit from each other, by syllables, with accents, capitals and signs between."""
    rng = random.Random(seed)
    base = ["".join(rng.choice(["th", "an", "er", "é", "ou", "st", "a", "b"]) for _ in range(rng.randint(2, 6))) for _ in range(60)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(40):
            w = rng.choice(base)
            if rng.random() < 0.4:
                at, c = rng.randrange(len(w)), rng.choice("abéÉz")
                w = rng.choice([w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :]])
            words.append(w.title() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", "-", "\n"]).join(words)))
    return rows


@pytest.mark.parametrize("block", [2048, 7, 1])
def test_variants_equal_brute_force(spark, docs, monkeypatch, block):
    """Also where places are parted into many blocks, of which each two meet in a tile."""
    monkeypatch.setattr(S, "BLOCK", block)
    rows = [*spelled(1), (None, "abcde abcde abcde abcdf"), (900, None), (901, ""), (902, "abcdf abcdf"), (902, "abcdf"), (0, "12 34 ÷×÷×÷ ÷×÷×÷ ÷×÷×÷")]
    got = S.variants(docs(*rows))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    found = [tuple(r) for r in got.collect()]
    want = brute_variants(brute_counts(rows))
    assert set(found) == want and len(found) == len(want)
    assert any(n > 3 for *_, n, _ in want) and any(r not in (w, f) for w, f, r, *_ in want)  # hubs, and chains of forms


def test_forms_by_hand(spark):
    words = spark.createDataFrame([("abcde", 3), ("abcdf", 6), ("abcdg", 6), ("abcdef", 12), ("zzzzz", 4), ("zzzzzz", 7)], "word string, n long")
    got = {r["word"]: tuple(r)[1:] for r in S.near_words(words).collect()}
    assert got == {
        "abcde": (3, "abcdef", 12), "abcdf": (3, "abcdef", 12), "abcdg": (2, None, None), "abcdef": (2, None, None),
        "zzzzz": (1, None, None), "zzzzzz": (1, None, None),
    }
    chain = spark.createDataFrame([(chr(97 + i), chr(98 + i)) for i in range(20)], "word string, form string")
    assert {r["root"] for r in S.roots(chain, S.Scratch(spark, "t")).collect()} == {"u"}


def test_variants_of_nothing_and_of_long_words(spark, docs):
    for rows in ([], [(1, None)], [(1, "a b c")]):
        assert S.variants(docs(*rows)).collect() == []
    long = "ab" * 5000
    rows = [(i, f"{long} {long} {long}c") for i in range(3)]
    got = {tuple(r) for r in S.variants(docs(*rows)).collect()}
    assert got == brute_variants(brute_counts(rows)) and {n for *_, n, _ in got} == {1}


def test_tiles_that_straddle_batches(monkeypatch):
    """Whatever the batches are and however few pairs are compared at once."""
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.choice([6, 7]))) for _ in range(150)})
    counts = {w: rng.randint(3, 9) for w in words}
    rows = []
    for w, n in counts.items():
        for of in (len(w), len(w) - 1):
            for last, part in ((0, w[: of // 2]), (1, w[len(w) - (of - of // 2) :])):
                if of >= 5:
                    rows.append((of, last, zlib.crc32(part.encode()), 0, 0, 0, w, n))
    rows.sort(key=lambda r: (*r[:6], -r[7], r[6]))
    table = pa.table(list(zip(*rows, strict=True)), ["of", "last", "half", "i", "j", "block", "word", "n"])
    seen = []
    for size, cells, waiting in ((10_000, 1 << 22, 1 << 16), (3, 64, 1), (17, 1, 40)):
        monkeypatch.setattr(S, "CELLS", cells)
        monkeypatch.setattr(S, "WAITING", waiting)
        near = Counter()
        for batch in S._whole_tiles(iter(table.to_batches(max_chunksize=size))):
            for r in batch.to_pylist():
                near[r["word"]] += r["near"]
        seen.append(near)
    assert seen[0] == seen[1] == seen[2] == Counter({w: k for w in words if (k := sum(edits(w, v) for v in words))})


# rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_rules(text):
    text = text or ""
    words, lines = WORDS.findall(text), text.split("\n")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    dup = sum(bool(WORDS.search(line)) and line in lines[:i] for i, line in enumerate(lines))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def texts():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeéß日#$x") for _ in range(rng.randint(1, 7)))
    out = [None, "", " \t\n", "a b  c d e\x0bf\x0cg\rh", "a\n\na\n \n \nb\r\na\r\n", "x " * 40, "one"]
    for _ in range(60):
        words = [word() for _ in range(rng.choice([5, 19, 20, 60, 400]))]
        if rng.random() < 0.7:
            at, again = rng.randrange(len(words)), rng.randrange(len(words))
            words[again:again] = words[at : at + rng.choice([7, 8, 9, 30])]
        out.append("".join(w + rng.choice([" ", "  ", "\n", "\t"]) for w in words))
        if rng.random() < 0.3:
            out[-1] += "\n" + "\n".join(rng.choices(out[-1].split("\n"), k=5))
    return out


def test_rules_equal_brute_force(spark, docs):
    rows = list(enumerate(texts())) + [(3, "again"), (3, "again"), (None, "no id")]
    got = R.quality_rules(docs(*rows)).collect()
    assert len(got) == len(rows)
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r["doc_id"], *(r[c] for c in base)) for r in got) == Counter((i, *brute_rules(t)) for i, t in rows)
    assert all(r["kept"] == (not r["base_failed"] and r["verdict"] == "kept") for r in got)
    assert R.quality_rules(docs()).collect() == []


def test_words_of_repeated_windows():
    words = [b"%d" % i for i in range(30)]
    assert R.repeated_words(words) == 0 and R.repeated_words(words[:8] * 2) == 16
    assert R.repeated_words(words[:7] * 2) == 0 and R.repeated_words(words[:7] * 3) == 21  # windows begin again at the eighth word
    assert R.repeated_words([b"a"] * 9) == 9 and R.repeated_words([b"a"] * 8) == 0
    assert R.repeated_words([*words, *words[3:10], b"x"]) == 0 and R.repeated_words([*words, *words[3:11]]) == 16
    for window in (1, 2, 3, 5, 8, 13):
        some = [random.Random(window).choice([b"a", b"b"]) for _ in range(200)]
        seen = Counter(tuple(some[i : i + window]) for i in range(201 - window))
        want = {i + k for i in range(201 - window) if seen[tuple(some[i : i + window])] > 1 for k in range(window)}
        assert R.repeated_words(some, window) == len(want)


def prose(n, seed=4):
    rng = random.Random(seed)
    syllables = ["".join(p) for p in zip("thaneronreinsted", "eaoiuyeaoiuyeaoi", strict=True)] + ["tion", "and", "ing", "st"]
    lexicon = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(3000)]
    return " ".join(rng.choices(lexicon, k=n))


@pytest.mark.parametrize("n", [30, 100, 400, 2000, 20000])
def test_bands_keep_prose_and_reject_the_rest(n):
    packer = zstandard.ZstdCompressor(level=R.LEVEL)
    text = prose(n).encode()
    noise = base64.b85encode(random.Random(1).randbytes(len(text)))
    verdict = lambda data: R.compression(data, packer)[2]
    assert verdict(text) == "kept"
    if n >= 100:
        assert verdict(noise) == "incompressible"
        assert verdict(b" ".join([b"one of some words that come again and again"] * (len(text) // 40))) == "repetitive"
    if n >= 2000:  # in band as a whole, but half of it is noise, or half of it one line
        assert verdict(text + noise[: len(text) // 2]) == "chunks"
        assert verdict(text + b"word " * (len(text) // 10)) == "chunks"
        assert verdict(text + noise[: len(text) // 8]) == "kept"


def test_labelled_good_documents_stay(spark):
    """On the driver's small tables, nothing labelled good is rejected by compression, and most of what it rejects is labelled bad."""
    from pathlib import Path

    data = "/root/testdata/sf0.01"
    if not Path(data).exists():
        pytest.skip("the driver's tables are not here")
    got = Q.op13_quality_rules(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id")
    out = {(r["quality"], r["verdict"] == "kept"): r["n"] for r in got.where("n_words >= 20").groupBy("quality", "verdict").agg(F.count("*").alias("n")).collect()}
    assert (1, False) not in out and out[0, False] > 0
