"""Trained filters: gradients against differences, held-out accuracy, and odd rows."""

from __future__ import annotations

import random
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language as L
from tidemark.llm import lm as M
from tidemark.llm import quality as Q
from tidemark.llm import toxicity as X
from tidemark.llm.scratch import Scratch
from tidemark.llm.training import Adam, InPlaceAdam, class_sample, fold, labelled_sample
from tidemark.llm.words import string_bytes

ODD = [(900, None), (901, ""), (902, " \n"), (903, "12 %% 34"), (None, "the end of it"), (904, "a " * 60_000), (0, "again and again")]
LABELS = "doc_id long, quality int, toxic int"


def _gradients_hold(params, loss_and_grads, places):
    _, grads = loss_and_grads(params)
    for name, at in places:
        was, step = params[name][at], 1e-5
        params[name][at] = was + step
        up = loss_and_grads(params)[0]
        params[name][at] = was - step
        down = loss_and_grads(params)[0]
        params[name][at] = was
        assert (up - down) / (2 * step) == pytest.approx(grads[name][at], abs=1e-7)


def test_gru_gradients():
    rng = np.random.default_rng(0)
    batch = rng.integers(0, 256, (5, 7)).astype(np.int16)
    batch[0, 4:] = 256
    label = rng.integers(0, 3, 5)
    p = L.new_params(3, 4, rng, np.float64)
    places = [(f"x{s}", (int(batch[1, 2]), j)) for s in "fb" for j in range(12)] + [(f"u{s}", (1, j)) for s in "fb" for j in range(12)] + [("wf", (2, 1)), ("wb", (3, 2)), ("b", (0,))]
    _gradients_hold(p, lambda q: L.loss_and_grads(q, batch, label), places)


def test_window_network_gradients():
    rng = np.random.default_rng(0)
    around, target = rng.integers(0, 1025, (9, 4)), np.concatenate([rng.integers(0, M.FREQUENT, 4), M.FREQUENT + rng.integers(0, M.CODES, 5)])
    p = M.new_params(rng, 5, np.float64)
    logs = rng.normal(0, 1, (M.SECOND, M.RARE)), rng.normal(0, 1, (M.THIRD, M.RARE * M.SECOND))
    g = int(target[0]) // M.GROUP
    places = [("t", (k, int(around[2, k]), 1)) for k in range(4)] + [("b", (1,)), ("g", (1, g)), ("gb", (g,)), ("s", (g, 2, 3)), ("sb", (g, 4))]
    first, _, second, third = (int(x[0]) for x in M._digits(target[8:]))
    places += [("t", (k, int(around[8, k]), 1)) for k in range(4)] + [("e", (first, 2)), ("u", (1, second)), ("d", (second, 3)), ("v", (4, third))]
    _gradients_hold(p, lambda q: M.loss_and_grads(q, logs, around, target), places)
    assert M.log_probs(p, logs, around, target).mean() == pytest.approx(-M.loss_and_grads(p, logs, around, target)[0])


def test_steps_in_place_equal_plain_ones():
    """Steps of the window network's optimiser make no temporary arrays and move what the plain one's move."""
    rng = np.random.default_rng(0)
    one, other = ({"a": np.ones((300, 40), np.float32), "b": np.zeros(7, np.float32)} for _ in range(2))
    plain, lean = Adam(one, 0.01), InPlaceAdam(other, 0.01)
    for _ in range(20):
        grads = {k: rng.normal(0, 1, v.shape).astype(v.dtype) for k, v in one.items()}
        plain.step(grads)
        tracemalloc.start()
        lean.step(grads)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < one["a"].nbytes / 4
    assert all(np.allclose(one[k], other[k], atol=1e-5) and other[k].dtype == np.float32 for k in one)


def test_symbols_of_words_equal_a_search():
    """A frequent word's symbol is found also where words share their first bits, or are the least or the largest hash."""
    rng = np.random.default_rng(1)
    words = np.unique(np.concatenate([rng.integers(0, most, 400, dtype=np.uint64) for most in (1 << 20, 2**64 - 1)] + [np.array([0, 2**64 - 1], np.uint64)]))
    asked = np.concatenate([words, words + np.uint64(1), rng.integers(0, 2**64 - 1, 999, dtype=np.uint64)])
    known = {w: i for i, w in enumerate(words.tolist())}
    got = M.Vocabulary(words, np.arange(len(words)), *(np.zeros(0),) * 3).ids(asked)
    assert got.tolist() == [known.get(w, M.FREQUENT + w % M.CODES) for w in asked.tolist()]


def test_codes_of_a_context_sum_to_one():
    """Over all codes, whatever the neighbours, probabilities sum to one, and neighbours move each digit."""
    rng = np.random.default_rng(3)
    p = M.new_params(rng, 5, np.float64)
    logs = rng.normal(0, 1, (M.SECOND, M.RARE)), rng.normal(0, 1, (M.THIRD, M.RARE * M.SECOND))
    ids = np.arange(M.FREQUENT + M.CODES)
    one, other = (M.log_probs(p, logs, np.tile(np.array(c), (len(ids), 1)), ids) for c in ([5, 6, 7, 8], [5, 900, 7, 1000]))
    assert np.exp(one).sum() == pytest.approx(1) and np.exp(other).sum() == pytest.approx(1)
    moved = (one - other)[M.FREQUENT :].reshape(M.RARE, M.SECOND, M.THIRD)
    assert all(np.ptp(moved, axis=k).min() > 0 for k in (1, 2))


def test_neighbours_move_rare_words(spark, docs):
    """Of two rare words each is likelier between the neighbours that it was met with; all else in the texts is alike."""
    rng = random.Random(8)
    filler = [f"f{i}" for i in range(M.FREQUENT)]
    rare = [f"r{i}" for i in range(40)]
    text = lambda i, j: f"left{j} side{j} {rare[i]} right{j} end{j}"
    rows = [text(i, i % 2) for i in range(40) for _ in range(30)] + [" ".join(rng.sample(filler, 200)) for _ in range(200)]
    asked = [text(i, j) for i in range(40) for j in (0, 1)]
    got = {r["doc_id"]: r["log_likelihood"] for r in M.score_documents(docs(*asked, *rows)).collect()}
    assert sum(got[2 * i + i % 2] > got[2 * i + 1 - i % 2] for i in range(40)) >= 36


def test_noisy_or_of_sentences():
    """A document's score is one less the product of its sentences' clean probabilities, each from its own words."""
    model = X.train([(f"fine words here. {'vile' if i % 2 else 'good'} thing number {i % 7}.", i % 2) for i in range(80)])
    texts = ["fine. vile vile! good\nfine words", "vile"]
    data, offsets = string_bytes(pa.array(texts))
    z, per_row, starts = X.sentence_logits(model, data, offsets)
    assert per_row.tolist() == [4, 1] and starts.tolist()[:2] == [0, 6]
    clean = 1 - 1 / (1 + np.exp(-z))
    for (a, b), text in zip(((0, 4), (4, 5)), texts, strict=True):
        d, o = string_bytes(pa.array([text]))
        own = X.sentence_logits(model, d, o)[0]
        assert own == pytest.approx(z[a:b]) and -np.expm1(-X._softplus(own).sum()) == pytest.approx(1 - np.prod(clean[a:b]))


def _corpus(n=400):
    """Texts of two languages; some toxic, some of low quality."""
    rng = random.Random(3)
    words = {"en": "the and of ing with that hous wat".split(), "de": "der und für nicht über schön wäs".split()}
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        w = [rng.choice(words[lang]) + rng.choice(["", "a", "er", "st"]) for _ in range(rng.randrange(20, 80))]
        toxic, low = i % 5 == 1, i % 6 == 2
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["vileword", "Nastyword."])
        text = " ".join(x + ("." if rng.random() < 0.15 else "") for x in w)
        if low:
            text = " | ".join(text.split()) if i % 4 else text.upper().replace(" ", "!! ")
        rows.append((i, text, lang, f"s{i % 3}"))
        labels.append((i, int(not low), int(toxic)))
    return rows, labels


def test_toxicity(spark, docs):
    rows, labels = _corpus()
    known = spark.createDataFrame([*labels, (None, 1, 1), (5000, None, None), (0, 1, None)], LABELS)
    got = {r["doc_id"]: r for r in X.toxicity(docs(*rows, *ODD[:5]), known).collect()}
    held = [(i, t) for i, _, t in labels if got[i]["held_out"]]
    assert len(held) > 40 and np.mean([got[i]["predicted"] == t for i, t in held]) > 0.97
    hit = next(got[i] for i, t in held if t and got[i]["predicted"])
    assert any("vileword" in s["text"].lower() or "nastyword" in s["text"].lower() for s in hit["offending"])
    assert all(not got[i]["offending"] for i, t in held if not got[i]["predicted"])
    assert got[900]["score"] == got[901]["score"] == got[902]["score"] == 0 and not got[None]["held_out"] and all(0 <= r["score"] <= 1 for r in got.values())


def test_quality(spark, docs):
    rows, labels = _corpus()
    got = {r["doc_id"]: r for r in Q.quality(docs(*rows, *ODD[:5]), spark.createDataFrame(labels, LABELS)).collect()}
    held = [(i, q) for i, q, _ in labels if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == q for i, q in held]) > 0.97
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.values()) and got[900]["score"] == got[901]["score"]


def test_toxicity_equals_brute_force(spark, docs):
    """Scores from the fitted words alone: sentences by their distinct words, a document clean if all its sentences are."""
    rows, labels = _corpus()
    given, known = docs(*rows, *ODD[:5]), spark.createDataFrame(labels, LABELS)
    model = X.fit(given, known, fold("doc_id", 5) == 0)
    weight = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
    hashed = lambda w: int(X.placed_words(*string_bytes(pa.array([w])), X._IN_WORD)[0][0])
    got = {r["doc_id"]: r for r in X.toxicity(given, known).collect()}
    for i, text, *_ in [*rows[:150], *ODD[:4]]:
        clean = 1.0
        for sentence in re.split(r"[.!?\n]", text or ""):
            if words := set(re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", sentence)):
                logit = model.bias + sum(weight.get(h, 0) for h in {hashed(w) for w in words})
                clean *= 1 / (1 + np.exp(logit))
        assert got[i]["score"] == pytest.approx(1 - clean, abs=1e-9) and got[i]["predicted"] == (1 - clean >= 0.5)


def test_toxicity_settings_are_chosen_on_learning_rows():
    rows, labels = _corpus(200)
    sample = [(t, y) for (_, t, *_), (_, _, y) in zip(rows, labels, strict=True)]
    poor = X.Setting(sparsity=1e6)
    assert X.choose(sample, [poor, X.Setting()]) == X.Setting() and X.choose(sample, [poor]) == poor


def test_quality_keeps_no_shuffles(spark, monkeypatch):
    """The shuffled texts of the join are gone when the replicas are fitted, and the session is as it was."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {name for name in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in name}
    given = spark.range(400).selectExpr("id as doc_id", "concat(if(id % 3 = 0, 'a low one ', 'some high text '), id) as text").repartition(3)
    known = spark.range(400).selectExpr("id as doc_id", "int(id % 3 > 0) as quality")
    old, keep, left = files(), Scratch.keep, []

    def watched(self, df, name):
        kept = keep(self, df, name)
        if name == "learnt":
            for _ in range(50):  # they are removed in the background
                if not (found := files() - old):
                    break
                time.sleep(0.1)
            left.append(found)
        return kept

    monkeypatch.setattr(Scratch, "keep", watched)
    Q.fit(given, known, fold("doc_id", 5) == 0)
    assert left == [set()] and spark.conf.get(key) == before


def test_quality_equals_brute_force(spark, docs):
    """Scores from the fitted weights alone: byte kinds, repetition and the mean weight of words and pairs."""
    rows, labels = _corpus()
    given, known = docs(*rows, *ODD[:5]), spark.createDataFrame(labels, LABELS)
    model = Q.fit(given, known, fold("doc_id", 5) == 0)
    got = {r["doc_id"]: r for r in Q.quality(given, known).collect()}
    for i, text, *_ in [*rows[:60], *ODD[:4]]:
        raw = (text or "").encode()
        n, words = max(len(raw), 1), [w for w in re.split(rb"[\x20\x09-\x0D]+", raw.lower()) if w]
        hashes = [int(Q.word_hashes(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0]) for w in words]
        hashed = np.array(hashes, np.uint64)
        pairs = [int(Q.shingles(hashed[j : j + 2], np.array([2]), 2)[0][0]) for j in range(len(words) - 1)]
        if len(words) == 1:
            pairs = [int(Q.shingles(hashed, np.array([1]), 2)[0][0])]
        m = max(len(words), 1)
        shape = [
            sum(a == b for a, b in zip(words, words[1:], strict=False)) / m,
            1 - len(set(words)) / m,
            1 - len(set(pairs)) / max(len(pairs), 1),
            np.log1p(len(words)) / 10,
            min(n / m, 40) / 10,
            float(not words),
        ]
        base = np.array([sum(Q._KIND[c] == k for c in raw) / n for k in range(len(Q._KINDS))] + shape)
        dense = np.concatenate([base, base / (base + 0.02), base / (base + 0.2)])
        grams = [model.grams[h % Q.BUCKETS] for h in hashes + pairs]
        score = ((dense - model.mean) / model.spread) @ model.weights + (np.mean(grams) if grams else 0)
        want = 1 / (1 + np.exp(-(model.slope * (score - model.edge) + np.log(0.3 / 0.7))))
        assert got[i]["score"] == pytest.approx(want, abs=1e-9)


def test_quality_learns_from_all(spark, docs):
    """A mark of few of many labelled documents counts, in parts as in one; the edge is the quantile of all scores."""
    rng = np.random.default_rng(3)
    said = lambda i: " ".join(rng.choice(list("abcdefghij"), 12)) + (" bad" * 3 if i % 4 == 0 else "")
    rows = [(i, said(i)) for i in range(6000)]
    given, known = docs(*rows), spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(6000)], LABELS)
    assert not hasattr(Q, "labelled_sample")
    learnt = given.join(known.select("doc_id", "quality"), "doc_id").where(fold("doc_id", 5) != 0)
    for part in (Q.PART, 500):
        model = Q.fit(given, known, fold("doc_id", 5) == 0, part)
        score = Q.scorer(model, 0.3)("text")
        below = learnt.select(score.alias("s"), "quality").agg(F.count(F.when(F.col("s") < 0.3 - 1e-9, 1)), F.count(F.when(F.col("s") <= 0.3 + 1e-9, 1)), F.count(F.when(F.col("quality") == 0, 1))).first()
        assert below[0] < below[2] <= below[1]
        held = Q.quality(given, known, part=part).where("held_out").select("doc_id", "score").collect()
        assert max(r["score"] for r in held if r["doc_id"] % 4 == 0) < min(r["score"] for r in held if r["doc_id"] % 4)


def test_quality_repeats_a_rare_label(spark, docs):
    """Few documents of one label meet all parts of the other."""
    rows = [(i, ("bad word " if i % 100 == 0 else "good word ") + "x" * (i % 7)) for i in range(3000)]
    known = spark.createDataFrame([(i, int(i % 100 > 0), 0) for i in range(3000)], LABELS)
    got = Q.quality(docs(*rows), known, part=100).where("held_out").select("doc_id", "score").collect()
    assert max(r["score"] for r in got if r["doc_id"] % 100 == 0) < min(r["score"] for r in got if r["doc_id"] % 100)


def test_quality_sees_words(spark, docs):
    """Documents alike in all shares, told by their words."""
    rng = random.Random(1)
    rows = [(i, " ".join(f"{'abcd'[rng.randrange(2) + 2 * (i % 2)]}{rng.choice('xyz')}lm" for _ in range(30))) for i in range(300)]
    got = Q.quality(docs(*rows), spark.createDataFrame([(i, i % 2, 0) for i in range(300)], LABELS)).where("held_out").collect()
    assert len(got) > 30 and np.mean([r["predicted"] == r["doc_id"] % 2 for r in got]) > 0.95


def test_samples_are_bounded_by_row_and_byte(spark, docs):
    """A doc_id that is repeated is drawn once, whatever its texts; texts above the bound are not drawn."""
    rows = [(1, f"copy {i % 3}") for i in range(500)] + [(2, "a " * (1 << 20)), (3, "c")]
    known = spark.createDataFrame([(i, 1, 1) for i in (1, 2, 3)], LABELS)
    assert sorted(labelled_sample(docs(*rows), known, "toxic", F.lit(False), 20)) == [("c", 1), ("copy 0", 1)]


def test_language(spark, docs):
    rows, _ = _corpus()
    got = {r["doc_id"]: r for r in L.identify(docs(*rows, *ODD[:5], (905, "ж"))).collect()}
    held = [r for r in rows if got[r[0]]["held_out"]]
    assert len(held) > 60 and np.mean([got[i]["lang_pred"] == lang for i, _, lang, _ in held]) > 0.95
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902, 903)) and got[905]["lang_pred"] in ("en", "de")
    assert not got[None]["held_out"]


def test_language_of_none():
    """Texts of no learned language are told from those of one."""
    rows, _ = _corpus()
    model = L.train([(t, lang) for _, t, lang, _ in rows[:300]])
    rng = random.Random(2)
    noise = ["".join(rng.choice(letters + "  ") for _ in range(200)) for letters in ("абвгдежз", "qwxzjkvbpy", "0a1b2c3d9f", "的一是不了人") for _ in range(5)]
    _, _, none = L.predict(model, pa.array(noise + [t for _, t, *_ in rows[300:]]))
    assert (none[:20] > model.most_none).all() and (none[20:] <= model.most_none).all() and model.most_none >= 0.5


def test_language_positions_see_both_sides():
    p = L.new_params(2, 4, np.random.default_rng(1))
    a, b, c = (np.array([[*s.encode()]], np.int16) for s in ("abcd", "xbcd", "abcx"))
    base = L.position_logits(p, a)
    assert not np.allclose(base[3], L.position_logits(p, b)[3]) and not np.allclose(base[0], L.position_logits(p, c)[0])


def test_document_probabilities_are_means_over_windows():
    model = L.LanguageModel(L.new_params(3, 4, np.random.default_rng(1)), ["a", "b"])
    text = b"x" * 70 + b"yz"
    data = np.frombuffer(text, np.uint8)
    grid, _ = L.windows(data, np.array([0, 72]))
    prob = np.concatenate([L._softmax(L.position_logits(model.params, grid[i : i + 1]))[:, 0] for i in range(2)])[:72]
    got = L.document_probabilities(model, np.concatenate([data, data]), np.array([0, 72, 72, 144]))
    assert got[0] == pytest.approx(prob.mean(axis=0), abs=1e-5) and got[2] == pytest.approx(got[0]) and got[1].sum() == 0


def test_lm_scores(spark, docs):
    rng = random.Random(1)
    cycle = "one two three four five six seven".split()
    rows = [(i, " ".join(cycle[(i + j) % 7] for j in range(60))) for i in range(150)]
    shuffled = (800, " ".join(rng.choice(cycle) for _ in range(60)))
    got = {r["doc_id"]: r for r in M.score_documents(docs(*rows, shuffled, *ODD[:5])).collect()}
    assert got[3]["mean_log_prob"] > got[800]["mean_log_prob"] + 1 and got[3]["n_tokens"] == 60
    assert got[3]["perplexity"] == pytest.approx(np.exp(-got[3]["mean_log_prob"])) and got[3]["log_likelihood"] == pytest.approx(60 * got[3]["mean_log_prob"])
    assert got[900]["n_tokens"] == got[902]["n_tokens"] == 0 and got[900]["log_likelihood"] == 0 and got[901]["perplexity"] is None and got[903]["n_tokens"] == 2


def test_word_counts_cover_all_texts(spark, docs):
    got = M.count_words(docs("a b a", "B c", None, "", "b.b"))
    assert sorted(r["n"] for r in got.collect()) == [1, 2, 4]
    vocab = M.vocabulary(got)
    assert len(vocab.words) == 3 and np.exp(vocab.unigram).sum() == pytest.approx(1)


def test_lm_fit_meets_every_text(spark, docs):
    """Each frequent word is in one text only, and its embedding moves from where it was drawn, whichever texts a replica has."""
    rows = [(i, f"w{i} " * 3 + "x " * 12) for i in range(900)] + [(i, "y " * 12) for i in range(900, 3000)]
    given = docs(*rows)
    counts = M.count_words(given)
    vocab, tokens = M.vocabulary(counts), 900 * 15 + 2100 * 12
    assert tokens // (M.ROUNDS * M.BATCH) > 1
    p, drawn = M.train(given, vocab, tokens, Scratch(spark, "lm"), steps=1), M.new_params(np.random.default_rng(9))
    moved = (p["t"] != drawn["t"]).any(axis=2)
    assert moved[:, vocab.symbol].all()
    again = M.train(given.repartition(7), vocab, tokens, Scratch(spark, "lm"), steps=1)
    assert all(np.allclose(p[k], again[k], atol=1e-5) for k in p)


def _by_hand(text, texts, p, frequent):
    """(tokens, log likelihood) of a document among texts, word by word from the definition; ``frequent`` gives the symbols of frequent words."""
    split = lambda t: re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", t or "")
    low = lambda w: re.sub("[A-Z]", lambda m: m[0].lower(), w)
    hashed = lambda w: int(M.placed_words(*string_bytes(pa.array([w])), M._IN_WORD)[0][0])
    everything = Counter(low(w) for t in texts for w in split(t))
    own = [low(w) for w in split(text)]
    digits = lambda w: (hashed(w) // 512 % 64, hashed(w) // 16 % 32, hashed(w) % 16)
    symbol = lambda w: frequent.get(hashed(w), M.SYMBOLS - M.RARE + digits(w)[0])
    of_symbol, mass, types, ours = Counter(), Counter(), Counter(), Counter()
    for w, n in everything.items():
        of_symbol[symbol(w)] += n
        if hashed(w) not in frequent:
            mass[digits(w)] += n
            types[digits(w)] += 1
            for k in (1, 2, 3):
                ours[digits(w)[:k]] += own.count(w)
    weight = lambda d: mass[d] + M.UNSEEN * max(1, types[d])
    total = sum(of_symbol.values()) + M.SYMBOLS
    s, log_likelihood = [symbol(w) for w in own], 0.0
    for i, w in enumerate(own):
        h = p["b"].astype(float)
        for k, d in enumerate(M.SIDES):
            h = h + p["t"][k][s[i + d] if 0 <= i + d < len(s) else M.SYMBOLS]
        h = np.tanh(h)
        g, j = divmod(s[i], M.GROUP)
        soft = lambda x: np.exp(x) / np.exp(x).sum()
        net = soft(h @ p["g"] + p["gb"])[g] * soft(h @ p["s"][g] + p["sb"][g])[j]
        counted = (1 + of_symbol[s[i]]) / total
        if hashed(w) not in frequent:
            a, b, c = digits(w)
            second = np.array([sum(weight((a, x, y)) for y in range(16)) for x in range(32)])
            third = np.array([weight((a, b, y)) for y in range(16)])
            whole = second.sum() - ours[a,]
            second[b] -= ours[a, b]
            third[c] -= ours[a, b, c]
            h = h * p["e"][a]
            tilt = lambda x, of: of * np.exp(x) / (of * np.exp(x)).sum()
            net *= tilt(h @ p["u"], second)[b] * tilt(h * p["d"][b] @ p["v"], third)[c]
            counted *= third[c] / whole
            log_likelihood += np.log((everything[w] - own.count(w) + M.UNSEEN) / third[c])
        log_likelihood += np.log((1 - M.SMOOTH) * net + M.SMOOTH * counted)
    return len(own), log_likelihood


def test_lm_scores_equal_brute_force(spark, docs):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("the of and".split()) if rng.random() < 0.4 else f"w{int(3000 * rng.random() ** 2)}" for _ in range(rng.choice([1, 9, 60]))) for _ in range(150)]
    texts += [texts[5], texts[5], None, "", "?!", "É é\tA-b 12", "zz " * 40]
    given = docs(*texts)
    counts = M.count_words(given)
    vocab, tokens = M.vocabulary(counts), counts.agg(F.sum("n")).first()[0]
    p = M.train(given, vocab, tokens, Scratch(spark, "lm"))
    frequent = dict(zip(vocab.words.tolist(), vocab.symbol.tolist(), strict=True))
    assert len(frequent) == M.SYMBOLS - M.RARE and vocab.types.sum() > 100
    got = {r["doc_id"]: r for r in M.score_documents(given).collect()}
    for i in [*range(0, 150, 10), 5, *range(150, len(texts))]:
        n, log_likelihood = _by_hand(texts[i], texts, p, frequent)
        assert got[i]["n_tokens"] == n and got[i]["log_likelihood"] == pytest.approx(log_likelihood, abs=1e-3 * max(1, n))


def test_lm_tells_texts_that_occur_twice(spark, docs):
    """Of texts alike in all else, those whose words another document has too are likelier."""
    rng = random.Random(6)
    new = lambda i: " ".join(rng.choice("the of and".split()) if j % 2 else f"u{i}x{rng.randrange(10**6)}" for j in range(50))
    texts = [new(i) for i in range(200)]
    got = {r["doc_id"]: r["mean_log_prob"] for r in M.score_documents(docs(*texts, *texts[:20])).collect()}
    assert min(got[i] for i in [*range(20), *range(200, 220)]) > max(got[i] for i in range(20, 200))


def test_contexts_stop_at_rows():
    around = M.contexts(np.array([1, 2, 3, 4, 5]), np.array([3, 0, 2]))
    out = M.SYMBOLS
    assert around.tolist() == [[out, out, 2, 3], [out, 1, 3, out], [1, 2, out, out], [out, out, 5, out], [out, 4, out, out]]


@pytest.mark.parametrize("operator", ["toxicity", "quality", "language", "lm"])
def test_odd_rows_empty_tables_and_no_labels(spark, docs, operator):
    none = spark.createDataFrame([], LABELS)
    run = {"toxicity": lambda d: X.toxicity(d, none), "quality": lambda d: Q.quality(d, none), "language": L.identify, "lm": M.score_documents}[operator]
    assert run(docs("a").limit(0)).count() == 0
    got = run(docs(*ODD, ODD[5], ODD[5])).collect()
    assert len(got) == len(ODD) + 2 and all(r["score"] is not None for r in got if "score" in r)


def test_samples_are_bounded_and_held_out(spark, docs):
    rows, labels = _corpus()
    known = spark.createDataFrame(labels, LABELS)
    held = fold("doc_id", 5) == 0
    sample = labelled_sample(docs(*rows), known, "toxic", held, 20)
    assert all(5 < sum(y == v for _, y in sample) <= 20 for v in (0, 1))
    import zlib

    texts = {t for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert not texts & {t for t, _ in sample}
    assert {y for _, y in class_sample(docs(*rows), "lang", F.lit(False), 5)} == {"en", "de"}
