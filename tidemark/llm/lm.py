"""Language-model scores by masked pseudo-likelihood.

Every token is predicted from the tokens on both of its sides by a small window network, trained in numpy; the sum of the log
conditional probabilities scores a document. The network is fitted to all texts, in replicas that are averaged. It predicts codes: a
frequent word is a symbol of its own; every other word has three digits of its hash, the first of which is a symbol too. Each digit is
predicted from both sides given those before it, as a change to what the counts of the corpus say of that digit. Words that share
all digits divide their code's probability by their counts. In scores, counts within a class are those outside of the document (the
fit, and the unigram of symbols, know all), so that every word of the corpus has a probability of its own and its neighbours move it.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch
from tidemark.llm.training import InPlaceAdam, summed
from tidemark.llm.words import chunks, placed_words, separators, string_bytes

#: Symbols: the FREQUENT words, then RARE classes of all others; GROUP symbols share a branch of the two-level softmax.
SYMBOLS, RARE, GROUP, HIDDEN = 1024, 64, 32, 32
FREQUENT = SYMBOLS - RARE
#: The second and third digit of a rare word's code, of a class and of both: a code has RARE * SECOND * THIRD values, which are powers of two.
SECOND, THIRD = 32, 16
CODES = RARE * SECOND * THIRD
SIDES = (-2, -1, 1, 2)
#: Rounds of the fit, batches of a replica in a round, tokens of a batch, and the weight of the unigram in every prediction.
ROUNDS, STEPS, BATCH, SMOOTH = 4, 100, 4096, 0.05
#: What is added to the count of every rare word, so that words of one document only can be told from impossible ones.
UNSEEN = 0.1
#: Bytes of texts that are coded or scored at once.
AT_ONCE = 1 << 20
_IN_WORD = separators(string.ascii_letters.encode() + string.digits.encode() + bytes(range(128, 256)))


@dataclass
class Vocabulary:
    """words: sorted hashes of the frequent words, symbol: theirs, unigram: log probability by symbol; of each code the
    number of its tokens (mass) and of its distinct words (types)."""

    words: np.ndarray
    symbol: np.ndarray
    unigram: np.ndarray
    mass: np.ndarray
    types: np.ndarray

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """A frequent word's symbol, or FREQUENT and up by the code of a rare one."""
        rare = FREQUENT + (hashes % np.uint64(CODES)).astype(np.int64)
        if not len(self.words):
            return rare
        starts, most = self._starts
        at = np.take(starts, hashes >> np.uint64(48))
        for _ in range(most - 1):
            at = np.minimum(at + (np.take(self.words, at) < hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.symbol[at], rare)

    @cached_property
    def _starts(self) -> tuple[np.ndarray, int]:
        """Where words with each 16 first bits begin, and how many have the same at most."""
        starts = np.searchsorted(self.words, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48))
        most = np.diff(starts, append=len(self.words)).max()
        return np.minimum(starts, len(self.words) - 1).astype(np.int16), int(most)

    def digit_logs(self) -> tuple[np.ndarray, np.ndarray]:
        """The log weights of second digits by class, and of third ones by class and second digit; a digit in a row each."""
        weight = weights(self.mass, self.types).reshape(RARE * SECOND, THIRD)
        return tuple(np.ascontiguousarray(np.log(w).T.astype(np.float32)) for w in (weight.sum(axis=1).reshape(RARE, SECOND), weight))


def weights(mass: np.ndarray, types: np.ndarray) -> np.ndarray:
    """What words with these counts weigh together."""
    return np.maximum(mass, 0) + UNSEEN * np.maximum(types, 1)


def symbol_of(ids: np.ndarray) -> np.ndarray:
    return np.where(ids < FREQUENT, ids, FREQUENT + (ids - FREQUENT) // (SECOND * THIRD))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = string_bytes(batch.column(0))
        found = [placed_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], _IN_WORD)[0] for a, b in chunks(offsets, AT_ONCE)]
        words, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts, pa.int64())], ["word", "n"])


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): the hash and count of every word of all texts."""
    return docs.select("text").mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The most frequent words by count, ties by hash, and what the classes of the others hold. Its size is fixed."""
    top = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    words = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(words)
    mass, types = np.zeros(CODES), np.zeros(CODES)
    # of the unsigned hash: CODES divides 2**64, so a signed remainder is the same
    for r in counts.groupBy(F.pmod("word", F.lit(CODES)).alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect():
        mass[r["k"]], types[r["k"]] = r["n"], r["types"]
    for r in top:
        mass[r["word"] % CODES] -= r["n"]
        types[r["word"] % CODES] -= 1
    total = np.ones(SYMBOLS)
    total[: len(top)] += [r["n"] for r in top]
    total[FREQUENT:] += mass.reshape(RARE, -1).sum(axis=1)
    return Vocabulary(words[order], np.arange(len(words))[order], np.log(total / total.sum()), mass, types)


def contexts(symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(tokens, sides): the symbols around each token; SYMBOLS stands for outside of the text."""
    ends = np.cumsum(counts)
    starts = ends - counts
    place = np.arange(len(symbols))
    lo, hi = np.repeat(starts, counts), np.repeat(ends, counts)
    out = np.empty((len(symbols), len(SIDES)), np.uint16)
    for k, d in enumerate(SIDES):
        at = place + d
        ok = (at >= lo) & (at < hi)
        out[:, k] = np.where(ok, symbols[np.where(ok, at, 0)], SYMBOLS)
    return out


def new_params(rng: np.random.Generator, hidden: int = HIDDEN, kind=np.float32) -> dict[str, np.ndarray]:
    groups = SYMBOLS // GROUP
    return {
        "t": rng.normal(0, 0.1, (len(SIDES), SYMBOLS + 1, hidden)).astype(kind),
        "b": np.zeros(hidden, kind),
        "g": rng.normal(0, 0.1, (hidden, groups)).astype(kind),
        "gb": np.zeros(groups, kind),
        "s": rng.normal(0, 0.1, (groups, hidden, GROUP)).astype(kind),
        "sb": np.zeros((groups, GROUP), kind),
        "e": rng.normal(1, 0.1, (RARE, hidden)).astype(kind),
        "u": rng.normal(0, 0.1, (hidden, SECOND)).astype(kind),
        "d": rng.normal(1, 0.1, (SECOND, hidden)).astype(kind),
        "v": rng.normal(0, 0.1, (hidden, THIRD)).astype(kind),
    }


def _softmax(x: np.ndarray, n: int) -> np.ndarray:
    """A softmax over ``n``, in place, down the columns, which numpy does faster than along short rows."""
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x *= 1 / (n * x.sum(axis=0))
    return x


def _branch_scores(p: dict[str, np.ndarray], h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The scores of the symbols of each token's branch, a column a token; ``bounds`` has where the tokens of each branch begin and end."""
    out = np.repeat(p["sb"].T, np.diff(bounds), axis=1)
    for k in np.flatnonzero(np.diff(bounds)):
        a, b = bounds[k], bounds[k + 1]
        out[:, a:b] += p["s"][k].T @ h[a:b].T
    return out


def _cells(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where one place of each column is in the flat array."""
    return at * x.shape[1] + np.arange(x.shape[1])


def _log_at(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log softmax of each column at one place."""
    x -= x.max(axis=0)
    picked = np.take(x, _cells(x, at))
    return picked - np.log(np.exp(x, out=x).sum(axis=0))


def _hidden(p: dict[str, np.ndarray], around: np.ndarray) -> np.ndarray:
    at = around.T.astype(np.intp)
    h = np.take(p["t"][0], at[0], axis=0)
    for k in range(1, len(SIDES)):
        h += np.take(p["t"][k], at[k], axis=0)
    h += p["b"]
    return np.tanh(h, out=h)


def _digits(ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """(class, class and second digit, second digit, third digit) of the ids of rare words."""
    node, third = np.divmod(ids - FREQUENT, THIRD)
    return node // SECOND, node, node % SECOND, third


def log_probs(p: dict[str, np.ndarray], logs: tuple, around: np.ndarray, ids: np.ndarray, outside: np.ndarray | None = None) -> np.ndarray:
    """The network's log probability of each target between its neighbours, of a rare word that of its code.

    ``logs`` are the vocabulary's ``digit_logs``; ``outside`` has, for rare targets, the log weights of their own second and third digit that
    take the place of those, as when the document's own words don't count.
    """
    target = symbol_of(ids)
    order = np.argsort((target // GROUP).astype(np.uint8), kind="stable")
    h = _hidden(p, around[order])
    group, within = np.divmod(target[order], GROUP)
    bounds = np.searchsorted(group, np.arange(SYMBOLS // GROUP + 1))
    found = _log_at(p["g"].T @ h.T + p["gb"][:, None], group)
    found += _log_at(_branch_scores(p, h, bounds), within)
    a = bounds[FREQUENT // GROUP]
    first, node, second, third = _digits(ids[order[a:]])
    rows = np.arange(len(node))
    by_second, by_third = np.take(logs[0], first, axis=1), np.take(logs[1], node, axis=1)
    if outside is not None:
        by_second[second, rows], by_third[third, rows] = outside[:, order[a:]]
    h = h[a:] * p["e"][first]
    found[a:] += _log_at(p["u"].T @ h.T + by_second, second)
    found[a:] += _log_at(p["v"].T @ (h * p["d"][second]).T + by_third, third)
    out = np.empty_like(found)
    out[order] = found
    return out


def _sum_by(values: np.ndarray, keys: np.ndarray, out: np.ndarray) -> None:
    """Set the rows of ``out`` that occur as keys to the sums of their values."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    key = np.take(keys, order)
    first = np.concatenate((np.arange(len(key) > 0), np.flatnonzero(key[1:] != key[:-1]) + 1))
    if len(first):
        values = np.take(values, order, axis=0)
        # two columns at once, as one complex number
        pairs = values if values.shape[1] % 2 else values.view(np.result_type(values, np.complex64))
        out[key[first]] = np.add.reduceat(pairs, first, axis=0).view(values.dtype)


def loss_and_grads(p: dict[str, np.ndarray], logs: tuple, around: np.ndarray, ids: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log probability and its gradient by every parameter."""
    n, target = len(ids), symbol_of(ids)
    order = np.argsort((target // GROUP).astype(np.uint8), kind="stable")
    around = np.take(around, order, axis=0)
    group, within = np.divmod(target[order], GROUP)
    h = _hidden(p, around)
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    loss = 0.0

    def missed(scores: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The gradient by scores, a column a token; the loss is added up."""
        nonlocal loss
        by, at = _softmax(scores, n), _cells(scores, at)
        picked = np.take(by, at)
        loss -= np.log(picked * n).sum()
        by.put(at, picked - 1 / n)
        return by

    by = missed(p["g"].T @ h.T + p["gb"][:, None], group)
    grads["g"], grads["gb"] = h.T @ by.T, by.sum(axis=1)
    by_h = by.T @ p["g"].T
    bounds = np.searchsorted(group, np.arange(SYMBOLS // GROUP + 1))
    by, met = missed(_branch_scores(p, h, bounds), within), np.flatnonzero(np.diff(bounds))
    grads["sb"][met] = np.add.reduceat(by, bounds[met], axis=1).T
    for k in met:
        a, b = bounds[k], bounds[k + 1]
        grads["s"][k] = h[a:b].T @ by[:, a:b].T
        by_h[a:b] += by[:, a:b].T @ p["s"][k].T
    a = bounds[FREQUENT // GROUP]
    if a < n:
        first, node, second, third = _digits(ids[order[a:]])
        e, d = p["e"][first], p["d"][second]
        h_second = h[a:] * e
        h_third = h_second * d
        by = missed(p["u"].T @ h_second.T + np.take(logs[0], first, axis=1), second)
        grads["u"], by_second = h_second.T @ by.T, by.T @ p["u"].T
        by = missed(p["v"].T @ h_third.T + np.take(logs[1], node, axis=1), third)
        grads["v"], by_third = h_third.T @ by.T, by.T @ p["v"].T
        _sum_by(by_third * h_second, second, grads["d"])
        by_second += by_third * d
        _sum_by(by_second * h[a:], first, grads["e"])
        by_h[a:] += by_second * e
    by_h *= 1 - h * h
    grads["b"] = by_h.sum(axis=0)
    for k in range(len(SIDES)):
        _sum_by(by_h, around[:, k], grads["t"][k])
    return float(loss / n), grads


def fit(p: dict[str, np.ndarray], logs: tuple, ids: np.ndarray, counts: np.ndarray, steps: int, start: float, end: float, seed: int) -> None:
    """Fit the network in place to all tokens of texts of ``counts`` tokens each, in shuffled batches: once, and again until ``steps`` are done.

    ``start`` and ``end`` place these steps in the whole fit, for the falling rate.
    """
    rng = np.random.default_rng(seed)
    around = contexts(symbol_of(ids), counts)
    adam = InPlaceAdam(p, 0.01)
    passes = -(-len(ids) // BATCH)
    steps = max(steps, passes)
    for turn in range(steps):
        if turn % passes == 0:
            order = rng.permutation(len(ids))
        adam.rate = 0.01 * (1 - start - (end - start) * turn / steps) + 0.0005
        pick = order[turn % passes * BATCH :][:BATCH]
        adam.step(loss_and_grads(p, logs, np.take(around, pick, axis=0), np.take(ids, pick))[1])


def _coded(vocab: Vocabulary, parts: int):
    """(part, key, text) -> (part, key, the ids of the text's words as bytes). Rows with one key, which are copies of a row, go to one part after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, int] = {}
        for batch in batches:
            part = batch.column(0).to_numpy().copy()
            for i, key in enumerate(batch.column(1).to_pylist()):
                turn = met[key] = met.get(key, -1) + 1
                part[i] = (part[i] + turn) % parts
            data, offsets = string_bytes(batch.column(2))
            for a, b in chunks(offsets, AT_ONCE):
                hashes, counts, _ = placed_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], _IN_WORD)
                ids = vocab.ids(hashes).astype(np.uint16)
                ends = np.concatenate(([0], np.cumsum(counts) * 2)).astype(np.int32)
                coded = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(part[a:b]), batch.column(1).slice(a, b - a), coded], ["part", "key", "ids"])

    return run


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in p.values()])


def _shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    cuts = np.cumsum([v.size for v in like.values()])[:-1]
    return {k: x.reshape(v.shape).astype(v.dtype) for (k, v), x in zip(like.items(), np.split(flat, cuts), strict=True)}


def _replica(p: dict[str, np.ndarray], logs: tuple, steps: int, start: float, end: float):
    """A part of the texts -> (its tokens, the parameters fitted to it, times its tokens)."""

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("key", "ascending"), ("ids", "ascending")])
        coded = part["ids"].to_pylist()
        ids = np.frombuffer(b"".join(coded), np.uint16).astype(np.int64)
        own = {k: v.copy() for k, v in p.items()}
        fit(own, logs, ids, np.array([len(x) // 2 for x in coded]), steps, start, end, 9 + part["part"][0].as_py())
        return pa.table({"n": pa.array([len(ids)], pa.int64()), "sums": pa.array([(_flat(own).astype(float) * len(ids)).tobytes()], pa.binary())})

    return run


def train(docs: DataFrame, vocab: Vocabulary, tokens: int, scratch: Scratch, *, steps: int = STEPS, seed: int = 9) -> dict[str, np.ndarray]:
    """The window network fitted to every token of ``docs``. Without tokens it stays as drawn.

    Texts are dealt by a hash of doc_id and text into parts of about ``steps`` batches. In each round replicas are fitted to a part each, in
    parallel, from the mean of the last round's, weighted by tokens; each part is met in one round. A corpus that is too small for
    that is one part, met as often as makes the same number of steps. Sums of parameters are added up in two steps before they meet the driver.
    """
    p = new_params(np.random.default_rng(seed))
    if not tokens:
        return p
    logs = vocab.digit_logs()
    replicas = tokens // (ROUNDS * steps * BATCH)
    rounds, steps = (ROUNDS, steps) if replicas > 1 else (1, ROUNDS * steps)
    replicas = max(1, replicas)
    key = F.xxhash64("doc_id", "text", F.lit(17))
    dealt = docs.where(F.col("text").isNotNull()).select(F.pmod(key, F.lit(rounds * replicas)).cast("int").alias("part"), key.alias("key"), "text")
    coded = dealt.mapInArrow(_coded(vocab, rounds * replicas), "part int, key long, ids binary").where(F.length("ids") > 0)
    coded = scratch.keep(coded, "ids")
    tasks = min(replicas, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    for turn in range(rounds):
        # by number, so that small parts are not put together into few tasks
        parts = coded.where(F.col("part") % rounds == turn).repartition(tasks, "part").groupBy("part")
        fitted = parts.applyInArrow(_replica(p, logs, steps, turn / rounds, (turn + 1) / rounds), "n long, sums binary").mapInArrow(summed, "n long, sums binary")
        sums = fitted.repartition(math.isqrt(tasks)).mapInArrow(summed, "n long, sums binary").collect()
        if sums:
            p = _shaped(sum(np.frombuffer(r["sums"]) for r in sums) / sum(r["n"] for r in sums), p)
    scratch.drop("ids")
    return p


@dataclass
class Scores:
    """Of each row: its tokens, the log probability of their codes and of the shares that do not need counts, and how many distinct
    rare words it has; then these words' hashes and how often each occurs in its row."""

    tokens: np.ndarray
    log_p: np.ndarray
    distinct: np.ndarray
    words: np.ndarray
    times: np.ndarray


def document_scores(vocab: Vocabulary, p: dict[str, np.ndarray], data: np.ndarray, offsets: np.ndarray, at_once: int = 16384) -> Scores:
    """What the network and the vocabulary say of each row; of a rare word's share of its code, the denominator."""
    hashes, counts, _ = placed_words(data, offsets, _IN_WORD)
    rows, ids = len(counts), vocab.ids(hashes)
    symbols = symbol_of(ids)
    around = contexts(symbols, counts)

    # sorted by row, digits and word, so that what a row has of each is a run
    rare = np.flatnonzero(ids >= FREQUENT)
    row, words = np.repeat(np.arange(rows), counts)[rare], hashes[rare]
    order = np.argsort(words * np.uint64(2**64 // CODES) | words // np.uint64(CODES))  # the code's digits, then the rest
    order = order[np.argsort(row[order].astype(np.min_scalar_type(rows)), kind="stable")]
    rare, row, words = rare[order], row[order], words[order]
    code = ids[rare] - FREQUENT
    outside = np.zeros((3, len(ids)))  # log weights of second digit, third digit and class without the row's own words
    for k, size in ((1, 1), (0, THIRD), (2, SECOND * THIRD)):
        of, weight = code // size, weights(vocab.mass, vocab.types).reshape(-1, size).sum(axis=1)
        first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0))
        own = np.diff(np.append(first, len(of)))
        least = UNSEEN * np.maximum(vocab.types, 1).reshape(-1, size).sum(axis=1)
        outside[k, rare] = np.repeat(np.log(np.maximum(weight[of[first]] - own, least[of[first]])), own)

    log_p, logs = np.empty(len(ids)), vocab.digit_logs()
    for a in range(0, len(ids), at_once):
        b = a + at_once
        log_p[a:b] = log_probs(p, logs, around[a:b], ids[a:b], outside[:2, a:b])
    counted = vocab.unigram[symbols] + outside[1] - outside[2]
    log_p = np.logaddexp(log_p + np.log(1 - SMOOTH), counted + np.log(SMOOTH)) - outside[1]
    total = np.zeros(rows)
    total[counts > 0] = np.add.reduceat(log_p, (np.cumsum(counts) - counts)[counts > 0]) if len(log_p) else 0

    first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (words != np.roll(words, 1)))
    times = np.diff(np.append(first, len(words)))
    return Scores(counts, total, np.bincount(row[first], minlength=rows), words[first], times)


_SCORED = "row long, doc_id long, n_tokens long, log_p double, words array<long>, times array<int>"


def _scored(vocab: Vocabulary, p: dict[str, np.ndarray]):
    """(row, doc_id, text) -> a row of ``Scores`` each."""
    names = [x.split()[0] for x in _SCORED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_bytes(batch.column(2))
            for a, b in chunks(offsets, AT_ONCE):
                s = document_scores(vocab, p, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ends = pa.array(np.concatenate(([0], np.cumsum(s.distinct))), pa.int32())
                words = pa.ListArray.from_arrays(ends, pa.array(s.words.view(np.int64)))
                times = pa.ListArray.from_arrays(ends, pa.array(s.times, pa.int32()))
                own = [batch.column(i).slice(a, b - a).cast(pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(s.tokens, pa.int64()), pa.array(s.log_p), words, times], names)

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_prob, perplexity), a row per row of ``docs``.

    Words, lower-cased in A-Z, are runs of letters, digits and non-ASCII bytes. Word counts and the fit of the network cover all texts.
    A rare word has its code's probability times its share of the code: its count in all other documents plus UNSEEN, over that of all the
    code's words. Null and wordless texts: 0 tokens, log likelihood 0, mean and perplexity null. Repeated rows count as often as
    they are there, each as a document. Other columns are ignored; no rows give none.

    Counts of rare words never meet the driver or a broadcast: each row's rare words, known by hash, are joined to them. No word of that join
    has more than a share of 1 / FREQUENT of all tokens, since those that have are frequent.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    counts = scratch.keep(count_words(docs), "counts")
    vocab = vocabulary(counts)
    p = train(docs, vocab, counts.agg(F.sum("n")).first()[0] or 0, scratch)
    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = scratch.keep(given.mapInArrow(_scored(vocab, p), _SCORED), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    # a word without a count above 1 is nowhere else
    share = F.col("times") * F.log(F.coalesce(F.col("n") - F.col("times"), F.lit(0)) + F.lit(UNSEEN))
    shares = rare.join(counts.where("n > 1"), "word", "left").groupBy("row").agg(F.sum(share).alias("shares"))
    both = scored.select("row", "doc_id", "n_tokens", "log_p").join(shares, "row", "left")
    both = both.select("doc_id", "n_tokens", (F.col("log_p") + F.coalesce("shares", F.lit(0.0))).alias("log_likelihood"))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return both.select("*", mean.alias("mean_log_prob"), F.exp(-mean).alias("perplexity"))
