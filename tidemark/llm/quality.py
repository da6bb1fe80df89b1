"""Quality by Bradley-Terry ranking: a linear score of text features and hashed word n-grams learnt from preferences between labelled documents.

A preference pair is a document of label 1 and one of label 0; the chance that the first is preferred is the logistic of the
difference of their scores. The score is fitted to all labelled documents, in replicas that are averaged. The scores only rank, so a quantile of
them, the share of label 0 among all labelled documents, sets where quality begins: there the reported score is ``threshold``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.ordering import running_total
from tidemark.llm.scratch import Scratch, bound_batches, shuffles_dropped
from tidemark.llm.training import Adam, fold, sigmoid, summed
from tidemark.llm.words import chunks, shingles, string_bytes, word_hashes

#: Documents and bytes of a replica at most, documents of each label in it at least, all of these about; pairs that it draws at once.
PART, PART_BYTES, LEAST, PAIRS = 4096, 16 << 20, 64, 4000
#: Buckets that words and word pairs are hashed to.
BUCKETS = 1024
_KINDS = ("lower", "upper", "digit", "high", "space", "line", "stop", "bang", "bar", "mark", "bracket")
_KIND = np.full(256, 9, np.uint8)
for _i, _bytes in enumerate(
    (
        bytes(range(97, 123)),
        bytes(range(65, 91)),
        bytes(range(48, 58)),
        bytes(range(128, 256)),
        b" \t\x0b\x0c",
        b"\n\r",
        b".,;:'\"-",
        b"!?",
        b"|",
        b"#$%&*@^~+=_`",
        b"<>{}[]()/\\",
    )
):
    _KIND[list(_bytes)] = _i


def _distinct(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The number of distinct values in each run of ``counts`` values."""
    ends = np.cumsum(counts)
    out = np.zeros(len(counts), np.int64)
    for i in np.flatnonzero(counts):
        own = np.sort(values[ends[i] - counts[i] : ends[i]])
        out[i] = 1 + np.count_nonzero(own[1:] != own[:-1])
    return out


@dataclass
class Features:
    """dense: shares of byte kinds, of repeated words and word pairs, and sizes, each also saturating early: (rows, features); and the
    buckets of all words and word pairs, each with its row."""

    dense: np.ndarray
    bucket: np.ndarray
    row: np.ndarray

    def means(self, weights: np.ndarray) -> np.ndarray:
        """The mean weight of each row's words and word pairs; 0 without any."""
        rows = len(self.dense)
        return np.bincount(self.row, weights[self.bucket], rows) / np.maximum(np.bincount(self.row, minlength=rows), 1)

    def shares(self) -> np.ndarray:
        """(rows, BUCKETS): the share of each bucket."""
        counts = np.bincount(self.row * BUCKETS + self.bucket, minlength=len(self.dense) * BUCKETS).reshape(-1, BUCKETS)
        return (counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def features(data: np.ndarray, offsets: np.ndarray) -> Features:
    n = np.maximum(np.diff(offsets), 1)
    kinds = _KIND[data]
    shares = np.array([np.bincount(kinds[a:b], minlength=len(_KINDS)) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]) / n[:, None]
    words, counts = word_hashes(data, offsets)
    m = np.maximum(counts, 1)
    row = np.repeat(np.arange(len(counts)), counts)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    adjacent = np.bincount(row[same], minlength=len(counts)) / m
    pairs, pair_counts = shingles(words, counts, 2)
    repeated = 1 - _distinct(words, counts) / m
    repeated_pairs = 1 - _distinct(pairs, pair_counts) / np.maximum(pair_counts, 1)
    shape = np.stack([adjacent, repeated, repeated_pairs, np.log1p(counts) / 10, np.minimum(n / m, 40) / 10, (counts == 0).astype(float)], 1)
    base = np.concatenate([shares, shape], 1)
    grams = (np.concatenate([words, pairs]) % np.uint64(BUCKETS)).astype(np.int64)
    rows = np.concatenate([row, np.repeat(np.arange(len(counts)), pair_counts)])
    return Features(np.concatenate([base, base / (base + 0.02), base / (base + 0.2)], 1), grams, rows)


@dataclass
class QualityModel:
    """A linear score of standardised features and of mean n-gram weights, and the score where quality begins."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    grams: np.ndarray
    edge: float
    slope: float

    def raw(self, x: Features) -> np.ndarray:
        return ((x.dense - self.mean) / self.spread) @ self.weights + x.means(self.grams)


def pull_apart(texts: pa.Array, labels: np.ndarray, rounds: int = 400, seed: int = 5) -> np.ndarray:
    """The weights of dense features, as they are, and of n-grams, fitted to preference pairs of texts of both labels."""
    data, offsets = string_bytes(texts)
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    scale = np.float32(np.sqrt(BUCKETS))
    found, z = [], None
    for a, b in chunks(offsets):
        f = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        dense = f.dense.shape[1]
        z = np.empty((len(labels), dense + BUCKETS), np.float32) if z is None else z
        z[a:b, dense:] = f.shares() * scale
        found.append(f.dense)
    x = np.concatenate(found)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    z[:, :dense] = (x - mean) / spread
    rng = np.random.default_rng(seed)
    params = {"w": np.zeros(z.shape[1])}
    adam = Adam(params, 0.03)
    for _ in range(rounds):
        first, second = rng.choice(good, PAIRS), rng.choice(bad, PAIRS)
        raw = z @ params["w"].astype(np.float32)
        lost = sigmoid(raw[second] - raw[first])
        # a pair pulls its documents apart by what it lost
        pull = (np.bincount(first, lost, len(z)) - np.bincount(second, lost, len(z))) / PAIRS
        adam.step({"w": 1e-3 * params["w"] - pull.astype(np.float32) @ z})
    return np.concatenate([params["w"][:dense] / spread, params["w"][dense:] * float(scale)])


def _replica(part: pa.Table) -> pa.Table:
    """A part of the labelled documents -> (their number, the weights fitted to them, times their number); none without both labels."""
    part = part.sort_by([("doc_id", "ascending")])
    n, labels = part.num_rows, part["label"].to_numpy()
    told = [(n, (pull_apart(part["text"].combine_chunks(), labels) * n).tobytes())] if 0 < np.count_nonzero(labels) < n else []
    return pa.table({"n": pa.array([m for m, _ in told], pa.int64()), "sums": pa.array([w for _, w in told], pa.binary())})


def _raw(model: QualityModel, text: pa.Array) -> np.ndarray:
    data, offsets = string_bytes(text)
    out = [model.raw(features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in chunks(offsets)]
    return np.concatenate([np.zeros(0), *out])


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, part: int = PART) -> QualityModel:
    """The score fitted to every labelled document that is not held out, and its edge among the scores of all of them.

    A doc_id with several labels counts as its largest, one with several texts once, by the smallest. Documents are dealt by a hash of doc_id
    into parts of about ``part`` documents and at most about PART_BYTES; where a label has fewer than LEAST a part its documents are in several. A
    replica is fitted to each part, in parallel, and their weights are averaged by documents. Without both labels every document scores as the
    labels there are, or as good without any. The shuffled texts of one step go before the next.
    """
    with shuffles_dropped(docs.sparkSession):
        return _fit(docs, labels, held_out, part)


def _fit(docs: DataFrame, labels: DataFrame, held_out: Column, part: int) -> QualityModel:
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "quality")
    learnt = F.coalesce(~held_out, F.lit(False))
    known = labels.where(F.col("quality").isNotNull() & learnt).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    texts = docs.where(learnt).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = scratch.keep(texts.join(known, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")), "learnt")
    many = {r["label"]: r for r in rows.where("label in (0, 1)").groupBy("label").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()}
    none = np.zeros(features(*string_bytes(pa.array([""]))).dense.shape[1])
    if len(many) < 2:
        scratch.keep_only()
        return QualityModel(none, none + 1, none, np.zeros(BUCKETS), 1.0 if 0 in many else -1.0, 5.0)
    parts = max(1, -(-sum(r["n"] for r in many.values()) // part), -(-sum(r["bytes"] for r in many.values()) // PART_BYTES))
    copies = {label: min(parts, -(-parts * LEAST // r["n"])) for label, r in many.items()}
    turn = F.explode(F.sequence(F.lit(0), F.when(F.col("label") == 0, copies[0]).otherwise(copies[1]) - 1))
    dealt = rows.where("label in (0, 1)").withColumn("turn", turn)
    dealt = dealt.select(F.pmod(F.xxhash64("doc_id", F.lit(11)) + F.col("turn"), F.lit(parts)).cast("int").alias("part"), "doc_id", "label", "text")
    tasks = min(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # by number, so that small parts are not put together into few tasks
    fitted = dealt.repartition(tasks, "part").groupBy("part").applyInArrow(_replica, "n long, sums binary")
    sums = fitted.repartition(math.isqrt(tasks)).mapInArrow(summed, "n long, sums binary").collect()
    weights = sum(np.frombuffer(r["sums"]) for r in sums) / sum(r["n"] for r in sums)
    model = QualityModel(none, none + 1, weights[: len(none)], weights[len(none) :], 0.0, 1.0)

    def raw(text: pa.Array) -> pa.Array:
        return pa.array(_raw(model, text))

    # equal scores, as of copies, are a row; the edge is the score of the last document among as many of the lowest as have label 0
    scores = rows.where("label in (0, 1)").select(F.arrow_udf(raw, "double")("text").alias("raw")).groupBy("raw").agg(F.count("*").alias("n"))
    edge = running_total(scores, [F.col("raw").asc()], "n", "upto", scratch, "ranked").where(F.col("upto") >= many[0]["n"]).agg(F.min("raw")).first()[0]
    scratch.keep_only()
    return replace(model, edge=edge)


def scorer(model: QualityModel, threshold: float):
    """Text column -> a score from 0 to 1 that is ``threshold`` at the model's edge; null counts as empty."""
    shift = np.log(threshold / (1 - threshold))

    def run(text: pa.Array) -> pa.Array:
        return pa.array(sigmoid(model.slope * (_raw(model, text) - model.edge) + shift))

    return F.arrow_udf(run, "double")


def quality(docs: DataFrame, labels: DataFrame, *, folds: int = 5, held: int = 0, threshold: float = 0.3, part: int = PART) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row per row of ``docs``; predicted is 1 from ``threshold`` on.

    Learns from every document with a ``labels.quality`` value outside the held-out fold, by whole texts only, in parts of about
    ``part``. Null and empty texts are scored by the features of an empty text. A null doc_id is not held out and never learnt from. Other columns are ignored; no rows give none.
    """
    held_out = fold("doc_id", folds) == held
    model = fit(docs, labels, held_out, part)
    scored = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), scorer(model, threshold)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
