"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

Labels are of documents; the model scores sentences by their distinct words, and a noisy-or combines them: a document is clean
with the product of its sentences' probabilities to be clean. Trained on document labels alone, sentence scores then
show where a document offends.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import bound_batches
from tidemark.llm.training import Adam, fold, labelled_sample, sigmoid
from tidemark.llm.words import chunks, placed_words, separators, string_bytes

PER_CLASS = 2000


@dataclass(frozen=True)
class Setting:
    """toxic_share: the weight of toxic documents in the fit; sparsity: the absolute penalty per toxic document; refit: the share of the
    penalty that stays when the chosen words are fitted again. The defaults were chosen by ``choose``."""

    toxic_share: float = 0.3
    sparsity: float = 0.4
    refit: float = 0.1


_IN_WORD = separators(string.ascii_letters.encode() + string.digits.encode() + bytes(range(128, 256)))
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?\n")] = True


@dataclass
class ToxicityModel:
    """words: sorted hashes, weights by word, bias: a sentence's logit without known words."""

    words: np.ndarray
    weights: np.ndarray
    bias: float


def _sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, the index of each sentence's first word, sentences of each row, where each word starts).

    A sentence is a run of words without . ! ? or a line break between them.
    """
    words, counts, starts = placed_words(data, offsets, _IN_WORD)
    if not len(starts):
        return words, np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64), starts
    ends = np.cumsum(_ENDS[data])[starts]
    new = np.ones(len(starts), bool)
    new[1:] = ends[1:] != ends[:-1]
    row_starts = (np.cumsum(counts) - counts)[counts > 0]
    new[row_starts] = True
    first = np.flatnonzero(new)
    per_row = np.zeros(len(counts), np.int64)
    per_row[counts > 0] = np.add.reduceat(new.astype(np.int64), row_starts)
    return words, first, per_row, starts


def _by_row(values: np.ndarray, per_row: np.ndarray) -> np.ndarray:
    out = np.zeros(len(per_row))
    full = per_row > 0
    if full.any():
        out[full] = np.add.reduceat(values, (np.cumsum(per_row) - per_row)[full])
    return out


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def train(sample: list[tuple[str, int]], setting: Setting = Setting(), rounds: int = 150, refit: int = 200, least_docs: int = 3) -> ToxicityModel:
    """Fit word weights to document labels by the noisy-or likelihood, sparse by an absolute penalty. Without both labels every score is near 0."""
    empty = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), -20.0)
    if len({y for _, y in sample}) < 2:
        return empty
    labels = np.array([y for _, y in sample], float)
    data, offsets = string_bytes(pa.array([t for t, _ in sample], pa.large_string()))
    words, first, per_row, _ = _sentences(data, offsets)
    if not words.size:
        return empty
    length = np.diff(np.append(first, len(words)))
    row = np.repeat(np.repeat(np.arange(len(per_row)), per_row), length)
    unique, code = np.unique(words, return_inverse=True)
    seen = np.unique(code * len(sample) + row)
    known = np.bincount(seen // len(sample), minlength=len(unique)) >= least_docs
    slot = np.where(known, np.cumsum(known) - 1, known.sum())[code]
    sentence = np.repeat(np.arange(len(first)), length)
    once = np.unique(sentence * (int(known.sum()) + 1) + slot)
    sentence, slot = np.divmod(once, int(known.sum()) + 1)
    of_row = np.repeat(np.arange(len(per_row)), per_row)
    weight = np.where(labels > 0, setting.toxic_share / labels.sum(), (1 - setting.toxic_share) / (1 - labels).sum())
    sparsity = setting.sparsity / labels.sum()
    w, bias = np.zeros(int(known.sum()) + 1), np.array([-5.0])
    adam = Adam({"w": w, "b": bias}, 0.1)
    for turn in range(rounds + refit):
        z = np.bincount(sentence, w[slot], minlength=len(first)) + bias
        total = np.maximum(_by_row(_softplus(z), per_row), 1e-9)
        by_total = weight * ((1 - labels) - labels * np.exp(-total) / -np.expm1(-total))
        by_z = by_total[of_row] * sigmoid(z)
        grad = np.bincount(slot, by_z[sentence], minlength=len(w))
        cost = sparsity if turn < rounds else sparsity * setting.refit
        grad = np.where(w != 0, grad + cost * np.sign(w), np.sign(grad) * np.maximum(np.abs(grad) - sparsity, 0))
        if turn >= rounds:  # the words that were chosen are fitted at less of the penalty, which keeps weights small
            grad[w == 0] = 0
        grad[-1] = 0
        was = w.copy()
        adam.step({"w": grad, "b": np.array([by_z.sum()])})
        w[w * was < 0] = 0
    keep = np.flatnonzero(w[:-1])
    return ToxicityModel(unique[known][keep], w[keep], float(bias[0]))


def choose(sample: list[tuple[str, int]], settings: list[Setting], inner: int = 4) -> Setting:
    """Of the settings, that with the fewest errors at 0.5 on every ``inner``-th text of the sample when fitted to the others; ties go by the log loss.

    The sample holds learning rows only, so held-out rows have no part in the choice.
    """
    held, rest = sample[::inner], [x for i, x in enumerate(sample) if i % inner]
    data, offsets = string_bytes(pa.array([t for t, _ in held], pa.large_string()))
    labels = np.array([y for _, y in held])

    def cost(setting: Setting) -> tuple[float, float]:
        z, per_row, _ = sentence_logits(train(rest, setting), data, offsets)
        score = np.clip(-np.expm1(-_by_row(_softplus(z), per_row)), 1e-6, 1 - 1e-6)
        return float(np.mean((score >= 0.5) != labels)), float(-np.mean(np.log(np.where(labels, score, 1 - score))))

    return min(settings, key=cost)


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, per_class: int = PER_CLASS) -> ToxicityModel:
    bound_batches(docs.sparkSession)
    return train(labelled_sample(docs, labels, "toxic", held_out, per_class))


def sentence_logits(model: ToxicityModel, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a logit for each sentence, sentences of each row, where each sentence starts in ``data``)."""
    words, first, per_row, starts = _sentences(data, offsets)
    if not words.size:
        return np.zeros(0), per_row, starts
    value = np.zeros(len(words))
    if len(model.words):
        maybe = np.zeros(1 << 20, bool)
        maybe[(model.words & np.uint64(0xFFFFF)).astype(np.int64)] = True
        word = np.flatnonzero(maybe[(words & np.uint64(0xFFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(model.words, words[word]), len(model.words) - 1)
        word, at = word[model.words[at] == words[word]], at[model.words[at] == words[word]]
        sentence = np.searchsorted(first, word, "right") - 1
        _, once = np.unique(sentence * len(model.words) + at, return_index=True)
        value[word[once]] = model.weights[at[once]]
    return np.add.reduceat(value, first) + model.bias, per_row, starts[first]


def scorer(model: ToxicityModel, least: float = 0.5):
    """Text column -> (score, offending): the probability that the document is toxic, and where.

    The score is 0 for null, empty and wordless texts. ``offending`` lists the sentences whose own probability is at least ``least``, in order,
    each with its text and score. A document can be toxic by many mild sentences; then its worst is given. Clean documents have none.
    """
    offending = pa.list_(pa.struct([("sentence", pa.int32()), ("score", pa.float64()), ("text", pa.string())]))

    def run(text: pa.Array) -> pa.Array:
        data, offsets = string_bytes(text)
        scores, located = [np.zeros(0)], []
        for lo, hi in chunks(offsets):
            part, ends = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            z, per_row, starts = sentence_logits(model, part, ends)
            score = -np.expm1(-_by_row(_softplus(z), per_row))
            scores.append(score)
            of_row = np.cumsum(per_row) - per_row
            for i in range(hi - lo):
                if score[i] < least:
                    located.append([])
                    continue
                own = slice(of_row[i], of_row[i] + per_row[i])
                p, bounds = sigmoid(z[own]), np.append(starts[own], ends[i + 1])
                worst = np.flatnonzero(p >= least) if p.max() >= least else [int(p.argmax())]
                located.append([{"sentence": int(j), "score": float(p[j]), "text": part[bounds[j] : bounds[j + 1]].tobytes().decode("utf-8", "replace").strip()} for j in worst])
        return pa.StructArray.from_arrays([pa.array(np.concatenate(scores)), pa.array(located, offending)], ["score", "offending"])

    return F.arrow_udf(run, "score double, offending array<struct<sentence:int,score:double,text:string>>")


def toxicity(docs: DataFrame, labels: DataFrame, *, folds: int = 5, held: int = 0, threshold: float = 0.5, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted, offending), a row per row of ``docs``.

    Learns from at most ``per_class`` documents of each ``labels.toxic`` value outside the held-out fold, by whole texts
    only. ``offending`` lists the sentences that make the document toxic. Null, empty or wordless texts score 0. A
    null doc_id is not held out and never learnt from. Other columns are ignored; no rows give none.
    """
    held_out = fold("doc_id", folds) == held
    model = fit(docs, labels, held_out, per_class)
    scored = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), scorer(model, threshold)("text").alias("s"))
    return scored.select("doc_id", "held_out", "s.score", (F.col("s.score") >= threshold).cast("int").alias("predicted"), "s.offending")
