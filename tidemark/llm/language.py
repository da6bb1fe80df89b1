"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into windows of bytes. One network reads each window forwards, another backwards, and both states label
every position; a document's probabilities are the mean over its positions. Training is backpropagation through time in numpy. Beside the
languages there is a label for none of them, learnt from windows of random letters, symbols and stretches of other scripts, so
that a text of no learned language need not look like one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import bound_batches
from tidemark.llm.training import Adam, class_sample, fold
from tidemark.llm.words import chunks, string_bytes

PER_CLASS, WINDOW, HIDDEN = 400, 64, 8
_PAD = 256
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


@dataclass
class LanguageModel:
    """Parameters of both directions: x (inputs by byte), u (states), w (states to labels), b; the languages, which the label for
    none follows; and the share of none above which a document has no language."""

    params: dict[str, np.ndarray]
    languages: list[str]
    most_none: float = 0.5


def windows(data: np.ndarray, offsets: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of each window, padded: (windows, width); the row of each window). Empty rows have none."""
    sizes = np.diff(offsets)
    per_row = -(-sizes // width)
    row = np.repeat(np.arange(len(sizes)), per_row)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    start = offsets[row] + nth * width
    at = start[:, None] + np.arange(width)[None]
    inside = at < offsets[row + 1][:, None]
    out = np.full(at.shape, _PAD, np.int16)
    out[inside] = data[at[inside]]
    return out, row


def _gates(x: np.ndarray, h: np.ndarray, u: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(update, reset, candidate, the state's share of the candidate) of a step. Sigmoids are half-scaled tanh."""
    s = h @ u
    zr = x[:, : 2 * size] + s[:, : 2 * size]
    np.tanh(zr, out=zr)
    zr *= 0.5
    zr += 0.5
    z, r, sn = zr[:, :size], zr[:, size:], s[:, 2 * size :]
    n = np.tanh(x[:, 2 * size :] + r * sn)
    return z, r, n, sn


def _run(p: dict[str, np.ndarray], side: str, steps: np.ndarray, keep: list | None = None) -> list[np.ndarray]:
    """The states of one direction after each of ``steps`` (time, batch), in the order read."""
    size = p["u" + side].shape[0]
    h = np.zeros((steps.shape[1], size), np.float32)
    states = []
    for codes in steps:
        z, r, n, sn = _gates(p["x" + side][codes], h, p["u" + side], size)
        if keep is not None:
            keep.append((codes, h, z, r, n, sn))
        h = n + z * (h - n)
        states.append(h)
    return states


def position_logits(p: dict[str, np.ndarray], batch: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """(time, batch, languages) for windows (batch, time)."""
    steps = np.ascontiguousarray(batch.T)
    kept = {"f": None, "b": None} if keep is None else keep
    forward = _run(p, "f", steps, kept["f"])
    backward = _run(p, "b", steps[::-1], kept["b"])[::-1]
    if keep is not None:
        keep["states"] = (forward, backward)
    out = np.empty((len(steps), len(batch), len(p["b"])), p["b"].dtype)
    for at, (f, g) in enumerate(zip(forward, backward, strict=True)):
        out[at] = f @ p["wf"] + g @ p["wb"] + p["b"]
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _back(p: dict, side: str, kept: list, by_state: list[np.ndarray], grads: dict[str, np.ndarray]) -> None:
    """Backpropagate through one direction; ``by_state`` is the loss's gradient by each state in the order read."""
    size = p["u" + side].shape[0]
    by_h = np.zeros_like(by_state[0])
    gx, gu, ut = grads["x" + side], grads["u" + side], p["u" + side].T
    for (codes, h, z, r, n, sn), g in zip(reversed(kept), reversed(by_state), strict=True):
        by_h = by_h + g
        by_z = by_h * (h - n) * (2 * z * (1 - z))
        by_n = by_h * (1 - z) * (1 - n * n)
        by_r = by_n * sn * (2 * r * (1 - r))
        by_x = np.concatenate([by_z, by_r, by_n], axis=1)
        by_s = np.concatenate([by_z, by_r, by_n * r], axis=1)
        np.add.at(gx, codes, by_x)
        gu += h.T @ by_s
        by_h = by_h * z + by_s @ ut
    assert gx.shape[1] == 3 * size


def loss_and_grads(p: dict[str, np.ndarray], batch: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over the positions inside the windows, and its gradient by every parameter."""
    keep: dict = {"f": [], "b": []}
    logits = position_logits(p, batch, keep)
    inside = (batch.T != _PAD).astype(np.float32)
    total = max(1.0, float(inside.sum()))
    prob = _softmax(logits)
    picked = prob[:, np.arange(len(label)), label]
    loss = float(-(np.log(picked + 1e-12) * inside).sum() / total)
    by_logit = prob
    by_logit[:, np.arange(len(label)), label] -= 1
    by_logit *= inside[..., None] / total
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    forward, backward = keep["states"]
    grads["b"] = by_logit.sum(axis=(0, 1))
    grads["wf"] = sum(h.T @ g for h, g in zip(forward, by_logit, strict=True))
    grads["wb"] = sum(h.T @ g for h, g in zip(backward, by_logit, strict=True))
    _back(p, "f", keep["f"], [g @ p["wf"].T for g in by_logit], grads)
    _back(p, "b", keep["b"], [g @ p["wb"].T for g in by_logit[::-1]], grads)
    return loss, grads


def new_params(languages: int, hidden: int, rng: np.random.Generator, kind=np.float32) -> dict[str, np.ndarray]:
    p = {"b": np.zeros(languages)}
    for side in "fb":
        p["x" + side] = rng.normal(0, 0.3, (257, 3 * hidden))
        p["u" + side] = rng.normal(0, 0.5 / np.sqrt(hidden), (hidden, 3 * hidden))
        p["w" + side] = rng.normal(0, 0.3, (hidden, languages))
    return {k: v.astype(kind) for k, v in p.items()}


def random_windows(n: int, rng: np.random.Generator, width: int = WINDOW) -> np.ndarray:
    """Windows of no language: words of random characters from ASCII letters, all of ASCII, or 64 consecutive code points of any script."""
    out = np.empty((n, width), np.int16)
    for i in range(n):
        low = [97, 33, int(rng.integers(0x100, 0x700)), int(rng.integers(0x700, 0xD700))][rng.integers(4)]
        points = low + rng.integers(0, {97: 26, 33: 94}.get(low, 64), width)
        raw = "".join(chr(c) if keep else " " for c, keep in zip(points, rng.random(width) > 0.15, strict=True)).encode()
        at = int(rng.integers(0, len(raw) - width + 1))
        out[i] = np.frombuffer(raw, np.uint8)[at : at + width]
    return out


def train(sample: list[tuple[str, str]], hidden: int = HIDDEN, rounds: int = 300, batch: int = 256, seed: int = 3) -> LanguageModel:
    """Fit to windows of the sampled texts, each language as often, and none half as often. Texts without bytes teach nothing.

    A document has no language if none has more than half of it, and more than it has in all but a thousandth of the sample.
    """
    languages = sorted({y for _, y in sample})
    rng = np.random.default_rng(seed)
    p = new_params(len(languages) + 1, hidden, rng)
    data, offsets = string_bytes(pa.array([t for t, _ in sample], pa.large_string()))
    grid, row = windows(data, offsets)
    label = np.array([languages.index(y) for _, y in sample], int)[row] if len(row) else np.zeros(0, int)
    of = [np.flatnonzero(label == k) for k in range(len(languages))]
    of = [rows for rows in of if len(rows)]
    adam = Adam(p, 0.02)
    for turn in range(rounds if of else 0):
        adam.rate = 0.02 * (1 - turn / rounds) + 0.001
        each = -(-batch // len(of))
        pick = np.concatenate([rng.choice(rows, each) for rows in of])
        other = random_windows(max(1, each // 2), rng, grid.shape[1])
        labels = np.append(label[pick], np.full(len(other), len(languages)))
        adam.step(loss_and_grads(p, np.concatenate([grid[pick], other]), labels)[1])
    model = LanguageModel(p, languages)
    if of:
        few = sorted({int(i) for i in np.linspace(0, len(sample) - 1, 1000)})
        data, offsets = string_bytes(pa.array([sample[i][0] for i in few], pa.large_string()))
        none = np.concatenate([document_probabilities(model, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[:, -1] for a, b in chunks(offsets)])
        model.most_none = max(0.5, float(np.quantile(none, 0.999)))
    return model


def fit(docs: DataFrame, held_out: Column, per_class: int = PER_CLASS) -> LanguageModel:
    bound_batches(docs.sparkSession)
    return train(class_sample(docs.select("doc_id", "text", "lang"), "lang", held_out, per_class))


def document_probabilities(model: LanguageModel, data: np.ndarray, offsets: np.ndarray, at_once: int = 2048) -> np.ndarray:
    """(rows, languages and none): the mean of the positions' probabilities; zeros for empty rows."""
    out = np.zeros((len(offsets) - 1, len(model.languages) + 1))
    grid, row = windows(data, offsets)
    for a in range(0, len(grid), at_once):
        part = grid[a : a + at_once]
        prob = _softmax(position_logits(model.params, part))
        prob *= (part.T != _PAD)[..., None]
        np.add.at(out, row[a : a + at_once], prob.sum(axis=0))
    return out / np.maximum(np.diff(offsets), 1)[:, None]


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row has a letter of any script."""
    out = np.zeros(len(offsets) - 1, bool)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        own = data[a:b]
        out[i] = _ASCII_LETTER[own].any() or any(c.isalpha() for c in own.tobytes().decode("utf-8", "replace"))
    return out


def predict(model: LanguageModel, text: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(the likeliest language of each text, its probability, that of none); ``und``, 0 and 1 without a letter."""
    data, offsets = string_bytes(text)
    names, scores, none = [], [np.zeros(0)], [np.zeros(0)]
    for lo, hi in chunks(offsets):
        part, ends = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        prob = document_probabilities(model, part, ends)
        has = _has_letter(part, ends) & (len(model.languages) > 0)
        known = prob[:, :-1] if model.languages else prob
        names += [model.languages[k] if ok else "und" for k, ok in zip(known.argmax(axis=1), has, strict=True)]
        scores.append(np.where(has, np.clip(known.max(axis=1), 0, 1), 0.0))
        none.append(np.where(has, np.clip(prob[:, -1], 0, 1), 1.0))
    return names, np.concatenate(scores), np.concatenate(none)


def identifier(model: LanguageModel):
    """Text column -> (lang_pred, score, none, has_language): the likeliest language and its probability, that of none of them, and
    whether the text has a letter and none of them does not outweigh the model's bound."""

    def run(text: pa.Array) -> pa.Array:
        names, score, none = predict(model, text)
        has = (none <= model.most_none) & (np.array(names, object) != "und")
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score), pa.array(none), pa.array(has, pa.bool_())], ["lang_pred", "score", "none", "has_language"])

    return F.arrow_udf(run, "lang_pred string, score double, none double, has_language boolean")


def identify(docs: DataFrame, *, folds: int = 4, held: int = 2, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, none), a row per row of ``docs``; ``none`` is the probability that it is no learned language.

    Learns from whole texts of at most ``per_class`` documents of each ``lang`` outside the held-out fold. Null texts and texts
    without a letter are ``und`` with score 0, as is every text where there is nothing to learn from. A null doc_id is not held out and
    never learnt from. Other columns are ignored; no rows give none.
    """
    held_out = fold("doc_id", folds) == held
    model = fit(docs, held_out, per_class)
    known = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), identifier(model)("text").alias("p"))
    return known.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.none")
