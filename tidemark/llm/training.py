"""What the trained filters share: folds, bounded class-balanced samples and an optimiser. Everything is seeded."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bounds of a sample besides its rows a class: bytes of a text, and classes.
MOST_BYTES, MOST_CLASSES = 1 << 20, 200


def fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return (F.crc32(F.col(column).cast("string").cast("binary")) % folds).cast("int")


def _shares(rows: DataFrame, label: str, per_class: int) -> DataFrame:
    """rows(doc_id, label, ...) of the MOST_CLASSES most frequent labels, each thinned by a hash of doc_id to somewhat more than ``per_class`` ids."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("of_label"))
    counts = counts.orderBy(F.desc("of_label"), label).limit(MOST_CLASSES)
    share = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 40)) / float(1 << 40)
    return rows.join(F.broadcast(counts), label).where(share * F.col("of_label") < 1.2 * per_class + 20).drop("of_label")


def _collected(rows: DataFrame, label: str, per_class: int) -> list[tuple]:
    """[(text, label)]: ``per_class`` ids of each label by hash, each with its smallest text. No more than that reaches the driver."""
    fine = rows.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= MOST_BYTES)
    once = fine.groupBy("doc_id", label).agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    place = F.row_number().over(W.partitionBy(label).orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id"))
    drawn = once.withColumn("place", place).where(F.col("place") <= per_class)
    return [(r["text"], r[label]) for r in sorted(drawn.collect(), key=lambda r: (str(r[label]), r["place"]))]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, per_class: int) -> list[tuple[str, int]]:
    """[(text, label)]: at most ``per_class`` whole texts of each label from the rows that are not held out.

    A doc_id with several labels counts as its largest. Labels are drawn first, so only drawn ids meet the texts; a doc_id with several
    texts counts once, and texts above MOST_BYTES are left out.
    """
    known = labels.where(F.col(label).isNotNull() & F.coalesce(~held_out, F.lit(False))).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    drawn = _shares(known, "label", per_class)
    return _collected(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id"), "label", per_class)


def class_sample(docs: DataFrame, label: str, held_out: Column, per_class: int) -> list[tuple[str, str]]:
    """[(text, label)] as ``labelled_sample``, with the label a column of ``docs``; of more than MOST_CLASSES labels the most frequent."""
    known = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull() & F.coalesce(~held_out, F.lit(False)))
    return _collected(_shares(known.select("doc_id", "text", label), label, per_class), label, per_class)


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (n, sums: floats as bytes) of a task as one row."""
    n, sums = 0, None
    for batch in batches:
        for m, each in zip(batch["n"].to_pylist(), batch["sums"].to_pylist(), strict=True):
            n, sums = n + m, np.frombuffer(each) + (0 if sums is None else sums)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([sums.tobytes()], pa.binary())], ["n", "sums"])


class Adam:
    """Adam over a dict of arrays, updated in place."""

    def __init__(self, params: dict[str, np.ndarray], rate: float = 0.01):
        self.params, self.rate, self.turn = params, rate, 0
        self.first = {k: np.zeros_like(v) for k, v in params.items()}
        self.second = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.turn += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.turn) / (1 - 0.9**self.turn)
        for k, g in grads.items():
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] += 0.001 * (g * g - self.second[k])
            self.params[k] -= (scale * self.first[k] / (np.sqrt(self.second[k]) + 1e-8)).astype(self.params[k].dtype)


class InPlaceAdam(Adam):
    """The same in the precision of the parameters and without temporary arrays, for many parameters and short steps."""

    def __init__(self, params: dict[str, np.ndarray], rate: float = 0.01):
        super().__init__(params, rate)
        self.spare = {k: np.empty_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.turn += 1
        scale = float(self.rate * np.sqrt(1 - 0.999**self.turn) / (1 - 0.9**self.turn))
        for k, g in grads.items():
            first, second, x = self.first[k], self.second[k], self.spare[k]
            np.subtract(g, first, out=x)
            x *= 0.1
            first += x
            np.multiply(g, g, out=x)
            x -= second
            x *= 0.001
            second += x
            np.sqrt(second, out=x)
            x += 1e-8
            np.divide(first, x, out=x)
            x *= scale
            self.params[k] -= x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)
