"""Exact integer k-means by scalar lookup tables.

Vectors are kept once as blocks: of each dimension the sorted integer values that occur in the block, and for each vector where its values
stand there. A round tabulates, block by block, the squared difference of every such value to every centroid; a vector's distances
are then gathered from the tables and summed, with no arithmetic on the vectors themselves. A value that thousands of
vectors share is squared once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch, bound_batches

#: Rows of a block: its codes and tables are some MB in a task, whatever the table holds.
BLOCK = 8192
#: Components and differences beyond these count as these, so that a squared distance fits a long.
MOST_VALUE, MOST_DIFFERENCE = 1 << 61, 1 << 28

_BLOCKS = "ids array<long>, places binary, sizes array<int>, numbers array<long>, starts array<struct<key:string,vec_id:long,v:array<long>>>"


def quantized_matrix(column: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the column that count, their components as floor(scale * x)): lists of ``width`` components, none null or non-finite."""
    lists = column.cast(pa.list_(pa.float64()))
    fits = pc.fill_null(pc.equal(pc.list_value_length(lists), width), False).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(fits)
    flat = pc.list_flatten(lists.take(pa.array(rows)))
    x = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), width)
    fine = np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore"):
        whole = np.floor(np.clip(x[fine] * scale, -float(MOST_VALUE), float(MOST_VALUE)))
    return rows[fine], whole.astype(np.int64)


def _encode(width: int, scale: int, k: int) -> Callable:
    """Rows (vec_id, embedding, key) -> blocks, each with its own k candidates for the first centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                rows, x = quantized_matrix(batch.column(1), width, scale)
                if not len(rows):
                    continue
                ids, keys = (batch.column(c).take(pa.array(rows)) for c in (0, 2))
                places, sizes, numbers = np.empty((width, len(rows)), np.int32), [], []
                for d in range(width):
                    values, places[d] = np.unique(x[:, d], return_inverse=True)
                    sizes.append(len(values))
                    numbers.append(values)
                ranked = sorted((h, i, x[r].tolist()) for r, (h, i) in enumerate(zip(keys.to_pylist(), ids.to_pylist(), strict=True)) if h is not None)[:k]
                starts = [{"key": h, "vec_id": i, "v": v} for h, i, v in ranked]
                yield pa.RecordBatch.from_pydict(
                    {"ids": [ids], "places": [places.tobytes()], "sizes": [sizes], "numbers": [np.concatenate(numbers)], "starts": [starts]},
                    pa.schema([
                        ("ids", pa.list_(pa.int64())), ("places", pa.binary()), ("sizes", pa.list_(pa.int32())), ("numbers", pa.list_(pa.int64())),
                        ("starts", pa.list_(pa.struct([("key", pa.string()), ("vec_id", pa.int64()), ("v", pa.list_(pa.int64()))]))),
                    ]),
                )

    return run


class Block:
    """A block read back: ids, places[dimension, vector] and the occurring numbers of each dimension."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        value = lambda name: batch.column(batch.schema.get_field_index(name))[row]
        self.ids = value("ids").values
        self.sizes = value("sizes").values.to_numpy()
        self.numbers = value("numbers").values.to_numpy()
        self.places = np.frombuffer(value("places").as_buffer(), np.int32).reshape(len(self.sizes), -1)
        self.first = np.cumsum(self.sizes) - self.sizes

    def tables(self, centres: np.ndarray) -> np.ndarray:
        """Squared difference of each occurring number, dimension by dimension, to each centroid's component in its dimension."""
        own = np.repeat(centres.T, self.sizes, axis=0)  # (number, centroid)
        return np.minimum(np.abs(own - self.numbers[:, None]), MOST_DIFFERENCE) ** 2

    def nearest(self, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the nearest centroid of each vector, ties to the smaller; its squared distance)."""
        tables = self.tables(centres)
        total = np.zeros((self.places.shape[1], len(centres)), np.int64)
        for at, places in zip(self.first, self.places, strict=True):
            total += tables[at + places]
        cluster = total.argmin(axis=1)
        return cluster, total[np.arange(len(total)), cluster]

    def sums(self, cluster: np.ndarray, k: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(cluster, dimension, vectors, high, low): how often each number occurs, times the number, in halves of 32 bits that cannot overflow."""
        many = np.bincount(cluster, minlength=k)
        for d, (at, size, places) in enumerate(zip(self.first, self.sizes, self.places, strict=True)):
            numbers = self.numbers[at : at + size]
            often = np.bincount(cluster * size + places, minlength=k * size).reshape(k, size)
            high, low = often @ (numbers >> 32), often @ (numbers & 0xFFFFFFFF)
            for c in np.flatnonzero(many):
                yield int(c), d, int(many[c]), int(high[c]), int(low[c])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield Block(batch, row)


def _update(centres: np.ndarray) -> Callable:
    """Blocks -> a task's sums, a row for each of its clusters and dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], list[int]] = {}
        for block in _blocks(batches):
            for c, d, *some in block.sums(block.nearest(centres)[0], len(centres)):
                all_of = seen.setdefault((c, d), [0, 0, 0])
                for i, x in enumerate(some):
                    all_of[i] += x
        if seen:
            columns = [*zip(*seen, strict=True), *zip(*seen.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), *[pa.int64()] * 3), strict=True)], ["cluster", "dim", "n", "high", "low"])

    return run


def _inertia(centres: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            cluster, distance = block.nearest(centres)
            found = pd.Series(distance).groupby(cluster).sum()
            yield pa.RecordBatch.from_arrays([pa.array(found.index, pa.int32()), pa.array(found.to_numpy(), pa.int64())], ["cluster", "distance"])

    return run


def _label(centres: np.ndarray, inertia: dict[int, int]) -> Callable:
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    most = 2**63 - 1
    of_cluster = np.array([min(most, inertia.get(c, 0)) for c in range(len(centres))], np.int64)
    total = min(most, sum(inertia.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            cluster, distance = block.nearest(centres)
            columns = [block.ids, pa.array(cluster, pa.int32()), pa.array(distance), pa.array(of_cluster[cluster]), pa.array(np.full(len(cluster), total)), pa.array(shas).take(pa.array(cluster))]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in LABELS.split(", ")])

    return run


LABELS = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def moved(centres: np.ndarray, sums: list[tuple[int, int, int, int, int]]) -> np.ndarray:
    """Centroids after a round: floor(sum / count) by Python's integers where a cluster has vectors."""
    out = centres.copy()
    for c, d, n, high, low in sums:
        out[c, d] = ((int(high) << 32) + int(low)) // int(n)
    return out


class Clustering:
    """Blocks of ``vectors(vec_id, embedding)`` in the shared folder, and the centroids so far."""

    def __init__(self, vectors: DataFrame, *, k: int, width: int, scale: int, seed: int):
        self.spark: SparkSession = vectors.sparkSession
        bound_batches(self.spark)
        self.scratch = Scratch(self.spark, "centroids")
        vec_id = F.col("vec_id").cast("long")
        key = F.sha2(F.concat(F.lit(f"{seed}:"), vec_id.cast("string")), 256)
        rows = vectors.select(vec_id.alias("vec_id"), "embedding", key.alias("key"))
        self.blocks = self.scratch.keep(rows.mapInArrow(_encode(width, scale, k), _BLOCKS), "blocks")
        first = self.blocks.select(F.explode("starts").alias("s")).select("s.*").orderBy("key", "vec_id", "v").limit(k).collect()
        self.centres = np.array([r["v"] for r in first], np.int64).reshape(len(first), width)

    def round(self) -> bool:
        """Assign and move; whether any centroid moved. The driver gets a row for each cluster and dimension."""
        if not len(self.centres):
            return False
        sums = self.blocks.drop("starts", "ids").withColumn("ids", F.array().cast("array<long>")).mapInArrow(_update(self.centres), "cluster int, dim int, n long, high long, low long")
        whole = [F.sum(F.col(c).cast("decimal(38,0)")) for c in ("n", "high", "low")]
        found = moved(self.centres, sums.groupBy("cluster", "dim").agg(*whole).collect())
        changed = bool((found != self.centres).any())
        self.centres = found
        return changed

    def labels(self) -> DataFrame:
        """LABELS: each vector's cluster, and the sums of squared distances."""
        if not len(self.centres):
            return self.spark.createDataFrame([], LABELS)
        sums = self.blocks.drop("starts").mapInArrow(_inertia(self.centres), "cluster int, distance long")
        inertia = {c: int(d) for c, d in sums.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
        return self.blocks.drop("starts").mapInArrow(_label(self.centres, inertia), LABELS)


def cluster(vectors: DataFrame, *, k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """The cluster of each vector after ``rounds`` of exact integer k-means: LABELS, a row for each vector kept.

    Vectors with exactly ``width`` components, none null or non-finite, are kept and become floor(scale * x); others have no row. The first
    centroids are the k kept vectors whose sha256 of ``<seed>:<vec_id>`` is smallest; of rows that repeat a vec_id the smaller vector
    comes first, and rows without a vec_id, though clustered, begin no cluster. Fewer such rows give fewer clusters, none give no rows. Ties
    of distance go to the smaller cluster; an empty cluster's centroid stays. A component beyond 2^61, and a difference beyond 2^28, count
    as that, so that distances fit a long; inertias that do not are the largest long. Repeated rows count and appear as often as they
    are there. Other columns are ignored.

    A round reads the blocks once and shuffles ``k * width`` rows a task. When no centroid moves, all rounds that remain would leave them, and are left
    out. Blocks are kept in the shared folder; a lost executor costs its tasks of one round.
    """
    found = Clustering(vectors, k=k, width=width, scale=scale, seed=seed)
    for _ in range(rounds):
        if not found.round():
            break
    return found.labels()
