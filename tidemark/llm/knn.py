"""Exact top-k inner-product search as a Voronoi join.

Pivots split the vectors into cells, and distance to the pivot splits a cell into rings. A ring's summary (rows, largest distance and
norm) bounds the score that any of its vectors can reach with a query, and a bounded sample gives each query a score that its
k-th result reaches at least. A query goes only to the rings whose bound reaches that score, a ring's vectors only to
where such queries are, and blocks of both are solved locally.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch

#: Rows of the fit, the most pivots (else the square root of the rows), and rings of a cell.
SAMPLE, MOST_PIVOTS, RINGS = 4096, 1024, 8
#: Rows of a ring, and queries, that meet in one block.
BLOCK, QUERY_BLOCK = 512, 4096


def quantized(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component as double; rows with null or non-finite parts are dropped."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < math.inf), F.lit(False)))
    v = F.transform("x", lambda c: F.floor(c * scale))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null").where(fine).select("vec_id", v.alias("v"))


def _matrix(column, width: int, kind=np.float64) -> np.ndarray:
    """Rows of lists, padded by zeros to a common width."""
    out = np.zeros((len(column), width), kind)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def choose_pivots(sample: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """Cell centres of the sample by a few rounds of k-means from spread-out rows."""
    n = min(n, len(sample))
    centres = sample[np.linspace(0, len(sample) - 1, n).astype(int)].astype(float) if n else sample.astype(float)
    for _ in range(rounds if n else 0):
        near = _nearest(sample, centres)[0]
        for j in np.unique(near):
            centres[j] = sample[near == j].mean(axis=0)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.einsum("ij,ij->i", centres, centres)[None] - 2 * x @ centres.T
    cell = d.argmin(axis=1)
    return cell, np.sqrt(((x - centres[cell]) ** 2).sum(axis=1))


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products: by floats while those are exact, else by 64-bit integers."""
    if not len(q) or not len(x):
        return np.zeros((len(q), len(x)), np.int64)
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2**53:
        return (q.astype(float) @ x.T.astype(float)).astype(np.int64)
    return q @ x.T


def _assign(centres: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1).to_numpy(zero_copy_only=False), width)
                cell, far = _nearest(x, centres)
                norm = np.sqrt((x**2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int32()), pa.array(far), pa.array(norm)], ["vec_id", "v", "cell", "far", "norm"])

    return run


@dataclass
class Rings:
    """Of each ring: its number (cell * RINGS + place), cell, rows, largest distance to the pivot and largest norm."""

    number: np.ndarray
    cell: np.ndarray
    rows: np.ndarray
    far: np.ndarray
    norm: np.ndarray


def _route(centres: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, rings: Rings, k: int, at_once: int = 256):
    """For each query, the rings whose bound reaches the score that its k-th result has at least."""
    width = sample.shape[1]

    def routed(ids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        least = np.full(len(q), np.iinfo(np.int64).min)
        if len(sample) > k:
            s = _scores(q, sample)
            s[ids[:, None] == sample_ids[None]] = np.iinfo(np.int64).min
            least = np.partition(s, -k, axis=1)[:, -k]
        length = np.sqrt((q.astype(float) ** 2).sum(axis=1))[:, None]
        top = np.minimum((q @ centres.T)[:, rings.cell] + length * rings.far, length * rings.norm)
        goes = top + 1 + 1e-9 * np.abs(top) >= least[:, None]
        return least, [rings.number[g] for g in goes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, at_once):
                batch = whole.slice(a, at_once)
                q = _matrix(batch.column(1).to_numpy(zero_copy_only=False), width, np.int64)
                least, goes = routed(batch.column(0).to_numpy(), q)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(least), pa.array(goes, pa.list_(pa.int32()))], ["query_id", "q", "least", "rings"])

    return run


def _solve(k: int, width: int):
    def run(data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
        if not len(data) or not len(queries):
            return empty
        ids, x = data["vec_id"].to_numpy(), _matrix(data["v"], width, np.int64)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        repeated = np.zeros(len(ids), bool)
        repeated[1:] = (ids[1:] == ids[:-1]) & (x[1:] == x[:-1]).all(axis=1)
        ids, x = ids[~repeated], x[~repeated]
        found = []
        for at in range(0, len(queries), 512):
            part = queries.iloc[at : at + 512]
            qids, least = part["query_id"].to_numpy(), part["least"].to_numpy()
            s = _scores(_matrix(part["q"], width, np.int64), x)
            for i, row in enumerate(s):
                fit = np.flatnonzero((row >= least[i]) & (ids != qids[i]))
                if len(fit) > k:  # ids ascend, so a stable sort leaves ties to the smaller
                    fit = fit[np.argsort(-row[fit], kind="stable")[:k]]
                found.append((np.full(len(fit), qids[i]), ids[fit], row[fit]))
        cols = [np.concatenate(c) for c in zip(*found, strict=True)]
        return pd.DataFrame(dict(zip(empty.columns, cols, strict=True)))

    return run


def _rings(cells: DataFrame) -> tuple[DataFrame, Rings]:
    """cells(cell, far, norm, ...) with their ``ring``, and the rings, at most RINGS a pivot."""
    radius = cells.groupBy("cell").agg(F.max("far").alias("radius"))
    place = F.when(F.col("radius") > 0, F.least(F.lit(RINGS - 1), F.floor(F.col("far") / F.col("radius") * RINGS))).otherwise(0)
    ringed = cells.join(F.broadcast(radius), "cell").withColumn("ring", (F.col("cell") * RINGS + place).cast("int")).drop("radius")
    found = ringed.groupBy("ring").agg(F.count("*"), F.max("far"), F.max("norm")).orderBy("ring").collect()
    number, rows, far, norm = (np.array(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 4
    return ringed, Rings(number.astype(np.int32), number.astype(int) // RINGS, rows, far, norm)


def top_k(vectors: DataFrame, *, k: int = 5, every: int = 50, scale: int = 256, pivots: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """The k best rows by integer inner product for each row whose vec_id is divisible by ``every``: (query_id, rank, vec_id, score).

    All other rows of ``vectors(vec_id, embedding)`` are candidates, the query's own vec_id is not; ties go to the smaller
    vec_id; with fewer candidates all are returned. Vectors that are null or hold null or non-finite components, and
    null vec_ids, take no part. Shorter vectors count as if zeros followed. A repeated row counts once. The sum of products
    has to fit 64 bits. The fit (pivots, sample) holds at most ``sample`` rows, chosen by hash; every row is searched exactly. Other columns are
    ignored.

    A ring of n rows that m queries can have results in moves n * ceil(m / QUERY_BLOCK) vectors and m * ceil(n / BLOCK) queries; a ring without
    such queries moves nothing. Results are cut to k a query in every task before they move.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "knn")
    data = scratch.keep(quantized(vectors, scale), "vectors")
    chosen = data.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(sample).collect()
    rows, width = data.agg(F.count("*"), F.max(F.size("v"))).first()
    width = width or 0
    sample_ids = np.array([r["vec_id"] for r in chosen], np.int64)
    known = _matrix([r["v"] for r in chosen], width, np.int64)
    _, once = np.unique(np.column_stack([sample_ids, known]), axis=0, return_index=True) if len(known) else (None, np.zeros(0, int))
    sample_ids, known = sample_ids[once], known[once]
    centres = choose_pivots(known, pivots or min(MOST_PIVOTS, max(16, math.isqrt(rows))))

    cells = scratch.keep(data.mapInArrow(_assign(centres, width), "vec_id long, v array<long>, cell int, far double, norm double"), "cells")
    ringed, rings = _rings(cells)
    queries = data.where(F.col("vec_id") % every == 0).distinct()
    routed = queries.mapInArrow(_route(centres, sample_ids, known, rings, k), "query_id long, q array<long>, least long, rings array<int>")
    routed = scratch.keep(routed, "routed")
    asked = dict(routed.select(F.explode("rings").alias("ring")).groupBy("ring").agg(F.count("*")).collect())
    plan = [(int(r), math.ceil(n / BLOCK), math.ceil(asked[r] / QUERY_BLOCK)) for r, n in zip(rings.number, rings.rows, strict=True) if r in asked]
    plan = F.broadcast(spark.createDataFrame(plan, "ring int, blocks int, parts int"))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ["ring", "block", "part"]
    # dealt by place, so that copies of one row are in many blocks
    sides = ringed.join(plan, "ring").withColumn("block", F.pmod(F.monotonically_increasing_id(), "blocks").cast("int")).withColumn("part", all_of("parts"))
    to = routed.withColumn("ring", F.explode("rings")).join(plan, "ring")
    to = to.withColumn("part", F.pmod(F.xxhash64("query_id"), "parts").cast("int")).withColumn("block", all_of("blocks"))
    near = (
        sides.select(*key, "vec_id", "v")
        .groupBy(*key)
        .cogroup(to.select(*key, "query_id", "q", "least").groupBy(*key))
        .applyInPandas(_solve(k, width), "query_id long, vec_id long, score long")
    )
    # copies of a row tie, so a dense rank counts them once
    rank = F.dense_rank().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").distinct()
