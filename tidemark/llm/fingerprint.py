"""Bottom-k sketches of shingle hashes as document fingerprints.

A fingerprint is the k smallest distinct 48-bit hashes of a text's five-word shingles, ascending, eight base64 characters
each. A text with fewer shingles has all of them, and its figures are exact. The sketch of a union is the k
smallest of its parts' hashes, so sketches merge across parts of a document or corpus.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.words import column_sets

K, SHINGLE = 128, 5
_TOP = 1 << 48


def encode(values: np.ndarray) -> str:
    """Ascending 48-bit values as text."""
    return base64.b64encode(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (2, 0))).copy().view(">u8").reshape(-1).astype(np.uint64)


def sketches(texts: list[str | None], k: int = K, size: int = SHINGLE) -> list[np.ndarray]:
    """The k smallest shingle hashes of each text; null counts as empty, and a text without words has none."""
    return [np.unique((s >> np.uint64(16))[: k + 8])[:k] for s in column_sets(pa.array(texts, pa.large_string()), size)]


def merged(*parts: np.ndarray, k: int = K) -> np.ndarray:
    return np.unique(np.concatenate(parts))[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The share of the union's shingles that both have; 1 if both have none."""
    union = merged(a, b, k=k)
    if not len(union):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum()) / len(union)


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """The number of distinct shingles: exact below k, else estimated from how far k of them reach."""
    return float(len(a)) if len(a) < k else (k - 1) * _TOP / float(a[k - 1])


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The share of a's shingles that b has too; 1 if a has none."""
    if not len(a):
        return 1.0
    union = distinct_shingles(merged(a, b, k=k), k)
    return min(1.0, resemblance(a, b, k) * union / distinct_shingles(a, k))


@F.pandas_udf(T.DoubleType())
def resemblance_of(a, b):
    """Column form of ``resemblance`` for two fingerprint columns: null with a null, 1 for two empty ones."""
    return _pairwise(resemblance, a, b)


@F.pandas_udf(T.DoubleType())
def containment_of(a, b):
    """Column form of ``containment``: null with a null, 1 if the first is empty."""
    return _pairwise(containment, a, b)


@F.pandas_udf(T.DoubleType())
def distinct_of(a):
    """Column form of ``distinct_shingles``: null for null, 0 for an empty fingerprint."""
    return a.map(lambda x: None if x is None else distinct_shingles(decode(x)))


def _pairwise(f, a, b):
    import pandas as pd

    return pd.Series([None if x is None or y is None else f(decode(x), decode(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def merge_fingerprints(prints: DataFrame, key: str, fingerprint: str = "fingerprint", k: int = K) -> DataFrame:
    """(key, fingerprint): the fingerprint of all shingles of each key's rows. Null fingerprints count as empty, a null key is a key.

    Each task keeps the k smallest hashes of a key before they move, so a key with many rows costs k hashes a task. No rows give none.
    """
    hashes = F.pandas_udf(lambda xs: xs.map(lambda x: [] if x is None else decode(x).astype(np.int64)), "array<long>")
    told = F.pandas_udf(lambda xs: xs.map(lambda x: encode(np.sort(np.asarray([] if x is None else x, np.uint64)))), "string")
    rank = F.dense_rank().over(W.partitionBy("key").orderBy("v"))
    each = prints.select(F.col(key).alias("key"), F.explode(hashes(fingerprint)).alias("v")).withColumn("rank", rank).where(F.col("rank") <= k)
    merged = each.groupBy(F.col("key").alias("of")).agg(F.collect_set("v").alias("vs"))
    keys = prints.select(F.col(key).alias("key")).distinct()
    return keys.join(merged, keys["key"].eqNullSafe(merged["of"]), "left").select(F.col("key").alias(key), told("vs").alias(fingerprint))


def edited_text(own: str, after: str) -> str:
    """``own`` with its last floor(n/2) code points replaced by the first as many (or all) of ``after``."""
    half = len(own) // 2
    return own[: len(own) - half] + after[:half]


_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
    "near_next double, distinct_shingles double"
)


def _print_rows(rows: list[tuple[int | None, str, str]], k: int) -> pa.RecordBatch:
    """rows: (doc_id, text, the next document's text)."""
    texts = [t for _, t, _ in rows] + [rows[-1][2]]
    follows = all(a[2] is b[1] for a, b in zip(rows, rows[1:], strict=False))
    own = sketches(texts if follows else [t for _, t, _ in rows] + [t for *_, t in rows], k)
    after = own[1:] if follows else own[len(rows) :]
    edited = [edited_text(t, n) for _, t, n in rows]
    changed = sketches(edited, k)
    cells = [
        (i, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), encode(a), encode(c), resemblance(a, c, k), resemblance(a, b, k), distinct_shingles(a, k))
        for (i, t, _), e, a, b, c in zip(rows, edited, own, after, changed, strict=False)
    ]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells, strict=True), types, strict=True)], [x.split()[0] for x in _SCHEMA.split(", ")])


def _follow(k: int, at_once: int = 512, chars: int = 1 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple[int | None, str, str]] = []
        held, weight = None, 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                to, guest, _, text = row
                if held is not None and held[0] == to and not held[1]:
                    ready.append((held[2], held[3], text))
                    weight += len(text)
                    if len(ready) >= at_once or weight >= chars:
                        yield _print_rows(ready, k)
                        ready, weight = [], 0
                held = (to, guest, row[2], text)
        if ready:
            yield _print_rows(ready, k)

    return run


def edit_fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, in which the next document by descending doc_id follows its first half.

    A row per row of ``docs``: doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next (resemblance of the fingerprint to the edited text's and the next document's) and distinct_shingles. After the
    last document comes the first; a lone one follows itself. Null texts are empty. Null doc_ids come last; rows that tie
    in doc_id are ordered by text. Other columns are ignored; no rows give none.

    Texts move once: rows are dealt to ranges of doc_id, sorted and streamed, and each range's first row also
    goes to the range before, whose last row it follows. Range bounds and the ids of first rows are a row a range.
    """
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = sorted({int(b) for b in base.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 1 / (20 * ranges))}, reverse=True)
    over = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<long>"), lambda b: b >= F.col("doc_id")))
    home = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(over)
    based = base.withColumn("home", home)
    firsts = sorted(tuple(r) for r in based.groupBy("home").agg(F.max("doc_id")).collect())
    guests = [(top, of, firsts[i - 1][0]) for i, (of, top) in enumerate(firsts)]
    schema = "top long, of int, before int"
    by_home = F.broadcast(spark.createDataFrame(guests, schema))
    first = based["doc_id"].eqNullSafe(by_home["top"])
    to = F.array(F.struct(F.col("home").alias("to"), F.lit(False).alias("guest")))
    both = F.concat(to, F.array(F.struct(F.col("before").alias("to"), F.lit(True).alias("guest"))))
    dealt = based.join(by_home, based["home"] == by_home["of"]).select(F.explode(F.when(first, both).otherwise(to)).alias("at"), "doc_id", "text")
    dealt = dealt.select("at.to", "at.guest", "doc_id", "text").repartitionById(ranges, "to")
    ordered = dealt.sortWithinPartitions("to", "guest", F.col("doc_id").desc_nulls_last(), "text")
    return ordered.mapInArrow(_follow(k), _SCHEMA)
