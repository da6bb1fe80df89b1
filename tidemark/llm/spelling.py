"""Spelling variants: words one edit apart, found by dense tiles of prefix and suffix lengths.

Two words that differ by one inserted, deleted or replaced code point share the first half of the shorter one, or its last half. Words are
dealt by such halves; the words of a half, in blocks where they are many, make padded matrices of code points, and a tile compares a
block with a block: position by position from the left and from the right, for all pairs at once. A pair is near if common prefix and
suffix together reach the longer length less one. No pair leaves a tile: a tile tells each word how many near words it has there and
the most frequent of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.ordering import small
from tidemark.llm.scratch import Scratch, bound_batches

#: Words of a block, code points of its matrix (longer words make smaller blocks), pairs that are compared at once, and rows that wait for it.
BLOCK, BLOCK_POINTS, CELLS, WAITING = 2048, 1 << 17, 1 << 22, 1 << 16
#: Rounds of pointer jumping: a form is at least twice as frequent as its word, so 64 forms follow each other at most.
JUMPS = 7

# What the contract takes as a letter.
RUN = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, *, run: str = RUN, every: int = 97, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n): how often each word occurs in ``docs(doc_id, text)``, for words of ``shortest`` code points that occur ``least`` times.

    A word is a maximal match of ``run`` with A-Z lower-cased, less a code point where ``every`` divides the crc32 of ``<doc_id>:<word>``: the one at the
    crc32 modulo its length. Without a doc_id none is taken away; null texts have no words.
    """
    token = F.translate(F.col("token"), _UPPER, _LOWER)
    tokens = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(run), F.lit(0))).alias("token")).select("doc_id", token.alias("token"))
    hashed = tokens.withColumn("h", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "token").cast("binary")))
    at = (F.col("h") % F.length("token")).cast("int")
    less = F.concat(F.substring("token", F.lit(1), at), F.substring("token", at + 2, F.length("token")))
    words = hashed.select(F.when(F.col("h") % every == 0, less).otherwise(F.col("token")).alias("word"))
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _halves(shortest: int) -> Column:
    """Where a word is compared: with words as long as it or one longer, and with words one shorter, by first and by last half of the shorter."""
    length, places = F.length("word"), []
    for less in (0, 1):
        of = length - less
        half = F.floor(of / 2).cast("int")
        for last in (0, 1):
            part = F.right("word", of - half) if last else F.substring("word", F.lit(1), half)
            fits = of >= shortest
            places.append(F.when(fits, F.struct(of.alias("of"), F.lit(last).alias("last"), F.xxhash64(part).alias("half"))))
    return F.filter(F.array(*places), lambda p: p.isNotNull())


def _blocks_of(of: Column, rows: Column) -> Column:
    """Blocks for so many words of a length: at most BLOCK words and BLOCK_POINTS code points each, on average."""
    return F.ceil(rows / F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_POINTS) / of)))).cast("int")


_PLACE = ["of", "last", "half"]
_TILE = [*_PLACE, "i", "j"]


def tiles(words: DataFrame, shortest: int) -> DataFrame:
    """words(word, n) at each of their places, with the tile (i, j) and their block in it, dealt and sorted by tile and block, then most frequent first."""
    placed = words.select("word", "n", F.explode(_halves(shortest)).alias("p")).select("word", "n", "p.*")
    many = placed.groupBy(*_PLACE).agg(F.count("*").alias("rows")).withColumn("blocks", _blocks_of(F.col("of"), F.col("rows"))).where("blocks > 1").drop("rows")
    blocked = placed.join(small(many), _PLACE, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    blocked = blocked.withColumn("block", F.pmod(F.xxhash64("word"), "blocks").cast("int"))
    dealt = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*_PLACE, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "word", "n")
    return dealt.repartition(*_TILE).sortWithinPartitions(*_TILE, "block", F.desc("n"), "word")


def _points(words: list[str]) -> np.ndarray:
    """Words as rows of code points, padded by zeros."""
    points = np.array(words, dtype=str).view(np.uint32).reshape(len(words), -1)
    return points.astype(np.uint8) if points.max(initial=0) < 256 else points


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common head of every row of a[g] with every row of b[g]; equal padding counts."""
    alive = np.ones((len(a), a.shape[1], b.shape[1]), bool)
    length = np.zeros(alive.shape, np.int8 if a.shape[2] < 128 else np.int32)
    step = max(1, CELLS // alive.size)
    for k in range(0, a.shape[2], step):
        if step == 1:
            alive &= a[:, :, None, k] == b[:, None, :, k]
            length += alive
        else:
            same = a[:, :, None, k : k + step] == b[:, None, :, k : k + step]
            length += np.where(alive, np.logical_and.accumulate(same, axis=3).sum(axis=3), 0).astype(length.dtype)
            alive &= same.all(axis=3)
        if not alive.any():
            break
    return length


class _Words:
    """Words of tiles in order, as matrices from the left and from the right."""

    def __init__(self, words: list[str], of: np.ndarray, last: np.ndarray):
        self.length = np.array([len(w) for w in words])
        self.heads, self.tails = _points(words), _points([w[::-1] for w in words])
        self.of, self.last = of, last

    def near(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, near words among its b, the first of them) for rows a[g], held against rows b[g] of the same tile; -1 stands for no row."""
        la, lb = self.length[a][:, :, None], self.length[b][:, None, :]
        shorter, longer = np.minimum(la, lb), np.maximum(la, lb)
        head, tail = (np.minimum(_shared(m[a], m[b]), shorter) for m in (self.heads, self.tails))
        # a pair is told where it shares the first half, else where it shares the last
        of, last = self.of[b[:, 0]][:, None, None], self.last[b[:, 0]][:, None, None] == 1
        hits = (longer - shorter <= 1) & (head + tail >= longer - 1) & (shorter == of) & ((head >= of // 2) != last)
        hits &= (a[:, :, None] != b[:, None, :]) & (a >= 0)[:, :, None] & (b >= 0)[:, None, :]
        g, x = np.nonzero(hits.any(axis=2))
        return a[g, x], hits[g, x].sum(axis=1), b[g, hits[g, x].argmax(axis=1)]


def _strips(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts of the rows of ``a`` with all of ``b``: so many pairs at once as CELLS."""
    step = max(1, CELLS // max(1, b.size))
    for at in range(0, a.shape[1], step):
        yield a[:, at : at + step], b


def _stacked(starts: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of tiles of one block, those of about one size stacked, filled by -1."""
    power = np.ceil(np.log2(np.maximum(sizes, 2))).astype(int)
    for p in np.unique(power):
        own = np.flatnonzero(power == p)
        step, place = max(1, CELLS >> (2 * int(p))), np.arange(sizes[own].max())[None]
        for at in range(0, len(own), step):
            part = own[at : at + step]
            yield np.where(place < sizes[part][:, None], starts[part][:, None] + place, -1)


def _pairs(starts: np.ndarray, ends: np.ndarray, i: np.ndarray, j: np.ndarray, block: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What is held against what: a block with itself, and in a tile of two blocks each with the other."""
    alone = i[starts] == j[starts]
    many = (ends - starts > 1) & alone
    for rows in _stacked(starts[many], (ends - starts)[many]):
        yield from _strips(rows, rows)
    for at, end in zip(starts[~alone], ends[~alone], strict=True):
        cut = at + int(np.searchsorted(block[at:end], j[at]))
        if at < cut < end:
            one, two = np.arange(at, cut)[None], np.arange(cut, end)[None]
            yield from _strips(one, two)
            yield from _strips(two, one)


_FOUND = "word string, near long, form_n long, form string"


def _solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Whole tiles in order -> for each word and tile where it has near words: how many, and the first of them."""
    column = {c: table.column(c).to_numpy() for c in (*_TILE, "block", "n")}
    new = np.ones(len(table), bool)
    new[1:] = np.any([column[c][1:] != column[c][:-1] for c in _TILE], axis=0)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(table))
    lengths, at = column["of"][starts], 0
    while at < len(starts):  # tiles whose words are about as long, so that padding is bounded
        to = int(np.searchsorted(lengths, 2 * lengths[at], "right"))
        lo, hi = starts[at], ends[to - 1]
        part = table.slice(lo, hi - lo)
        words = _Words(part.column("word").to_pylist(), column["of"][lo:hi], column["last"][lo:hi])
        held = _pairs(starts[at:to] - lo, ends[at:to] - lo, *(column[c][lo:hi] for c in ("i", "j", "block")))
        for row, near, form in (words.near(a, b) for a, b in held):
            if len(row):
                pick = lambda c, rows: part.column(c).take(pa.array(rows)).combine_chunks()  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pick("word", row), pa.array(near.astype(np.int64)), pick("n", form), pick("word", form)], ["word", "near", "form_n", "form"])
        at = to


def _whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= WAITING or sum(b.nbytes for b in waiting) >= WAITING * 64:
            table = pa.Table.from_batches(waiting)
            last = {c: table.column(c)[-1].as_py() for c in _TILE}
            begun = np.all([table.column(c).to_numpy() == v for c, v in last.items()], axis=0)
            cut = int(begun.argmax())  # rows are sorted, so the last tile is one run
            if cut:
                yield from _solve(table.slice(0, cut))
                waiting = table.slice(cut).to_batches()
    if sum(b.num_rows for b in waiting):
        yield from _solve(pa.Table.from_batches(waiting))


def near_words(words: DataFrame, *, shortest: int = 5, factor: int = 2) -> DataFrame:
    """(word, n_near, form, form_n) of the words of words(word, n) that have near words; no form where the most frequent one is not ``factor`` times as frequent.

    Words are distinct, not null, and have ``shortest`` code points at least.
    """
    found = tiles(words, shortest).mapInArrow(_whole_tiles, _FOUND)
    most = F.min(F.struct((-F.col("form_n")).alias("rank"), F.col("form").alias("form"))).alias("best")
    best = found.groupBy("word").agg(F.sum("near").alias("n_near"), most).join(words, "word")
    fits = -F.col("best.rank") >= factor * F.col("n")
    return best.select("word", "n_near", F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.rank")).alias("form_n"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of forms(word, form): where forms end. Each round doubles how far a word has got; as each form is twice as frequent, rounds are few."""
    reached = forms.select("word", F.col("form").alias("root"))
    for turn in range(JUMPS):
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = scratch.keep(reached.join(onward, "root", "left"), f"roots-{turn}")
        reached = jumped.select("word", F.coalesce("next", "root").alias("root"))
        if jumped.where(F.col("next").isNotNull()).isEmpty():
            break
    return reached


def variants(docs: DataFrame, *, shortest: int = 5, least: int = 3, every: int = 97, factor: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the words of ``docs(doc_id, text)`` as in ``word_counts``, grouped by spelling.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. A word's form is its most frequent near word, ties to the
    smaller by code points, if that is ``factor`` times as frequent; its root is what its forms end in, itself without one. ``n_near`` counts near words.
    Null and empty texts have no words; repeated rows count as often as they are there; no rows give none. Other columns are ignored.

    A place (a half of a word, and a length) of m words costs ceil(m / BLOCK) copies of each of them, all compared in tiles of two blocks. That is quadratic in the words that
    share a half; half of a five-letter word is two letters or three. Nothing is cut off.
    """
    bound_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.keep(word_counts(docs, every=every, shortest=shortest, least=least), "words")
    near = scratch.keep(near_words(words, shortest=shortest, factor=factor), "near")
    ends = roots(near.where(F.col("form").isNotNull()), scratch)
    out = words.join(near, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
