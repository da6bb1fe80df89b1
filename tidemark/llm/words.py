"""Word and shingle hashes of Arrow string columns, computed over their UTF-8 bytes with numpy.

A word is a run of bytes other than space and 0x09-0x0D; A-Z count as a-z. Hashes have 64 bits and depend
on the words alone, so they agree across tasks, runs and machines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _BASE + np.uint64(seed)) | np.uint64(1)


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `limit` bytes each, at least one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def separators(word_bytes: bytes) -> np.ndarray:
    """A table that makes every byte but ``word_bytes`` a separator."""
    table = np.ones(256, bool)
    table[list(word_bytes)] = False
    return table


def placed_words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a hash for each word in order, the number of words of each row, where each word starts in ``data``)."""
    rows = len(offsets) - 1
    space = space[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = True
    after[inner - 1] = True
    starts = np.flatnonzero(~space & before)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64), starts
    lengths = np.flatnonzero(~space & after) + 1 - starts
    first = np.cumsum(lengths) - lengths
    powers = np.cumprod(np.full(int(lengths.max()), _BASE, np.uint64))
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    values = (_LOWER[data[~space]].astype(np.uint64) + np.uint64(1)) * powers[place]
    counts = np.diff(np.searchsorted(starts, offsets))
    return mix(np.add.reduceat(values, first)), counts, starts


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a hash for each word in order, the number of words of each row)."""
    return placed_words(data, offsets)[:2]


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(a hash for each run of `size` words in order, the number of runs of each row).

    A row with fewer words has its whole sequence as one shingle; a row without words has none.
    """
    ends = np.cumsum(counts)
    n, factors = len(hashes), seeds(size, 77)
    total = np.zeros(n, np.uint64)
    whole = np.repeat(counts >= size, counts)
    for k in range(min(size, n)):
        total[: n - k] += (hashes[k:] if k else hashes) * factors[k]
    keep = whole.copy()
    for k in range(1, size):
        last = (ends - k)[counts >= size]
        keep[last] = False
    short = np.flatnonzero((counts > 0) & (counts < size))
    for i in short:  # at most size - 1 words each
        own = hashes[ends[i] - counts[i] : ends[i]]
        total[ends[i] - counts[i]] = np.sum(own * factors[: counts[i]]) + np.uint64(counts[i])
    keep[(ends - counts)[short]] = True
    return mix(total[keep]), np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    values, counts = shingles(*word_hashes(data, offsets), size)
    at = 0
    for n in counts:
        own = np.sort(values[at : at + n])
        at += n
        yield own if n < 2 else own[np.concatenate(([True], own[1:] != own[:-1]))]


def column_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """``shingle_sets`` of a whole column, some rows at a time."""
    data, offsets = string_bytes(column)
    for lo, hi in chunks(offsets):
        yield from shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
