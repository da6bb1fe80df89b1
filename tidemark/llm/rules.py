"""Quality rules: counts of words, symbols and repetition, and bands of compression ratios.

zstandard packs prose to between a half and a third of its bytes, the more so the longer the text. What packs far better repeats itself, what hardly packs is
no prose. A text is held against the band of its length as a whole, and its fixed chunks against theirs, so that a part that is out of band is not
hidden by the rest.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import bound_batches

#: (bytes from which a band holds, the lowest and the highest ratio in it). Shorter texts are mostly the compressor's own header.
BANDS = ((128, 0.9, 3.0), (512, 1.2, 3.2), (2048, 1.35, 3.6), (8192, 1.4, 4.2), (65536, 1.4, 5.0))
#: Bytes of a chunk, and the share of a text's bytes that may be in chunks out of band.
CHUNK, OUT_OF_BAND, LEVEL = 4096, 0.25, 3

# Fixed values of the contract: what parts words, what counts as a symbol, and the words of a window.
SPACE, SYMBOLS, WINDOW = b" \t\n\v\f\r", b"#*$%&|<>", 8
_CONTINUATION = bytes(range(0x80, 0xC0))


def ratio(data: bytes, packer: zstandard.ZstdCompressor) -> float:
    return len(data) / len(packer.compress(data))


def in_band(size: int, found: float) -> bool:
    """Whether a ratio is in the band of so many bytes; fewer than the first band's are in any."""
    at = bisect_right([b[0] for b in BANDS], size) - 1
    return at < 0 or BANDS[at][1] <= found <= BANDS[at][2]


def compression(data: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, float, str]:
    """(ratio of the whole text, share of its bytes in chunks out of band, verdict: kept, repetitive, incompressible or chunks)."""
    if not data:
        return 0.0, 0.0, "kept"
    whole = ratio(data, packer)
    if not in_band(len(data), whole):
        return whole, 0.0, "repetitive" if whole > 1.5 else "incompressible"
    chunks = (data[at : at + CHUNK] for at in range(0, len(data), CHUNK)) if len(data) > CHUNK else ()
    out = sum(len(c) for c in chunks if not in_band(len(c), ratio(c, packer))) / len(data)
    return whole, out, "chunks" if out > OUT_OF_BAND else "kept"


def _ranked(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words are in a run of ``window`` words that the text has twice or more, the first of them included.

    Runs get equal numbers only if their words are equal: numbers of runs of 1, 2, 4, ... words are ranks of pairs of numbers.
    """
    runs = len(words) - window + 1
    if runs < 2:
        return 0
    number = {w: i for i, w in enumerate(set(words))}
    if len(number) == len(words):
        return 0
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    size = 1
    while size < window:  # the last step overlaps where window is no power of two
        step = min(size, window - size)
        ids = _ranked(ids[:-step] * (int(ids.max()) + 1) + ids[step:])
        size += step
    twice = np.flatnonzero(np.bincount(ids)[ids] > 1)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def repeated_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[bytes] = set()
    found = 0
    for line in data.split(b"\n"):
        if line in seen:
            found += bool(line.strip(SPACE))
        seen.add(line)
    return found


_RULES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, out_of_band double, verdict string"
_TYPES = (*[pa.int64()] * 6, pa.bool_(), pa.bool_(), pa.float64(), pa.float64(), pa.string())


def judge(data: bytes, packer: zstandard.ZstdCompressor) -> tuple:
    """The columns of ``quality_rules`` but doc_id, of a text in UTF-8."""
    words = data.split()  # at the bytes of SPACE
    n, again = len(words), repeated_words(words)
    chars = len(data.translate(None, SPACE + _CONTINUATION))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    failed = n < 20 or 100 * again > 30 * n
    whole, out, verdict = compression(data, packer)
    return n, chars, symbols, repeated_lines(data), again, failed, not failed and verdict == "kept", whole, out, verdict


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=LEVEL)
    names = [c.split()[0] for c in _RULES.split(", ")]
    for batch in batches:
        rows = [judge(data or b"", packer) for data in batch.column(1).cast(pa.large_binary()).to_pylist()]
        columns = zip(*rows, strict=True) if rows else [()] * (len(names) - 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, _TYPES[1:], strict=True))], names)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts and verdict of each row of ``docs(doc_id, text)``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and
    the ratio, the share of bytes out of band and the verdict of compression.

    ``base_failed`` is true below 20 words, or where more than 30 % of words are in repeated windows; ``kept`` is false then, else whether the text and all
    but a quarter of its bytes, by chunks, are within BANDS. A null text counts as empty: no words, failed, ratio 0. Repeated rows get equal results, no rows none;
    a null doc_id stays null. Other columns are ignored. A row at a time and without a shuffle: a text's cost is its own length.
    """
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_run, _RULES)
