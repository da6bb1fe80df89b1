"""SentencePiece models run by the tokenizers library: the model's protobuf is read and its normaliser, space marker, scores or merges
and byte fallback are rebuilt there, and ids are compared with the sentencepiece library's.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.words import chunks, string_bytes

MARK = "▁"
#: Fixed values of the model format: model and piece types.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words that a worker remembers (about 40 MB); then it starts anew.
KNOWN_WORDS = 150_000
#: Words encoded as one text, and the threads that encode texts; more threads than cores cost CPU time.
GROUP, THREADS = 256, 2


def parse_model(raw: bytes):
    """The model's protobuf message. Types other than unigram and BPE are refused."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(raw)
    if model.trainer_spec.model_type not in (UNIGRAM, BPE):
        raise ValueError(f"model type {model.trainer_spec.model_type} is neither unigram nor BPE")
    return model


def merges_of(scores: dict[str, float]) -> list[tuple[str, str]]:
    """The pairs of pieces whose join is a piece, best score first; pairs of one piece follow the left part's order."""
    place = {piece: i for i, piece in enumerate(scores)}
    found = []
    for piece, score in scores.items():
        pairs = [(piece[:k], piece[k:]) for k in range(1, len(piece))]
        pairs = sorted((place[a], place[b], a, b) for a, b in pairs if a in place and b in place)
        found += [(-score, place[piece], i, a, b) for i, (_, _, a, b) in enumerate(pairs)]
    return [(a, b) for *_, a, b in sorted(found)]


def build_tokenizer(raw: bytes):
    """A tokenizers.Tokenizer with the ids and text of the sentencepiece model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    model = parse_model(raw)
    spec, pieces = model.normalizer_spec, model.pieces
    if model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("models with the space marker as suffix are not supported")
    unknown = next(i for i, p in enumerate(pieces) if p.type == UNKNOWN)
    fallback = model.trainer_spec.byte_fallback
    if model.trainer_spec.model_type == UNIGRAM:
        core = models.Unigram([(p.piece, p.score) for p in pieces], unk_id=unknown, byte_fallback=fallback)
    else:
        vocab = {p.piece: i for i, p in enumerate(pieces)}
        merges = merges_of({p.piece: p.score for p in pieces if p.type in (NORMAL, USER_DEFINED)})
        core = models.BPE(vocab=vocab, merges=merges, unk_token=pieces[unknown].piece, fuse_unk=True, byte_fallback=fallback)
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(spec.precompiled_charsmap)] if spec.precompiled_charsmap else []
    if spec.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.add_dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if spec.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    back = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence(back + ([decoders.Strip(" ", 1, 0)] if spec.add_dummy_prefix else []))
    own = [AddedToken(p.piece, normalized=False, special=False) for p in pieces if p.type == USER_DEFINED]
    if own:
        tokenizer.add_tokens(own)
    tokenizer.encode_special_tokens = True
    return tokenizer


def parts_at_spaces(model) -> bool:
    """Whether a text's ids are those of its space-separated words, one after the other.

    So it is if the normaliser only adds and escapes spaces and no piece has a marker behind another character: then no merge
    and no piece crosses from a word to the next one's marker.
    """
    spec = model.normalizer_spec
    plain = spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces and not spec.precompiled_charsmap
    return bool(plain and model.trainer_spec.byte_fallback and not any(MARK in p.piece.lstrip(MARK) or p.type == USER_DEFINED for p in model.pieces))


class Coder:
    """Both libraries on one model. Words met before are looked up; the rest, and texts with odd spaces, are encoded in batches."""

    def __init__(self, raw: bytes):
        import sentencepiece

        self.tokenizer = build_tokenizer(raw)
        self.processor = sentencepiece.SentencePieceProcessor()
        self.processor.LoadFromSerializedProto(raw)
        model = parse_model(raw)
        self.by_word = parts_at_spaces(model)
        self.marked = np.array([p.piece.startswith(MARK) for p in model.pieces])
        self.known: dict[str, bytes] = {}
        self.no_round_trip: set[str] = set()
        self.no_parity: set[str] = set()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    def compared(self, texts: list[str]) -> Iterator[tuple[bytes, bool, bool]]:
        """(ids as 32-bit integers, whether they decode to the text, whether sentencepiece has the same) of each text."""
        ids = self.encode(texts)
        for text, own, back, theirs in zip(texts, ids, self.decode(ids), self.processor.encode(texts, num_threads=1), strict=True):
            yield np.array(own, np.int32).tobytes(), back == text, own == theirs

    def compared_words(self, words: list[str]) -> Iterator[tuple[bytes, bool, bool]]:
        """``compared`` for words without spaces and markers, many to a text: a word's ids begin at each piece with a marker.

        A text where anything differs is compared word by word.
        """
        groups = [words[i : i + GROUP] for i in range(0, len(words), GROUP)]
        texts = [" ".join(g) for g in groups]
        for group, (raw, back, same) in zip(groups, self.compared(texts), strict=True):
            starts = np.flatnonzero(self.marked[np.frombuffer(raw, np.int32)]) * 4
            if back and same and len(starts) == len(group):
                ends = np.append(starts[1:], len(raw))
                yield from ((raw[x:y], True, True) for x, y in zip(starts.tolist(), ends.tolist(), strict=True))
            else:
                yield from self.compared(group)

    def documents(self, texts: list[str]) -> list[tuple[bytes, bool, bool]]:
        odd = {i for i, t in enumerate(texts) if not self.by_word or not t or "  " in t or MARK in t or t[0] == " " or t[-1] == " "}
        words = [[] if i in odd else t.split(" ") for i, t in enumerate(texts)]
        if len(self.known) > KNOWN_WORDS:
            self.known, self.no_round_trip, self.no_parity = {}, set(), set()
        new = list(dict.fromkeys(w for own in words for w in own if w not in self.known))
        for w, (ids, back, same) in zip(new, self.compared_words(new), strict=True):
            self.known[w] = ids
            if not back:
                self.no_round_trip.add(w)
            if not same:
                self.no_parity.add(w)
        whole = iter(self.compared([texts[i] for i in sorted(odd)]))
        known, failed = self.known, (self.no_round_trip, self.no_parity)
        return [
            next(whole) if i in odd else (b"".join([known[w] for w in own]), *(not f or f.isdisjoint(own) for f in failed))
            for i, own in enumerate(words)
        ]


@lru_cache(maxsize=2)
def _coder(raw: bytes) -> Coder:
    """Built once in a Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
    return Coder(raw)


_SCHEMA = "doc_id long, n_tokens int, ids array<int>, round_trip boolean, parity boolean"


def _encode(raw: bytes, at_once: int = 512):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(raw)
        for whole in batches:
            # by rows and by bytes, so that the words of one call are bounded however long its texts are
            offsets = string_bytes(whole.column(1))[1]
            for batch in (whole.slice(a + at, min(at_once, b - a - at)) for a, b in chunks(offsets, 4 << 20) for at in range(0, b - a, at_once)):
                given = batch.column(1).to_pylist()
                null = np.array([t is None for t in given])
                ids, back, same = zip(*coder.documents([t or "" for t in given]), strict=True)
                ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids])))
                offsets = pa.array(ends, pa.int32(), mask=np.append(null, False))
                flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).cast(pa.int64()),
                        pa.array(np.diff(ends), pa.int32()),
                        pa.ListArray.from_arrays(offsets, flat),
                        pa.array(np.array(back), mask=null),
                        pa.array(np.array(same), mask=null),
                    ],
                    ["doc_id", "n_tokens", "ids", "round_trip", "parity"],
                )

    return run


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """Encode every whole text and decode it again: (doc_id, n_tokens, ids, round_trip, parity), a row per row of ``docs``.

    ``round_trip``: decoding gives the text back, which a leading marker or a normaliser that changes it prevents; ``parity``: the
    sentencepiece library gives the same ids. Where a model allows it, both are found word by word, each distinct word once. Null texts: n_tokens 0, the rest null; empty texts have no ids. Control pieces
    spelt out in a text are ordinary text. The model is read once by the driver and sent with the tasks; its size is fixed. Other
    columns are ignored; no rows give none.
    """
    with open(model_path, "rb") as f:
        raw = f.read()
    return docs.select("doc_id", "text").mapInArrow(_encode(raw), _SCHEMA)


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of encoded(doc_id, ids), a row per row; null ids give a null text, no ids an empty one. No rows give none."""
    with open(model_path, "rb") as f:
        raw = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(raw)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            texts = coder.decode([x or [] for x in ids])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([None if x is None else t for x, t in zip(ids, texts, strict=True)], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
