from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest

from tidemark.llm import spm
from tidemark.llm.queries import PIECES

MODEL = Path(PIECES)
needs_model = pytest.mark.skipif(not MODEL.exists(), reason="the vocabulary files are not here")
PARTS = [" ", "  ", "   ", "▁", "a", "e", "th", "ing", "\n", "\t", "é", "ß", "日本", "😀", "<s>", "</s>", "<unk>", "<0x41>", "\x00", "!", "12", "=====", "//", "\r\n", "the ", "        "]


@needs_model
def test_parity_and_round_trip_on_odd_strings():
    coder = spm.Coder(MODEL.read_bytes())
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    theirs = coder.processor.encode(texts)
    for text, (ids, back, same), want in zip(texts, coder.documents(texts), theirs, strict=True):
        assert np.frombuffer(ids, np.int32).tolist() == want and same
        assert back == (coder.processor.decode(want) == text)


@needs_model
def test_words_are_encoded_as_in_the_text():
    coder = spm.Coder(MODEL.read_bytes())
    text = "The quick brown fox,\njumps over the lazy dog. " * 20 + "end"
    ((ids, back, same),) = coder.documents([text])
    assert np.frombuffer(ids, np.int32).tolist() == coder.encode([text])[0] and back and same and len(coder.known) == 9


@needs_model
def test_encode_and_decode(spark, docs):
    rows = [(1, "Hello world"), (2, None), (3, ""), (None, "x"), (1, "Hello world"), (4, "é" * 50_000), (5, " lead")]
    out = spm.encode_documents(docs(*rows), PIECES)
    got = sorted(out.collect(), key=lambda r: (str(r["doc_id"]), str(r["ids"])))
    assert len(got) == len(rows) and all(r["parity"] in (True, None) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert (by[2]["n_tokens"], by[2]["ids"], by[2]["round_trip"]) == (0, None, None) and (by[3]["n_tokens"], by[3]["ids"], by[3]["round_trip"]) == (0, [], True)
    texts = {r["doc_id"]: r["text"] for r in spm.decode_documents(out, PIECES).collect()}
    assert texts == dict(rows)
    assert spm.encode_documents(docs("a").limit(0), PIECES).count() == 0


def _model(kind, pieces, **normalizer):
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback, m.trainer_spec.unk_id = kind, True, 0
    m.normalizer_spec.name = "identity"
    for k, v in ({"add_dummy_prefix": True, "remove_extra_whitespaces": False, "escape_whitespaces": True} | normalizer).items():
        setattr(m.normalizer_spec, k, v)
    for piece, score, t in [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{i:02X}>", 0.0, 6) for i in range(256)), *((p, s, 1) for p, s in pieces)]:
        x = m.pieces.add()
        x.piece, x.score, x.type = piece, score, t
    return m.SerializeToString()


UNIGRAM = [("▁", -2.0), ("a", -3.0), ("b", -3.5), ("ab", -4.0), ("▁a", -3.2), ("▁ab", -5.1), ("abab", -7.0), ("ba", -5.0), ("c", -6.0), ("▁c", -6.5), ("é", -7.5)]


@pytest.mark.parametrize("normalizer", [{}, {"remove_extra_whitespaces": True}, {"add_dummy_prefix": False}])
def test_unigram_scores(normalizer):
    """A unigram model written for this test: best segmentations, byte fallback and white space as sentencepiece has them."""
    coder = spm.Coder(_model(spm.UNIGRAM, UNIGRAM, **normalizer))
    rng = random.Random(7)
    texts = ["".join(rng.choice(["a", "b", "ab", "c", " ", "  ", "é", "日"]) for _ in range(rng.randint(0, 12))) for _ in range(800)]
    assert [np.frombuffer(ids, np.int32).tolist() for ids, *_ in coder.documents(texts)] == coder.processor.encode(texts)


def test_other_model_types_are_refused():
    with pytest.raises(ValueError, match="neither"):
        spm.parse_model(_model(3, UNIGRAM))


def test_merges():
    assert spm.merges_of({"a": 0.0, "b": 0.0, "ab": -1.0, "aba": -2.0}) == [("a", "b"), ("ab", "a")]


@needs_model
def test_pipeline_stages(spark, docs, tmp_path):
    """Each stage's decisions against brute force on its own input."""
    import corpus_pipeline as P

    from tests.llm.test_minhash import brute
    from tests.llm.test_models import LABELS, _corpus

    rows, labels = _corpus(300)
    rows += [(1000 + i, t + (" extra" if i % 2 else ""), *rest) for i, (_, t, *rest) in enumerate(rows[:40])] + [(2000, None, "en", "s0"), (2001, "12 34", "en", "s0"), (2002, "", None, None)]
    # letters of no learned language go, a text whose language is not given stays
    rows += [(2003, "жъ фщ эю " * 30, None, "s0"), (2004, "qxzj vkwq " * 30, None, "s1"), (2005, rows[7][1] + " more", None, "s1")]
    df = docs(*rows).drop("id", "n")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    assert [name for name, _ in P.STAGES] == ["language_id", "quality_classifier", "near_dedup", "source_mix", "encode"]
    out, kept = df, []
    for i, (_, stage) in enumerate(P.STAGES):
        after = stage(spark, out, str(tmp_path))
        after.write.parquet(str(tmp_path / f"stage{i}"))
        after = spark.read.parquet(str(tmp_path / f"stage{i}"))
        if i < 4:
            assert after.columns == df.columns
        kept.append(after)
        out = after
    ids = [{r["doc_id"] for r in k.select("doc_id").collect()} for k in kept]
    assert ids[0] == {r[0] for r in rows} - {2000, 2001, 2002, 2003, 2004}
    assert kept[0].where("doc_id = 2005").first()["lang"] == rows[7][2] and kept[0].where("lang is null").isEmpty()
    low = {i for i, q, _ in labels if not q} | {1000 + i for i, q, _ in labels[:40] if not q}
    assert len(ids[0] - ids[1] - low) <= 2 and len(low & ids[1]) <= 4
    texts = {r[0]: r[1] for r in rows}
    groups = brute([(i, texts[i]) for i in ids[1]], 5, 80)
    assert ids[2] == {i for i, (_, c) in groups.items() if i == c}
    words = sum(len(t.split()) for t in (texts[i] for i in ids[2]))
    mixed = sum(len(r["text"].split()) for r in kept[3].collect())
    assert abs(mixed - 1.5 * words) <= 10 and ids[3] <= ids[2]
    assert kept[4].count() == kept[3].count() and kept[4].where("not parity or not round_trip").count() == 0
    ran = P.run(spark, str(tmp_path))
    assert sorted((r["doc_id"], r["n_tokens"]) for r in ran.collect()) == sorted((r["doc_id"], r["n_tokens"]) for r in kept[4].collect())


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="the driver's tables are not here")
def test_ids_are_those_of_whole_texts(spark):
    """Words are encoded apart and put together; the sentencepiece library on whole texts gives the same ids and the texts back."""
    import sentencepiece

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = spm.encode_documents(docs, PIECES)
    for r in got.collect():
        assert r["ids"] == whole.encode(texts[r["doc_id"]]) and r["parity"]
    back = {r["doc_id"]: r["text"] for r in spm.decode_documents(got, PIECES).collect()}
    assert all(back[r["doc_id"]] == texts[r["doc_id"]] for r in got.where("round_trip").collect())


def test_pipeline_stages_on_an_empty_table(spark, docs, tmp_path):
    import corpus_pipeline as P

    from tests.llm.test_models import LABELS

    none = docs("a").limit(0)
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in P.STAGES:
        out = stage(spark, none, str(tmp_path))
        assert out.count() == 0 and (name == "encode" or out.columns == none.columns)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["op1_minhash_near_dedup", "op5_exact_top_k", "op9_warc"])
def test_queries_equal_sql(spark, name):
    import duckdb

    from tests.test_entry import _rows
    from tidemark.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for p in Path("/root/testdata/sf0.001").glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got, want = QUERIES[name](spark, "/root/testdata/sf0.001"), con.sql(ORACLE_SQL[name])
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(want.columns, want.fetchall())
