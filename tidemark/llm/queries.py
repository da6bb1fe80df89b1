"""The queries of the training-corpus operators, each over a whole table, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.centroids import cluster
from tidemark.llm.fingerprint import edit_fingerprints
from tidemark.llm.knn import top_k
from tidemark.llm.language import identify
from tidemark.llm.lm import score_documents
from tidemark.llm.minhash import near_groups
from tidemark.llm.mixing import mix
from tidemark.llm.quality import quality
from tidemark.llm.rules import quality_rules
from tidemark.llm.spelling import variants
from tidemark.llm.spm import encode_documents
from tidemark.llm.toxicity import toxicity
from tidemark.llm.warc import archive_and_read

#: A SentencePiece model of the installed vocabulary files.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), folds=5, held=0, threshold=0.5)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"), folds=4, held=2)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"), PIECES)


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), folds=5, held=0, threshold=0.3)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, cap=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_and_read(_table(spark, sf_dir, "pages")).drop("target_uri")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprints(_table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(_table(spark, sf_dir, "embeddings"), k=8, rounds=10, width=64, scale=1024, seed=3)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(_table(spark, sf_dir, "documents"), shortest=5, least=3, every=97, factor=2)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_language_id": op3_language_id,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_quality": op6_quality,
    "op7_mix_sources": op7_mix_sources,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_warc": op9_warc,
    "op10_fingerprints": op10_fingerprints,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_quality_rules": op13_quality_rules,
}

OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END AS s
  FROM words
), each AS (SELECT doc_id, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM each a JOIN each b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sets p ON p.doc_id = x JOIN sets q ON q.doc_id = y WHERE 100 * n >= 85 * (len(p.s) + len(q.s) - n)),
ends AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM reach r JOIN ends e ON r.y = e.x),
least_id AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, CAST(coalesce(len(s), 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least_id USING (doc_id)
"""

OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP9_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM m
"""


def _round_sql(n: int, last: bool) -> str:
    """A round of ``op11``: near_n has the cluster of each vector by the centroids c_n, c_n+1 their floors of means."""
    near = f"""near_{n} AS MATERIALIZED (
  SELECT vec_id, v, min(struct_pack(d := CAST(list_inner_product(v, v) - 2 * list_inner_product(v, m) + list_inner_product(m, m) AS BIGINT), c := c)) AS best
  FROM kept, c_{n} GROUP BY vec_id, v
)"""
    moved = f""", c_{n + 1} AS MATERIALIZED (
  SELECT c, coalesce(means.m, c_{n}.m) AS m FROM c_{n} LEFT JOIN (
    SELECT c, list(CAST(floor(s / k) AS DOUBLE) ORDER BY i) AS m FROM (
      SELECT best.c AS c, i, CAST(sum(v[i]) AS DOUBLE) AS s, count(*) AS k FROM near_{n}, range(1, 65) r(i) GROUP BY ALL
    ) GROUP BY c
  ) means USING (c)
)"""
    return near + ("" if last else moved)


OP11_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c_0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS INTEGER) AS c, v AS m FROM (SELECT * FROM kept ORDER BY sha256('3:' || vec_id) LIMIT 8)
), {", ".join(_round_sql(n, n == 10) for n in range(11))}
SELECT vec_id, best.c AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(m, lambda x: CAST(x AS BIGINT)::VARCHAR), ',')) AS centroid_sha256
FROM near_10 JOIN c_10 ON c_10.c = best.c
"""

# DuckDB has no crc32: bytes by code point (all are below U+0100), then a table of 256 steps.
OP12_SQL = r"""
WITH RECURSIVE table_ AS MATERIALIZED (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)
), tokens AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS w FROM documents
), lowered AS (
  SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS k FROM tokens GROUP BY ALL
), hashed AS MATERIALIZED (
  SELECT w, k, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id || ':' || w, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END))),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) AS h FROM lowered, table_
), runs AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, k FROM hashed
), words AS MATERIALIZED (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM runs WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM (SELECT *, unnest(range(0, length(word))) AS i FROM words)),
pairs AS (
  SELECT x.word AS x, y.word AS y FROM less x JOIN less y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT l.word, w.word FROM less l JOIN words w ON w.word = l.a || l.b
  UNION SELECT w.word, l.word FROM less l JOIN words w ON w.word = l.a || l.b
), near AS MATERIALIZED (
  SELECT x AS word, count(*) AS n_near, min(struct_pack(m := -n, w := y)) AS best FROM pairs JOIN words ON word = y GROUP BY x
), each AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 2 * n THEN best.w END AS form, CASE WHEN -best.m >= 2 * n THEN -best.m END AS form_n FROM words LEFT JOIN near USING (word)
), follow AS (
  SELECT word, word AS at FROM each UNION ALL SELECT f.word, e.form FROM follow f JOIN each e ON f.at = e.word WHERE e.form IS NOT NULL
), ends AS (SELECT f.word, f.at AS root FROM follow f JOIN each e ON f.at = e.word WHERE e.form IS NULL)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM each JOIN ends USING (word)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": OP1_SQL,
    "op5_exact_top_k": OP5_SQL,
    "op9_warc": OP9_SQL,
    "op11_centroid_clustering": OP11_SQL,
    "op12_spelling_variants": OP12_SQL,
}
