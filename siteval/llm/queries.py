"""One query per operator over the whole of its table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siteval.llm import (bpe_codec, fingerprints, html_text, mixing, near_dup, ngram_join, quality, retrieval_packing, secrets, spelling,
                         token_counts, token_files, whitening)
from siteval.llm.common import scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "byte_bpe_50k.json"
WORD_TOKENIZER = "word_bpe_49k.json"
END_ID = 2


def tokenizer_path() -> str:
    return public_tokenizers.path(TOKENIZER)


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op3_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.main_texts(pages, html_text.learn(pages))


@query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token-files")
    files = token_files.write(table(spark, sf_dir, "documents"), folder, tokenizer_path(), END_ID)
    return token_files.read_documents(spark, files)


@query
def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


@query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


@query
def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.digests(table(spark, sf_dir, "documents"))


@query
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents"))


@query
def op11_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER), END_ID)


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


ORACLES["op9_mix_sources"] = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(sha256('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
         row_number() OVER (ORDER BY encode(source) NULLS LAST) AS rnk
  FROM sizes GROUP BY source),
weighed AS (SELECT *, (rnk - 1) % 3 + 1 AS weight FROM src),
level AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
         sum(weight) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest,
         sum(source_size) OVER ()::BIGINT AS total
  FROM weighed),
lam AS (SELECT *, (total - before)::DOUBLE / rest AS lam FROM level),
fin AS (SELECT min_by(lam, before) AS final FROM lam WHERE cap > weight * lam),
targets AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce(weight * (SELECT final FROM fin), cap::DOUBLE)) AS target FROM lam),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target)::BIGINT AS quota,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(start + size, quota) - start)
        + greatest(0, least(source_size + start + size, quota) - source_size - start)
        + greatest(0, least(2 * source_size + start + size, quota) - 2 * source_size - start))::BIGINT AS taken
FROM placed
"""

ORACLES["op1_embedding_near_dedup"] = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach(id, root) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id),
least AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN least c ON c.id = e.vec_id LEFT JOIN degree d ON d.a = e.vec_id
"""

ORACLES["op10_ngram_jaccard_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM words),
grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * n >= 75 * (len(x.s) + len(y.s) - n)),
reach(id, root) AS (
  SELECT doc_id, doc_id FROM sets
  UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id),
least AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN least ON id = doc_id
"""
