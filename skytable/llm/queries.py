"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skytable.llm import ball_tree, bpe, context_mixing, divergence, exact_dedup, filters, language, mixing, ngram_join, paragraphs, pii, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def query(name: str, sql: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_warc_salvage", """
WITH t AS (SELECT page_id, COALESCE(html, '') AS h, octet_length(encode(COALESCE(html, ''))) AS n, MIN(page_id) OVER (PARTITION BY COALESCE(html, '')) AS first_id FROM pages)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN n >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > first_id THEN first_id END AS refers_to FROM t""")
def op1_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op2_byte_bpe")
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.summary(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


@query("op3_toxicity_crf")
def op3_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_source_mixing", mixing.MIXTURE_SQL)
def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predictions(table(spark, sf_dir, "documents"))


@query("op6_exact_dedup", r"""
WITH t AS (SELECT doc_id, length(COALESCE(text, '')) AS n, regexp_replace(COALESCE(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
w AS (SELECT norm, COUNT(*) AS group_size, MIN((-n, doc_id)) AS best FROM t GROUP BY norm)
SELECT t.doc_id, best[2] AS keep_id, group_size, t.doc_id = best[2] AS kept, sha256(t.norm) AS text_sha256 FROM t JOIN w ON t.norm = w.norm""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


@query("op7_pii_semi_markov")
def op7_pii_semi_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.found(docs, pii.fitted(docs))


@query("op8_paragraph_minhash")
def op8_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated(table(spark, sf_dir, "documents"))


@query("op9_ball_tree_top_k", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id != b.vec_id)
SELECT query_id, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20""")
def op9_ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ball_tree.quantised(table(spark, sf_dir, "embeddings"))
    return ball_tree.top_k(rows, rows.filter("vec_id % 20 = 0"), 20)


@query("op10_ngram_jaccard_join", r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, COUNT(*) AS k FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id != b.doc_id
  AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * k >= 90 * (na + nb - k)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, COALESCE((SELECT MIN(b) FROM reach WHERE a = doc_id), doc_id)) AS component_id,
FROM sets""")
def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(table(spark, sf_dir, "documents"))[0].select("doc_id", "n_shingles", "component_id")


@query("op11_filter_interaction", filters.AUDIT_SQL)
def op11_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_source_divergence", divergence.DIVERGENCE_SQL)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents"))


@query("op13_context_mixing")
def op13_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.scores(table(spark, sf_dir, "documents"))
