"""The contract queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lamina.llm import bpe, decontaminate, hnsw, language, lattice, linedup, quality, simhash, unigram, wavelet
from lamina.llm.common import documents


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_viterbi_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces, byte_fallback = unigram.read_pieces(vocabulary("piece_bpe_32k.model"))
    return unigram.token_counts(documents(spark, sf_dir), pieces, byte_fallback)


def op2_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_table(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(documents(spark, sf_dir))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.line_dedup_report(documents(spark, sf_dir))


def op6_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces, _ = unigram.read_pieces(vocabulary("piece_bpe_32k.model"))
    return lattice.score_documents(documents(spark, sf_dir), lattice.rank_weights(pieces))


def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_table(documents(spark, sf_dir).select("doc_id", "text"), vocabulary("byte_bpe_50k.tiktoken"))


def op9_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.document_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_language_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_language(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_viterbi_count, op2_wavelet_tokens, op3_simhash, op4_decontaminate, op5_line_dedup, op6_lattice_lm, op7_hnsw, op8_byte_bpe, op9_quality_crf, op10_language_rank)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_decontaminate": DECONTAMINATE_SQL}


DECONTAMINATE_SQL = r"""
WITH bench AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), pattern AS (
  SELECT DISTINCT item, len(p) AS n, array_to_string(p, ' ') AS p
  FROM (SELECT item, unnest(CASE WHEN len(w) <= 10 THEN [w] ELSE list_transform(range(1, len(w) - 8), lambda i: w[i:i + 9]) END) AS p FROM bench WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM pattern),
doc AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), spot AS (
  SELECT k, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, lengths WHERE len(w) >= n)
), found AS (SELECT k, i, s.n, item FROM spot s JOIN pattern USING (n, p)),
hit AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS j FROM found) GROUP BY k),
item AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM found WHERE item IS NOT NULL) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (k) LEFT JOIN item USING (k)
"""
