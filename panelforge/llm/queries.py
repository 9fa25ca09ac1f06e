"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ball_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelforge.llm.topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelforge.llm.token_output import token_output

    return token_output(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelforge.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_log_frequency_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelforge.llm.ngram_lm import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


def op5_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelforge.llm.near_dup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op6_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelforge.llm.compression_rules import compression_rules

    return compression_rules(_table(spark, sf_dir, "documents"))


def op7_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelforge.llm.quality_model import quality

    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_splitting_tree_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelforge.llm.mixing import plan_mix

    rows = plan_mix(_table(spark, sf_dir, "documents"))
    return rows.selectExpr("row.doc_id AS doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken", "transform(mix.draws, d -> d.shard) AS shards")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelforge.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_bilstm_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelforge.llm.pii import find_personal_data

    return find_personal_data(_table(spark, sf_dir, "documents")).drop("redacted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ball_tree_topk, op2_token_output, op3_crf_toxicity, op4_log_frequency_bloom_lm, op5_circulant_minhash, op6_compression_bands, op7_subword_quality, op8_splitting_tree_mix, op9_best_fit_packing, op10_bilstm_crf_pii)}

#: A product over the components of every query row and candidate row; the nested loop is DuckDB's.
_OP1 = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.row_id, q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.row_id <> c.row_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY row_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLE: dict[str, str] = {"op1_ball_tree_topk": _OP1}
