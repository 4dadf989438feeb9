"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import chat, fingerprints, jaccard_join, language, mixing, packing, sql, substring_dedup, suffix_dedup, token_counts, topk
from pagemill.llm.common import table


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.pmod("id", F.lit(100)) == 0)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.cleaned(table(spark, sf_dir, "documents"), note=suffix_dedup.NOTE)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.cleaned(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(turns.unionByName(added))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_packing": op2_packing,
    "op3_topk": op3_topk,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_fingerprints": op6_fingerprints,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_mixing": op8_mixing,
    "op9_language": op9_language,
    "op10_token_counts": op10_token_counts,
}

OP7_SQL = r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, len(text) + len(regexp_extract_all(text, '\\|### |: |</turn>')) AS n_escaped,
             coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '') AS before,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS nth FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n_escaped + 4 + len(role) + 2 + 8) AS BIGINT) AS formatted_chars,
  coalesce(min(nth) FILTER (NOT ((before = '' AND role IN ('system', 'user')) OR (before = 'system' AND role = 'user') OR (before = 'user' AND role = 'assistant') OR (before = 'assistant' AND role = 'user'))), -1) = -1
    AND arg_max(role, nth) = 'assistant' AS valid,
  coalesce(min(nth) FILTER (NOT ((before = '' AND role IN ('system', 'user')) OR (before = 'system' AND role = 'user') OR (before = 'user' AND role = 'assistant') OR (before = 'assistant' AND role = 'user'))), -1) AS first_bad_turn
FROM e GROUP BY conv_id
"""

ORACLE: dict[str, str] = {
    "op1_jaccard_join": sql.JACCARD_JOIN,
    "op3_topk": topk.ORACLE,
    "op4_suffix_dedup": sql.SUFFIX_DEDUP,
    "op5_substring_dedup": sql.SUBSTRING_DEDUP,
    "op7_chat_formatting": OP7_SQL,
    "op8_mixing": mixing.ORACLE,
}
