"""The operators' queries and their SQL, by the names under which they are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import align, bpe, forest, jaccard, langid, mixing, negatives, quality, scoring, secrets, sharding, substrings, subwords

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_shard_documents": sharding.op1_shard_documents,
    "op2_language_id": langid.op2_language_id,
    "op3_lm_scores": scoring.op3_lm_scores,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_nearest_vectors": forest.op5_nearest_vectors,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_jaccard_join": jaccard.op7_jaccard_join,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_substring_dedup": substrings.op10_substring_dedup,
    "op11_quality_classifier": subwords.op11_quality_classifier,
    "op12_token_alignment": align.op12_token_alignment,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}

SQL: dict[str, str] = {
    "op4_quality_rules": quality.ORACLE_SQL,
    "op7_jaccard_join": jaccard.ORACLE_SQL,
    "op8_mix_sources": mixing.ORACLE_SQL,
    "op10_substring_dedup": substrings.ORACLE_SQL,
    "op13_hard_negatives": negatives.ORACLE_SQL,
}
