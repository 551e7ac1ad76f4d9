"""Queries over the test tables, one per operator, and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import bin_packing, conversation_trie, embedding_dedup, importance_resampling, kdtree_sharding, language_id, quality_rules, simhash_dedup, source_mixing, substring_dedup, token_alignment, token_counts, toxicity
from tidewater.llm.common import table


def op1_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.repetition_rules(table(spark, sf_dir, "documents"))


def op2_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_language(table(spark, sf_dir, "documents"))


def op3_kdtree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree_sharding.kdtree_shards(table(spark, sf_dir, "documents"))


def op4_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix_sources(table(spark, sf_dir, "documents"))


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_groups(table(spark, sf_dir, "documents"))


def op8_embedding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_groups(table(spark, sf_dir, "embeddings"))


def op9_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op12_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_tokens(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op8_embedding_groups": embedding_dedup.ORACLE, "op1_repetition_rules": quality_rules.ORACLE, "op13_conversation_trie": conversation_trie.ORACLE}
