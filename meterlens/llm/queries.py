"""Queries of this subpackage over the benchmark tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.llm import (
    decontamination,
    fixity,
    mixing,
    oracles,
    packing,
    periodic_runs,
    preferences,
    quality,
    secrets,
    simhash,
    token_alignment,
    token_counts,
    token_files,
    urls,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return decontamination.contained_items(docs, items)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.own_verdicts(docs, _table(spark, sf_dir, "labels"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.fitted(docs))


def op6_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.packed_blocks(_table(spark, sf_dir, "documents"))


def op7_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = preferences.conversation_turns(_table(spark, sf_dir, "conversations"))
    return preferences.format_preferences(preferences.reply_pairs(turns))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op9_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixity.audit_pages(_table(spark, sf_dir, "pages"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of `labels` count as those of the pages with the same number."""
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), good.cast("int").alias("good"))
    return urls.url_verdicts(_table(spark, sf_dir, "pages"), labels)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_repeated_tails(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return periodic_runs.run_digests(periodic_runs.find_runs(docs))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_figures(_table(spark, sf_dir, "documents"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).documents


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_packing,
        op2_simhash,
        op3_decontamination,
        op4_quality,
        op5_secrets,
        op6_token_blocks,
        op7_preferences,
        op8_token_counts,
        op9_fixity,
        op10_urls,
        op11_runs,
        op12_alignment,
        op13_mixing,
    )}


def llm_oracles() -> dict[str, str]:
    """The other queries depend on hashes, tokenizers or a trained net; tests compare those with brute force."""
    return {
        "op3_decontamination": oracles.decontamination(),
        "op7_preferences": oracles.preferences(),
        "op9_fixity": oracles.fixity_audit(),
        "op10_urls": oracles.url_verdicts(),
    }
