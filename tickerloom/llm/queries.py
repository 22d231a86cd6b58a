"""Registered queries of the training-data operators, with their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tickerloom.llm import decontaminate, html_extract, language_id, licenses, order_minhash, packing, personal_data, preferences, prefix_trie, quality, simhash, token_counts, whitening
from tickerloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(plan: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return register


@query("op1_quality_classifier")
def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op2_preference_formatting", preferences.SQL)
def preference_segments(spark: SparkSession, folder: str) -> DataFrame:
    return preferences.format_pairs(preferences.paired(table(spark, folder, "conversations")))


@query("op3_html_extraction")
def main_texts(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extract(table(spark, folder, "pages"))


@query("op4_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op5_token_counts")
def counted_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op6_order_minhash")
def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.fingerprint_in_batches(table(spark, folder, "documents"))


@query("op7_language_id")
def languages(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(table(spark, folder, "documents"))


@query("op8_simhash_near_dedup")
def near_copies(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op9_benchmark_decontamination")
def benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op10_license_scans")
def license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


@query("op11_conversation_prefix_trie", prefix_trie.SQL)
def conversation_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, folder, "conversations"))


@query("op12_personal_data")
def personal_spans(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.find(table(spark, folder, "documents"))


@query("op13_embedding_whitening")
def whitened_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))
