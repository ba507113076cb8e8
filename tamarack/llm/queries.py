"""The operators' queries over the fixture tables, and SQL where it can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, importance, jaccard_join, licences, lloyd, mixing, packing, pii, quality, search, secret_scan, tokens, toxicity
from .common import keep, table
from .sql import ORACLES


def op1_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op2_search_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"))


def op3_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality.measures(table(spark, sf_dir, "documents"), ["doc_id", "lang"])
    return quality.judge(measured, quality.references(measured)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"
    )


def op4_mix_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = keep(mixing.measured(table(spark, sf_dir, "documents")), "op4-sizes")
    return mixing.taken(sizes).select("doc_id", "size", "source_size", "target", "taken")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op6_toxicity_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_licence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op8_jaccard_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents"))


def op9_pack_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.with_probe(spark, table(spark, sf_dir, "conversations"))
    return chat.digests(chat.expand(rows))


def op11_secret_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find(table(spark, sf_dir, "documents"))


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.fit(table(spark, sf_dir, "embeddings"))


def op13_importance_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_pii_weak_supervision,
        op2_search_block_max_wand,
        op3_quality_divergence,
        op4_mix_water_filling,
        op5_token_counts,
        op6_toxicity_noisy_channel,
        op7_licence_sentences,
        op8_jaccard_partenum,
        op9_pack_hilbert,
        op10_chat_prefix_targets,
        op11_secret_markov,
        op12_delta_lloyd,
        op13_importance_dictionary,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in queries()}
