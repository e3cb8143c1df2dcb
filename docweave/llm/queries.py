"""The registered queries of this subpackage: thin wrappers over its operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, html_extract, langid, mixing, ngram_join, packing, pii, quality_rules, suffix_dedup, toxicity
from .common import read


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op2_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_components(read(spark, folder, "documents"))


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.deduplicated(read(spark, folder, "documents")).drop("spans", "kept")


def op4_languages(spark: SparkSession, folder: str) -> DataFrame:
    return langid.languages(read(spark, folder, "documents"))


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(read(spark, folder, "documents"), tokenizer_file(), with_ids=False).drop("source")


def op6_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return pii.surrogates(read(spark, folder, "documents"), key="docweave").select("doc_id", "n_entities", "text")


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality(read(spark, folder, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken(read(spark, folder, "documents"))


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, folder, "documents"))


def op10_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extracted(read(spark, folder, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
