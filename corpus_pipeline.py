"""A corpus pipeline in five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docweave.llm import exact_dedup, mixing, ngram_join, packing, quality_rules
from docweave.llm.common import read, stored
from docweave.llm.queries import tokenizer_file


#: Words remembered in packing: fewer than by itself, as executors still hold what earlier stages grew to.
REMEMBERED = 1 << 16


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.kept_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest doc_id."""
    return exact_dedup.without_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at 0.8 or more: the one with the smallest doc_id."""
    return ngram_join.one_of_each(docs, words=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.packed(docs, tokenizer_file(), with_ids=False, remembered=REMEMBERED)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram join", near), ("mixing", mix), ("packing", pack)]

#: Packing counts the tokens of a tokenizer, which SQL cannot; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, "stage")
    return docs
