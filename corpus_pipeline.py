"""A corpus from raw documents to packed sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orderlens.llm import exact_dedup, language, mixing, near_dedup, packing
from orderlens.llm.common import documents, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letter, or no language with half
    of the letters."""
    return language.with_known_language(docs)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops exact copies."""
    return exact_dedup.without_copies(docs)


def distinct_content(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops near-duplicates; one document of each group stays."""
    return near_dedup.one_of_each(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix asks."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the documents in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language", known_language),
    ("exact_dedup", distinct_texts),
    ("near_dedup", distinct_content),
    ("mix_sources", mixed_sources),
    ("pack", packed),
]

#: Languages, near-duplicates and packing are not SQL; tests compare the stages
#: with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
