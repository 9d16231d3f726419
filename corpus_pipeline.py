"""The corpus pipeline: five stages from raw documents to packed sequences.

A stage is (name, function); a function takes (spark, docs, sf_dir) and returns
the documents it keeps, with their columns. The last returns the packed pieces.
Their rows are whole texts, so the session moves few at a time to Python workers.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from storyloom.llm import decontamination, jaccard, lines, packing, quality
from storyloom.llm.common import drop, set_small_batches, stored, table


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted on the labelled ones, rejects go."""
    set_small_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later lines equal or similar to an earlier one go; documents left without a word go."""
    return lines.dedup(docs)


def join_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 the one with the smallest id stays."""
    return jaccard.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, re-parameterised or not, go."""
    set_small_batches(spark)
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    set_small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", classify_quality),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", join_similar),
    ("benchmark_decontamination", decontaminate),
    ("packing", pack),
]

#: Compression and packing are beyond SQL: tests hold the pipeline against its stages applied by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read back as the next one's input, and deleted once that is written."""
    docs, read = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        drop(*read)
        read = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
