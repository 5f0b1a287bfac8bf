"""A training corpus from raw documents, stage by stage.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and works on
all documents that its predecessor kept. run() applies them to `documents`, each stage
on the stored rows of the one before it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from dayglass.llm import near_dedup, packing, quality, substring, toxicity
from dayglass.llm.common import stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents above their language's perplexity threshold go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that score 0.7 or more go."""
    return toxicity.keep_civil(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: one document of each class of near-duplicates stays."""
    return near_dedup.keep_one(docs)


def substring_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: passages that start earlier elsewhere are cut out of the texts."""
    return substring.without_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the remaining documents, packed into sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), packing.Capacity(tokens=2048))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("toxicity", toxicity_filter),
    ("near_dedup", near_deduplication),
    ("substring_dedup", substring_deduplication),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenizers and fitted models are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
