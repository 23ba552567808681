"""A corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, packing.

``run`` applies STAGES to the documents, each on what its predecessor kept, written as Parquet in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import stages
from tessella.llm.common import documents, saved

STAGES = [
    ("quality_classifier", stages.quality),
    ("ngram_jaccard_join", stages.near_duplicates),
    ("substring_dedup", stages.repeated_passages),
    ("benchmark_decontamination", stages.leaks),
    ("packing", stages.packing),
]

# SQL expresses neither the classifier nor the alignment nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
