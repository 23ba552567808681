"""The operators as stages of a corpus pipeline: each takes (spark, docs, sf_dir) and returns the rows that go on.

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .decontamination import decontaminate
from .ngram_join import ngram_join
from .packing import pack
from .quality import learn, score_quality
from .substring_dedup import substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*(c for c in COLUMNS if c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier accepts (score of 0.3 or more)."""
    forest = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _columns(score_quality(_columns(docs), forest, "_quality").where("_quality >= 0.3"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of least id.

    Rows without n-grams and rows without an id stay; rows that repeat an id are one document, and stay or go together.
    """
    linked = ngram_join(docs, 5, 75)
    gone = linked.where("n_shingles > 0 and doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    kept = docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
    return _columns(kept)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated passages; a text of which nothing is left goes."""
    cut = substring_dedup(_columns(docs), 20).where("n_words = 0 or n_removed < n_words")
    text = F.coalesce("kept_text", "text")
    return _columns(cut.withColumn("n_chars", F.when(F.col("kept_text").isNotNull(), F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))).withColumn("text", text))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("_leaked")).distinct()
    return _columns(docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["_leaked"]), "left_anti"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    import public_tokenizers

    C.limit_batches(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
