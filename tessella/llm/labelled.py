"""Bounded samples of labelled rows, to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int, held_out: int = 0, modulus: int = 5) -> tuple[DataFrame, float]:
    """At most ``per_class`` rows (doc_id, text, label) of either label, and the share of label 1 among all that may be learnt from.

    Rows whose crc32(doc_id as text) mod ``modulus`` is ``held_out`` are never used.  The rows of least id hash are taken:
    the same ones in every run.  Only their ids, 2 * per_class at most, are broadcast.
    """
    may = labels.where((C.fold("doc_id", modulus) != held_out) & F.col(column).isin(0, 1) & F.col("doc_id").isNotNull())
    may = may.groupBy("doc_id").agg(F.max(column).alias("label"))
    n, ones = may.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    least = F.xxhash64("doc_id")
    parts = [may.where(F.col("label") == k).orderBy(least, "doc_id").limit(per_class) for k in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    # Rows that repeat an id are one document here: the least text.
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")
    sample = sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    return sample, (ones / n if n else 0.0)
