"""What a difference between two states calls for: append, alter, replace, drop and create; and whether it may be done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_prefix(before: Column, after: Column) -> Column:
    return (F.size(before) <= F.size(after)) & (F.slice(after, 1, F.greatest(F.size(before), F.lit(1))) == before) | (F.size(before) == 0)


def enum_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, decision, added) of enums (key, labels): append where only new last labels come, else replace."""
    joined = before.select("key", F.col("labels").alias("_b")).join(after.select("key", F.col("labels").alias("_a")), "key").where("_a <> _b")
    append = is_prefix(F.col("_b"), F.col("_a"))
    added = F.slice("_a", F.size("_b") + 1, F.greatest(F.size("_a") - F.size("_b"), F.lit(0)))
    return joined.select("key", F.when(append, "append").otherwise("replace").alias("decision"), F.when(append, F.array_join(added, ",")).alias("added"))


def view_replacements(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, decision) of views (key, columns array<struct<name, type>>): replace if the old columns stay first, with their types."""
    joined = before.select("key", F.col("columns").alias("_b")).join(after.select("key", F.col("columns").alias("_a")), "key")
    return joined.select("key", F.when(is_prefix(F.col("_b"), F.col("_a")), "replace").otherwise("drop_and_create").alias("decision"))


def routine_replacements(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, decision) of routines (key, returns): another return type needs a drop."""
    joined = before.select("key", F.col("returns").alias("_b")).join(after.select("key", F.col("returns").alias("_a")), "key")
    return joined.select("key", F.when(F.col("_b").eqNullSafe(F.col("_a")), "replace").otherwise("drop_and_create").alias("decision"))


def dispositions(ops: DataFrame, intents: DataFrame, hints: DataFrame, policy: str = "hint") -> DataFrame:
    """``ops`` (key, destructive) with ``disposition``: intent in the history, else the policy (allow, block), else a hint for the key or for ``*``."""
    every = hints.where("key = '*'").agg((F.count("*") > 0).alias("_every"))
    joined = ops.join(intents.select("key", F.lit(True).alias("_intent")).distinct(), "key", "left").join(hints.select("key", F.lit(True).alias("_hint")).distinct(), "key", "left").join(F.broadcast(every), how="cross")
    fallback = {"allow": F.lit("allowed"), "block": F.lit("blocked")}.get(policy, F.when(F.col("_hint") | F.col("_every"), "hint").otherwise("blocked"))
    decided = F.when(~F.col("destructive"), "safe").when(F.col("_intent"), "intent").otherwise(fallback)
    return joined.select(*ops.columns, decided.alias("disposition"))


def rename_findings(hints: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(from_key, to_key, problem) of hints that cannot be: a missing side, another kind, another schema."""
    b = before.select(F.col("key").alias("from_key"), F.col("kind").alias("_bk"), F.col("schema_name").alias("_bs"))
    a = after.select(F.col("key").alias("to_key"), F.col("kind").alias("_ak"), F.col("schema_name").alias("_as"))
    joined = hints.join(b, "from_key", "left").join(a, "to_key", "left")
    problem = F.when(F.col("_bk").isNull(), "no source").when(F.col("_ak").isNull(), "no target").when(F.col("_bk") != F.col("_ak"), "another kind").when(~F.col("_bs").eqNullSafe(F.col("_as")), "another schema")
    return joined.select("from_key", "to_key", problem.alias("problem")).where("problem IS NOT NULL")


def drift(ops: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: (n, drift): drift if nothing is to be done, yet the fingerprints (one row, column fingerprint) differ."""
    same = before.select(F.col("fingerprint").alias("_b")).join(after.select(F.col("fingerprint").alias("_a")), how="cross")
    return ops.agg(F.count("*").alias("n")).join(same, how="cross").select("n", ((F.col("n") == 0) & (F.col("_a") != F.col("_b"))).alias("drift"))


def unresolved(objects: DataFrame) -> DataFrame:
    """(key, needs): dependencies that no object of the state is."""
    identity = F.when(F.col("kind") == "schema", F.col("name")).otherwise(F.concat_ws(".", "schema_name", "name"))
    there = objects.select(identity.alias("needs")).distinct()
    return objects.select("key", F.explode("dependencies").alias("needs")).join(there, "needs", "left_anti").select("key", "needs")
