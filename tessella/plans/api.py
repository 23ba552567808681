"""What a user calls: inspect, plan, audit, scan, check, status, contract_diff, score.  Each returns a DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ddl import checks
from ..ddl.render import operation
from ..operators import diff, graph, rollup, sequence
from ..sources import readers

# Kinds whose drop, and whose replacement, loses data or access.
DESTRUCTIVE_DROPS = ("table", "schema", "type", "enum", "domain", "sequence", "view", "materialized-view", "function", "procedure", "extension", "constraint", "foreign-table", "policy", "rls")
DESTRUCTIVE_REPLACES = ("table", "materialized-view", "type", "domain", "sequence", "constraint", "extension", "foreign-table", "enum")

def inspect(spark: SparkSession, source: str) -> DataFrame:
    return readers.read_source(spark, source)


def operations(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, op, object_kind, destructive, ordinal, rank, identity, dependencies) that turn one state into the other."""
    ops = diff.snapshot_diff(before, after)
    described = after.select("key", "kind", "schema_name", "name", "ordinal", "dependencies", F.lit(1).alias("_side")).unionByName(before.select("key", "kind", "schema_name", "name", "ordinal", "dependencies", F.lit(0).alias("_side")))
    one = diff.last_wins(described, "key", "_side").drop("_side")
    rank = sequence.operation_rank(F.col("op"), F.col("kind"))
    lossy = F.when(F.col("op") == "drop", F.col("kind").isin(*DESTRUCTIVE_DROPS)).when(F.col("op") == "change", F.col("kind").isin(*DESTRUCTIVE_REPLACES)).otherwise(False)
    ordinal = sequence.operation_ordinal(F.col("op"), F.col("ordinal")).cast("long")
    identity = F.when(F.col("kind") == "schema", F.col("name")).otherwise(F.concat_ws(".", "schema_name", "name"))
    return ops.join(one, "key").select("key", "op", F.col("kind").alias("object_kind"), lossy.alias("destructive"), ordinal.alias("ordinal"), rank.cast("long").alias("rank"), identity.alias("identity"), "dependencies")


def plan(before: DataFrame, after: DataFrame, plan_id: str = "plan") -> DataFrame:
    """Operations with ``seq``: dependencies first, dependents dropped first, otherwise by rank, ordinal and key."""
    ops = operations(before, after)
    edge = ops.select("key", "op", F.explode(F.concat("dependencies", F.array(F.split_part("identity", F.lit("."), F.lit(1))))).alias("_needs"))
    owners = ops.where(F.col("object_kind").isin("schema", "table", "view", "materialized-view", "enum", "type", "domain", "sequence", "function", "procedure")).select(F.col("key").alias("_owner"), F.col("identity").alias("_needs"), F.col("op").alias("_owner_op"))
    joined = edge.join(owners, "_needs").where("key <> _owner AND (op = 'drop') = (_owner_op = 'drop')")
    drops = F.col("op") == "drop"
    edges = joined.select(F.lit(plan_id).alias("plan_id"), F.when(drops, F.col("key")).otherwise(F.col("_owner")).alias("src"), F.when(drops, F.col("_owner")).otherwise(F.col("key")).alias("dst")).distinct()
    order = graph.topological_order(ops.select(F.lit(plan_id).alias("plan_id"), "key", "rank", "ordinal"), edges)
    return ops.join(order, "key").select("seq", "key", "op", "object_kind", "destructive", "cyclic")


def plan_summary(planned: DataFrame) -> DataFrame:
    return planned.groupBy(F.concat_ws(" ", "op", "object_kind").alias("label")).agg(F.count("*").alias("n"))


def audit(objects: DataFrame) -> DataFrame:
    """(by, value, n): objects by kind and by schema."""
    kind = rollup.count_by(objects, "kind").select(F.lit("kind").alias("by"), F.col("kind").alias("value"), "n")
    schema = rollup.count_by(objects, "schema_name").select(F.lit("schema").alias("by"), F.col("schema_name").alias("value"), "n")
    return kind.unionByName(schema)


def check(files: DataFrame) -> DataFrame:
    """Static checks of (file, sql)."""
    return checks.check_statements(checks.file_facts(files))


def scan(findings: DataFrame, by: str = "file") -> DataFrame:
    return rollup.scan_scores(findings, by)


def status(disk: DataFrame, applied: DataFrame) -> DataFrame:
    return diff.history_status(disk, applied)


def contract_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    return diff.contract_breaks(before, after)


def score(manifest: DataFrame, emitted: DataFrame, key: str = "key", destructive: str = "destructive") -> DataFrame:
    return rollup.precision_recall(manifest, emitted, key, destructive)


def selfcheck(expected: DataFrame, actual: DataFrame) -> DataFrame:
    return diff.three_way(expected, actual)


def fingerprint(objects: DataFrame) -> DataFrame:
    """One row: the ordered fingerprint of a state of moderate size."""
    return rollup.fingerprint(objects.withColumn("_all", F.lit(1)), ["_all"]).select("fingerprint")


def render(planned: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(seq, key, op, sql) of a plan: guarded statements; null where an author's text is needed."""
    was, now = before.select("key", F.col("detail").alias("was")), after.select("key", F.col("detail").alias("now"), "sql")
    rows = planned.select("seq", "key", "op").join(was, "key", "left").join(now, "key", "left")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part = part.astype(object).where(part.notna(), None)
            text = [operation(op, key, was, sql, now) for op, key, was, sql, now in zip(part["op"], part["key"], part["was"], part["sql"], part["now"], strict=True)]
            yield pd.DataFrame({"seq": part["seq"].astype("int64"), "key": part["key"], "op": part["op"], "sql": text})

    return rows.mapInPandas(run, "seq long, key string, op string, sql string")


def migration(rendered: DataFrame) -> DataFrame:
    """One row: the whole text in order of the plan; what needs an author is a comment."""
    line = F.coalesce(F.concat("sql", F.lit(";")), F.concat_ws(" ", F.lit("-- to be written:"), "op", "key"))
    listed = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))))
    return rendered.agg(F.array_join(F.transform(listed, lambda s: s["line"]), "\n").alias("sql"))
