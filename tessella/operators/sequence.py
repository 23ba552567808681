"""Operators on ordered rows: guards, forward references, chains, numbering, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import materialise


def missing_guard(rows: DataFrame, group: str, order: str, needs_guard: Column, is_guard: Column) -> DataFrame:
    """Rows that need a guard directly before them and have none."""
    before = F.lag(is_guard).over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("_ok", F.coalesce(before, F.lit(False))).where(needs_guard & ~F.col("_ok")).drop("_ok")


def forward_references(uses: DataFrame, defines: DataFrame, group: str, name: str, order: str) -> DataFrame:
    """Uses (group, order, name) of what only later rows of the group define."""
    first = defines.groupBy(group, name).agg(F.min(order).alias("_first"))
    return uses.join(first, [group, name]).where(F.col(order) < F.col("_first")).select(group, order, name, F.col("_first").alias("defined_at"))


def used_after(adds: DataFrame, uses: DataFrame, group: str, name: str, order: str) -> DataFrame:
    """Uses of a name that the same group added before: not visible until the group commits."""
    first = adds.groupBy(group, name).agg(F.min(order).alias("_first"))
    return uses.join(first, [group, name]).where(F.col(order) > F.col("_first")).select(group, order, name)


def chain_gaps(rows: DataFrame, order: str, start: str, end: str, group: list[str] | None = None) -> DataFrame:
    """Rows whose start is not the end of the row before them."""
    w = Window.partitionBy(*(group or [])).orderBy(order)
    gap = F.lag(F.lit(True)).over(w).isNotNull() & ~F.lag(end).over(w).eqNullSafe(F.col(start))
    return rows.withColumn("_gap", gap).where("_gap").drop("_gap")


def stale_lineage(rows: DataFrame, group: str, order: str = "version", start: str = "from_fp", end: str = "to_fp", known: str = "known") -> DataFrame:
    """(group, version) of stale files: the end is unknown, or the start was made by a stale file before."""
    event = F.struct(F.col(order).alias("v"), F.col(start).alias("f"), F.col(end).alias("t"), F.col(known).alias("k"))
    listed = rows.groupBy(group).agg(F.array_sort(F.collect_list(event)).alias("_e"))
    empty = F.struct(F.array().cast("array<string>").alias("made"), F.array().cast(f"array<{dict(rows.dtypes)[order]}>").alias("stale"))

    def step(acc, e):
        bad = ~e["k"] | F.array_contains(acc["made"], e["f"])
        return F.struct(
            F.when(bad, F.array_append(acc["made"], e["t"])).otherwise(acc["made"]).alias("made"), F.when(bad, F.array_append(acc["stale"], e["v"])).otherwise(acc["stale"]).alias("stale")
        )

    return listed.select(group, F.explode(F.aggregate("_e", empty, step, lambda a: a["stale"])).alias(order))


def after_baseline(files: DataFrame, lineage: DataFrame, version: str = "version") -> DataFrame:
    """Files after the last one with lineage."""
    last = F.broadcast(lineage.agg(F.max(version).alias("_last")))
    return files.join(last, how="cross").where(F.col("_last").isNull() | (F.col(version) > F.col("_last"))).drop("_last")


def renumber(rows: DataFrame, group: list[str], *order: Column) -> DataFrame:
    """Contiguous ordinals from 0 within each group."""
    return rows.withColumn("position", (F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1).cast("long"))


def top(rows: DataFrame, group: list[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each group; Spark keeps n per group before the exchange."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("place", place.cast("long")).where(F.col("place") <= n)


def number(rows: DataFrame, *order: str | Column) -> DataFrame:
    """``place``: 1, 2, ... in one order of all rows, without a task that sees all.

    Ranges of the order go to tasks and are numbered there; the sizes of the ranges, a row each, are added up.  Ranges
    come from a sample, so the dealt rows are written down before they are counted.
    """
    names = [f"_by{i}" for i in range(len(order))]
    keyed = rows.select("*", *((F.col(o) if isinstance(o, str) else o).alias(n) for o, n in zip(order, names, strict=True)))
    dealt = materialise(keyed.repartitionByRange(*names).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*names))
    return dealt.withColumn("_at", within).join(starts, "_range").withColumn("place", (F.col("_start") + F.col("_at")).cast("long")).drop("_at", "_start", "_range", *names)


# Kinds in the order in which they are created, ten apart; they are dropped in reverse.
KINDS = (
    "schema", "extension", "enum", "type", "domain", "sequence", "foreign-data-wrapper", "foreign-server", "table", "foreign-table", "constraint",
    "index", "function", "procedure", "view", "materialized-view", "trigger", "rls", "policy", "default-privilege", "grant", "comment",
)
# Where the ranks of drops (downwards), renames, creations and changes begin, and a kind that is not listed.
DROP_FROM, RENAME_FROM, CREATE_FROM, CHANGE_FROM, UNLISTED = 1000, 900, 1000, 1050, 500


def operation_rank(op: Column, kind: Column) -> Column:
    """The first key of the order of operations; ``operation_ordinal`` and the key follow."""
    ranks = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, 10 * (i + 1))))
    listed = F.coalesce(ranks[kind], F.lit(UNLISTED))
    drop = F.when(ranks[kind].isNull(), UNLISTED).otherwise(DROP_FROM - listed)
    return F.when(op == "drop", drop).when(op == "rename", RENAME_FROM + listed).when(op == "change", CHANGE_FROM + listed).otherwise(CREATE_FROM + listed)


def operation_ordinal(op: Column, ordinal: Column) -> Column:
    """Later objects are dropped first."""
    return F.when(op == "drop", -ordinal).otherwise(ordinal)


def next_version(versions: DataFrame, version: str, now: str) -> DataFrame:
    """One row: the later of ``now`` and a second after the newest version (yyyyMMddHHmmss)."""
    newest = F.max(F.try_to_timestamp(F.col(version), F.lit("yyyyMMddHHmmss")))
    moment = F.greatest(newest + F.expr("interval 1 second"), F.to_timestamp(F.lit(now)))
    return versions.agg(F.date_format(moment, "yyyyMMddHHmmss").alias("version"))
