"""Ordered folds of event logs into net state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def net_state(log: DataFrame, keys: list[str], verb: str = "verb", ordinal: str = "ordinal", on: str = "GRANT") -> DataFrame:
    """Keys whose last event is ``on``.  Each key is a set element of its own, so the last event decides membership."""
    last = F.max_by(verb, ordinal)
    return log.groupBy(*keys).agg(last.alias("_last")).where(F.col("_last") == on).select(*keys)


def net_fold(log: DataFrame, group: list[str], element: str, verb: str = "verb", ordinal: str = "ordinal", on: str = "GRANT") -> DataFrame:
    """The literal fold: add and remove in order, per group.  One array per group; for small groups and as a reference."""
    events = F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(verb).alias("v"), F.array(element).alias("p"))))
    step = lambda acc, e: F.when(e["v"] == on, F.array_union(acc, e["p"])).otherwise(F.array_except(acc, e["p"]))
    folded = F.aggregate("_events", F.array().cast("array<string>"), step, lambda held: F.array_sort(held))
    return log.groupBy(*group).agg(events.alias("_events")).select(*group, folded.alias("members"))


def last_flag(log: DataFrame, keys: list[str], flags: dict[str, tuple[list[str], list[str]]], transition: str, ordinal: str = "ordinal") -> DataFrame:
    """Booleans from their last transition; rows on which all end false are left out.  flags: name to (setting, clearing)."""
    aggs = []
    for name, (sets, clears) in flags.items():
        there = F.col(transition).isin(*sets, *clears)
        aggs.append(F.coalesce(F.max_by(F.when(there, F.col(transition).isin(*sets)), F.when(there, F.col(ordinal))), F.lit(False)).alias(name))
    any_: Column = F.lit(False)
    for name in flags:
        any_ = any_ | F.col(name)
    return log.groupBy(*keys).agg(*aggs).where(any_)


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first by ``order``, which must be total."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def last_facets(rows: DataFrame, keys: list[str], facets: list[str], ordinal: str = "ordinal") -> DataFrame:
    """Per key the last value of each facet that is not null: later amendments overwrite, absent ones do not."""
    return rows.groupBy(*keys).agg(*(F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(ordinal))).alias(f) for f in facets))


def idle_revokes(log: DataFrame, group: list[str], element: str = "privilege", verb: str = "verb", ordinal: str = "ordinal") -> DataFrame:
    """Revokes that take nothing: no earlier grant of the element in the group stands before them."""
    before = Window.partitionBy(*group, element).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    granted = F.max(F.when(F.col(verb) == "GRANT", F.col(ordinal))).over(before)
    revoked = F.max(F.when(F.col(verb) == "REVOKE", F.col(ordinal))).over(before)
    idle = (F.col(verb) == "REVOKE") & (granted.isNull() | (revoked > granted))
    return log.withColumn("_idle", idle).where("_idle").drop("_idle")


def element_union(log: DataFrame, keys: list[str], element: str) -> DataFrame:
    """Distinct elements per key, in order, as text."""
    return log.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(element)), ",").alias("members"))


def collapse_full(log: DataFrame, keys: list[str], element: str, full: DataFrame) -> DataFrame:
    """As ``element_union``, but ALL where a key has every element of ``full`` (a column ``element``, distinct)."""
    size = full.agg(F.count("*").alias("_size"))
    held = log.join(F.broadcast(full.withColumnRenamed(full.columns[0], "_of")), F.col(element) == F.col("_of"), "left")
    grouped = held.groupBy(*keys).agg(F.count_distinct("_of").alias("_n"), F.array_join(F.array_sort(F.collect_set(element)), ",").alias("_list"))
    return grouped.join(F.broadcast(size), how="cross").select(*keys, F.when(F.col("_n") == F.col("_size"), "ALL").otherwise(F.col("_list")).alias("members"))
