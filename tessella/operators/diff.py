"""Keyed comparison of two states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, key: str = "key", ordinal: str = "ordinal") -> DataFrame:
    """One row per key: the one of greatest ordinal."""
    columns = rows.columns
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(ordinal)).alias("_row")).select(*(F.col(f"_row.{c}").alias(c) for c in columns))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str = "key", digest: str = "hash", keep_unchanged: bool = False) -> DataFrame:
    """(key, op) with op create, drop or change; a null digest equals a null digest."""
    b = before.select(F.col(key), F.col(digest).alias("_before"), F.lit(True).alias("_in_before"))
    a = after.select(F.col(key), F.col(digest).alias("_after"), F.lit(True).alias("_in_after"))
    op = (
        F.when(F.col("_in_before").isNull(), "create")
        .when(F.col("_in_after").isNull(), "drop")
        .when(F.col("_before").eqNullSafe(F.col("_after")), "unchanged")
        .otherwise("change")
    )
    out = b.join(a, key, "full_outer").select(key, op.alias("op"))
    return out if keep_unchanged else out.where("op <> 'unchanged'")


def summary(ops: DataFrame, by: str = "op") -> DataFrame:
    return ops.groupBy(by).agg(F.count("*").alias("n"))


def renamed(ops: DataFrame, hints: DataFrame) -> DataFrame:
    """Turn a drop and a create that a hint (from_key, to_key) pairs into one rename; hints without both sides are findings."""
    drops = ops.where("op = 'drop'").select(F.col("key").alias("from_key"))
    creates = ops.where("op = 'create'").select(F.col("key").alias("to_key"))
    matched = F.broadcast(hints).join(drops, "from_key").join(creates, "to_key")
    rest = ops.join(matched.select(F.col("from_key").alias("key")).unionByName(matched.select(F.col("to_key").alias("key"))), "key", "left_anti")
    lost = hints.join(matched, ["from_key", "to_key"], "left_anti")
    return (
        rest.select("key", "op")
        .unionByName(matched.select(F.concat_ws(" -> ", "from_key", "to_key").alias("key"), F.lit("rename").alias("op")))
        .unionByName(lost.select(F.concat_ws(" -> ", "from_key", "to_key").alias("key"), F.lit("hint_error").alias("op")))
    )


def three_way(expected: DataFrame, actual: DataFrame, key: str = "key", digest: str = "hash") -> DataFrame:
    names = {"drop": "MISSING", "create": "UNEXPECTED", "change": "HASH_MISMATCH"}
    found = snapshot_diff(expected, actual, key, digest)
    return found.select(key, F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.col("op")].alias("finding"))


def symmetric_difference(left: DataFrame, right: DataFrame, key: str = "key") -> DataFrame:
    only_left = left.select(key).join(right.select(key), key, "left_anti").select(key, F.lit("left").alias("side"))
    only_right = right.select(key).join(left.select(key), key, "left_anti").select(key, F.lit("right").alias("side"))
    return only_left.unionByName(only_right)


def implied_drops(drops: DataFrame, *owners: str) -> DataFrame:
    """Drops none of whose owner columns is itself dropped: a column of keys per kind of owner, null where there is none."""
    keys = drops.select(F.col("key").alias("_owner"))
    out = drops
    for owner in owners:
        out = out.join(keys, out[owner] == keys["_owner"], "left_anti")
    return out


def reconcile(expected: DataFrame, applied: DataFrame, key: str = "version") -> DataFrame:
    missing = expected.select(key).join(applied.select(key), key, "left_anti").select(key, F.lit("missing").alias("state"))
    extra = applied.select(key).join(expected.select(key), key, "left_anti").select(key, F.lit("unexpected").alias("state"))
    return missing.unionByName(extra)


def history_status(disk: DataFrame, applied: DataFrame, key: str = "version") -> DataFrame:
    """applied, pending, out_of_order (pending, yet older than the newest applied) or ghost (applied, not on disk)."""
    newest = F.broadcast(applied.agg(F.max(key).alias("_newest")))
    d, a = disk.select(key, F.lit(1).alias("_d")), applied.select(key, F.lit(1).alias("_a"))
    state = (
        F.when(F.col("_d").isNull(), "ghost")
        .when(F.col("_a").isNotNull(), "applied")
        .when(F.col(key) < F.col("_newest"), "out_of_order")
        .otherwise("pending")
    )
    return d.join(a, key, "full_outer").join(newest, how="cross").select(key, state.alias("state"))


def contract_breaks(before: DataFrame, after: DataFrame) -> DataFrame:
    """Breaking changes of columns (table_name, column_name, type, not_null): removed, else type, else nullability."""
    keys = ["table_name", "column_name"]
    joined = before.join(after.select(*keys, F.col("type").alias("_type"), F.col("not_null").alias("_not_null"), F.lit(True).alias("_there")), keys, "left")
    tables = after.select("table_name", F.lit(True).alias("_table")).distinct()
    kind = (
        F.when(F.col("_table").isNull(), "table_removed")
        .when(F.col("_there").isNull(), "column_removed")
        .when(~F.col("type").eqNullSafe(F.col("_type")), "type_changed")
        .when(~F.col("not_null").eqNullSafe(F.col("_not_null")), "nullability_changed")
    )
    found = joined.join(F.broadcast(tables), "table_name", "left").select(*keys, kind.alias("change")).where("change IS NOT NULL")
    # A removed table is one finding.
    return found.withColumn("column_name", F.when(F.col("change") != "table_removed", F.col("column_name"))).distinct()


def column_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """(table_name, column_name, delta, facets): what happened to each column, and which facets differ."""
    keys = ["table_name", "column_name"]
    b = before.select(*keys, F.col("type").alias("_t0"), F.col("not_null").alias("_n0"), F.lit(1).alias("_b"))
    a = after.select(*keys, F.col("type").alias("_t1"), F.col("not_null").alias("_n1"), F.lit(1).alias("_a"))
    type_, null_ = ~F.col("_t0").eqNullSafe(F.col("_t1")), ~F.col("_n0").eqNullSafe(F.col("_n1"))
    delta = F.when(F.col("_b").isNull(), "add").when(F.col("_a").isNull(), "drop").when(type_ | null_, "alter")
    facets = F.when((delta == "alter"), F.concat_ws(",", F.when(null_, "not_null"), F.when(type_, "type"))).otherwise("")
    return b.join(a, keys, "full_outer").select(*keys, delta.alias("delta"), facets.alias("facets")).where("delta IS NOT NULL")


def residual(found: DataFrame, baseline: DataFrame, key: str = "key") -> DataFrame:
    """(n_new, n_left, converging): findings beyond a baseline; converging if fewer and none is new."""
    new = found.select(key).join(baseline.select(key), key, "left_anti").agg(F.count("*").alias("n_new"))
    sizes = found.agg(F.count("*").alias("n_left")).join(baseline.agg(F.count("*").alias("_n")), how="cross")
    return new.join(sizes, how="cross").select("n_new", "n_left", ((F.col("n_new") == 0) & (F.col("n_left") < F.col("_n"))).alias("converging"))


def fk_targets(fks: DataFrame, primary: DataFrame, unique: DataFrame) -> DataFrame:
    """Foreign keys (name, table_name, columns, ref_table, ref_columns or null), completed from primary keys and typed.

    One to one if the foreign key's own columns, in any order, are a unique set of its table.
    """
    filled = fks.join(primary.select(F.col("table_name").alias("ref_table"), F.col("columns").alias("_pk")), "ref_table", "left")
    sets = unique.select("table_name", F.array_join(F.array_sort("columns"), ",").alias("_set")).distinct()
    keyed = filled.withColumn("_set", F.array_join(F.array_sort("columns"), ","))
    joined = keyed.join(sets.withColumn("_one", F.lit(True)), ["table_name", "_set"], "left")
    return joined.select(
        "name", "table_name", "ref_table", F.array_join(F.coalesce("ref_columns", "_pk"), ",").alias("ref_columns"), F.coalesce("_one", F.lit(False)).alias("one_to_one")
    )


def division(rows: DataFrame, group: str, holds) -> DataFrame:
    """Groups of which every row meets ``holds``: no row fails it.  A row where it is null fails."""
    return rows.groupBy(group).agg(F.bool_and(F.coalesce(holds, F.lit(False))).alias("_all")).where("_all").select(group)
