"""A schema of any size and a changed state of it, for scale tests: about seven objects per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def state_sql(tables: int, changed: bool, engine: str = "spark") -> str:
    """SELECT of (key, kind, schema_name, name, hash, ordinal, needs): the same rows in either engine.

    Every table has a key, a foreign key, an index, row security, two policies and a trigger; some have a grant, a view, a
    materialized view, a function or a comment.  The changed state has one more table and enum label, a column more in
    every third table, and five single edits.
    """
    ids = f"SELECT id AS i FROM range({tables})" if engine == "spark" else f"SELECT range AS i FROM range({tables})"
    n = "'entity_' || CAST(i AS VARCHAR(12))"
    column = "CASE WHEN i % 3 = 1 THEN ', external_ref text' ELSE '' END" if changed else "''"
    edit = lambda at: f"CASE WHEN i = {at} THEN ' edited' ELSE '' END" if changed else "''"
    drop = lambda at: f" AND i <> {at}" if changed else ""
    rows = [
        # kind, key after the kind, body, condition, what it needs
        ("table", n, f"'id bigint, tenant_id bigint, name text, status status, payload jsonb' || {column}", "TRUE", "'status'"),
        ("constraint", f"{n} || '_fk:' || {n}", "'foreign key (tenant_id)'", "i > 0", n),
        ("index", f"{n} || '_idx'", f"'(tenant_id)' || {edit(11)}", f"TRUE{drop(13)}", n),
        ("rls", n, "'enabled'", "TRUE", n),
        ("policy", f"{n} || '_read:' || {n}", f"'using (true)' || {edit(17)}", "TRUE", n),
        ("policy", f"{n} || '_write:' || {n}", "'with check (true)'", "TRUE", n),
        ("trigger", f"{n} || '_touch:' || {n}", "'before update'", "TRUE", n),
        ("grant", f"{n} || ':reader'", "'select'", "i % 5 = 0", n),
        ("view", f"{n} || '_view'", f"'select id, name' || {edit(15)}", "i % 10 = 5", n),
        ("materialized-view", f"{n} || '_totals'", "'select count(*)'", "i % 25 = 7", n),
        ("function", f"{n} || '_of(bigint)'", f"'select 1' || {edit(29)}", "i % 20 = 9", n),
        ("comment", f"'table ' || {n}", f"'about ' || {n} || {edit(18)}", "i % 15 = 3", n),
    ]
    if engine == "spark":
        # One pass: each table's objects as an array, exploded.
        objects = ", ".join(f"struct('{kind}:app.' || {key}, '{kind}', 'app', {key}, md5({body}), i * 20 + {k}, 'app.' || {needs}, {where})" for k, (kind, key, body, where, needs) in enumerate(rows))
        parts = [f"SELECT key, kind, schema_name, name, hash, ordinal, needs FROM ({ids}) t LATERAL VIEW inline(array({objects})) o AS key, kind, schema_name, name, hash, ordinal, needs, there WHERE there"]
    else:
        parts = [f"SELECT '{kind}:app.' || {key} AS key, '{kind}' AS kind, 'app' AS schema_name, {key} AS name, md5({body}) AS hash, i * 20 + {k} AS ordinal, 'app.' || {needs} AS needs FROM ({ids}) t WHERE {where}" for k, (kind, key, body, where, needs) in enumerate(rows)]
    label = "'a,b,c'" if changed else "'a,b'"
    parts.append(f"SELECT 'schema:app', 'schema', NULL, 'app', md5(''), CAST(-2 AS BIGINT), NULL UNION ALL SELECT 'enum:app.status', 'enum', 'app', 'status', md5({label}), CAST(-1 AS BIGINT), NULL")
    if changed:
        parts.append("SELECT 'table:app.audit_events', 'table', 'app', 'audit_events', md5('id bigint'), CAST(-3 AS BIGINT), NULL")
    return " UNION ALL ".join(parts)


def states(spark: SparkSession, tables: int) -> tuple[DataFrame, DataFrame]:
    """Both states, with ``dependencies`` as an array."""
    deps = F.when(F.col("needs").isNull(), F.array().cast("array<string>")).otherwise(F.array("needs"))
    one = lambda changed: spark.sql(state_sql(tables, changed)).withColumn("dependencies", deps).drop("needs")
    return one(False), one(True)


def texts(spark: SparkSession, tables: int, changed: bool) -> DataFrame:
    """(file, sql): the same schema as definition text, a file per table behind one for the schema and its enum."""
    n = "concat('entity_', CAST(id AS STRING))"
    edit = lambda at, text: f"CASE WHEN id = {at} THEN '{text}' ELSE '' END" if changed else "''"
    more = "CASE WHEN id % 3 = 1 THEN ', external_ref text' ELSE '' END" if changed else "''"
    index = f"concat('create index if not exists ', {n}, '_idx on app.', {n}, ' (tenant_id', {edit(11, ', name')}, ')')"
    parts = [
        f"concat('create table if not exists app.', {n}, ' (id bigint primary key, tenant_id bigint, name text not null, status app.status, payload jsonb', {more}, ')')",
        f"CASE WHEN id > 0 THEN concat('alter table app.', {n}, ' add constraint ', {n}, '_fk foreign key (tenant_id) references app.entity_', CAST(id - 1 AS STRING), ' (id)') END",
        f"CASE WHEN id <> 13 THEN {index} END" if changed else index,
        f"concat('alter table app.', {n}, ' enable row level security')",
        f"concat('create policy ', {n}, '_read on app.', {n}, ' for select using (tenant_id > 0', {edit(17, ' and id > 0')}, ')')",
        f"concat('create policy ', {n}, '_write on app.', {n}, ' for insert with check (tenant_id > 0)')",
        f"CASE WHEN id % 5 = 0 THEN concat('grant select on app.', {n}, ' to reader') END",
        f"CASE WHEN id % 10 = 5 THEN concat('create or replace view app.', {n}, '_view as select id, name from app.', {n}, {edit(15, ' where id > 0')}) END",
        f"CASE WHEN id % 20 = 9 THEN concat('create or replace function app.', {n}, '_of(bigint) returns bigint language sql as $$ select 1', {edit(29, ' + 1')}, ' $$') END",
        f"CASE WHEN id % 15 = 3 THEN concat('comment on table app.', {n}, ' is ''about ', {n}, {edit(18, ' and more')}, '''') END",
    ]
    label = "'a', 'b', 'c'" if changed else "'a', 'b'"
    first = f"create schema if not exists app;\ncreate type app.status as enum ({label})" + (";\ncreate table if not exists app.audit_events (id bigint)" if changed else "")
    rows = spark.range(tables).selectExpr("lpad(CAST(id + 1 AS STRING), 9, '0') AS file", f"concat_ws(';\n', {', '.join(parts)}) AS sql")
    return spark.createDataFrame([("000000000", first)], "file string, sql string").unionByName(rows)
