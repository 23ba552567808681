"""Named queries from definition text, rules and decisions, with their SQL.

Texts are made from rows of ordinary tables; what the checks must find follows from the same rows, and the SQL says how.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ddl.replay import replay_histories
from ..operators import decisions
from ..rules import packs
from . import api
from .catalogue import query

# --- static checks -----------------------------------------------------------------------------------------------------------

# A file per order.  The text is one expression for either engine: what it says hangs on the order's columns.
CHECKED_SQL = """SELECT file, k, concat_ws(';\n', one, two, three, four, five) AS sql, g, p, s, c FROM (SELECT *,
    CASE p WHEN '1' THEN concat('create table ', CASE WHEN g THEN 'if not exists ' ELSE '' END, 's.t', k, ' (id bigint)')
        WHEN '2' THEN concat('drop index ', CASE WHEN g THEN 'if exists ' ELSE '' END, 's.i', k, CASE WHEN s = 'F' THEN ' cascade' ELSE '' END)
        WHEN '3' THEN concat('create ', CASE WHEN g THEN 'or replace ' ELSE '' END, 'view s.v', k, ' as select 1 as x')
        WHEN '4' THEN concat('insert into s.t', k, ' (id) values (1)', CASE WHEN g THEN ' on conflict do nothing' ELSE '' END)
        ELSE concat('create ', CASE WHEN g THEN 'or replace ' ELSE '' END, 'function s.f', k, '() returns int language sql', CASE WHEN s = 'F' THEN ' security definer' ELSE '' END,
            CASE WHEN c % 2 = 0 THEN ' set search_path = s' ELSE '' END, ' as $$ select 1 $$') END AS one,
    CASE s WHEN 'F' THEN concat('update s.t', k, ' set id = 2')
        WHEN 'O' THEN concat('alter table s.t', k, ' add constraint c', k, ' check (id > 0)', CASE WHEN c % 2 = 0 THEN ' not valid' ELSE '' END)
        ELSE concat(CASE WHEN c % 2 = 0 THEN concat('drop policy if exists p', k, ' on s.t', k, ';\n') ELSE '' END, 'create policy p', k, ' on s.t', k, ' using (true)') END AS two,
    CASE CAST(c % 4 AS INT) WHEN 0 THEN 'set search_path = s' WHEN 1 THEN concat('create type s.e', k, ' as enum (''a'')')
        WHEN 2 THEN concat('alter table s.t', k, ' alter column id type int') ELSE concat('alter table s.t', k, ' add column c int not null') END AS three,
    CASE CAST(c % 3 AS INT) WHEN 0 THEN concat('alter table s.t', k, ' alter column id set not null') WHEN 1 THEN concat('create index concurrently if not exists i', k, ' on s.t', k, ' (id)')
        ELSE concat('alter table s.t', k, ' add column d uuid default gen_random_uuid()') END AS four,
    CASE CAST(c % 5 AS INT) WHEN 0 THEN concat('alter type s.h', k, ' add value if not exists ''z'';\nselect ''z''')
        WHEN 1 THEN concat('create or replace view s.w', k, ' as select id from s.n', k, ';\ncreate table if not exists s.n', k, ' (id int)') END AS five
    FROM (SELECT concat('f', CAST(o_orderkey AS STRING)) AS file, CAST(o_orderkey AS STRING) AS k, o_orderkey % 3 = 0 AS g, substr(o_orderpriority, 1, 1) AS p, o_orderstatus AS s, o_custkey AS c FROM {orders}))"""
# The condition of each check, and its severity.
EXPECTED = {
    "C01": ("p = '1' AND NOT g", "error"),
    "C02": ("c % 4 = 1", "error"),
    "C03": ("p IN ('3', '5') AND NOT g", "error"),
    "C05": ("s = 'P' AND c % 2 = 1", "error"),
    "C06": ("c % 3 = 1", "warning"),
    "C07": ("p = '4' AND NOT g", "error"),
    "C08": ("s = 'F'", "warning"),
    "C09": ("p = '2' AND s = 'F'", "error"),
    "C10": ("p = '2' AND NOT g", "error"),
    "C11": ("c % 4 = 0", "warning"),
    "C12": ("s = 'O' AND c % 2 = 1", "warning"),
    "C13": ("c % 4 = 2", "warning"),
    "C14": ("c % 3 = 0", "warning"),
    "C15": ("c % 3 = 2", "warning"),
    "C16": ("c % 4 = 3", "error"),
    "C17": ("c % 5 = 1", "error"),
    "C18": ("c % 5 = 0", "error"),
    "C19": ("p = '5'", "warning"),
    "C20": ("p = '5' AND s = 'F' AND c % 2 = 1", "error"),
}
_ROWS = "(SELECT 'f' || o_orderkey AS file, o_orderkey % 3 = 0 AS g, substr(o_orderpriority, 1, 1) AS p, o_orderstatus AS s, o_custkey AS c FROM orders)"


def checked_files(t) -> DataFrame:
    return t.spark.sql(CHECKED_SQL, orders=t.orders).select("file", "sql")


@query("statement_checks", " UNION ALL ".join(f"SELECT file, '{code}' AS code, '{severity}' AS severity FROM {_ROWS} WHERE {condition}" for code, (condition, severity) in EXPECTED.items()))
def _(t):
    return api.check(checked_files(t)).select("file", "code", "severity")


# --- replay --------------------------------------------------------------------------------------------------------------------

# A history per customer: a table with what hangs on it; with a negative balance all of it goes in the end.
HISTORY_SQL = """SELECT concat('h', CAST(c_custkey AS STRING)) AS history, '1' AS file, concat_ws(';\n', 'create schema s', 'create table s.t (id bigint, name text)',
    CASE WHEN c_nationkey % 2 = 0 THEN 'alter table s.t add constraint one unique (name)' ELSE 'alter table s.t rename column name to label' END,
    CASE WHEN c_mktsegment LIKE 'B%' THEN 'create view s.v as select id from s.t' END,
    CASE WHEN c_nationkey % 3 = 0 THEN 'create index ix on s.t (id)' END,
    'grant select on s.t to reader', CASE WHEN c_nationkey % 5 = 0 THEN 'revoke select on s.t from reader' END,
    'comment on table s.t is ''note''', CASE WHEN c_custkey % 2 = 0 THEN 'comment on table s.t is null' END,
    CASE WHEN c_custkey % 3 = 0 THEN 'alter table s.t enable row level security;\ncreate policy mine on s.t using (true)' END,
    CASE WHEN c_custkey % 7 = 0 THEN 'create type s.mood as enum (''a'');\nalter type s.mood add value ''b''' END,
    CASE WHEN c_acctbal < 0 THEN 'drop table s.t cascade' END) AS sql FROM {customer}"""
_KEPT = {
    "schema": "TRUE",
    "table": "stays",
    "constraint": "stays AND c_nationkey % 2 = 0",
    "view": "stays AND c_mktsegment LIKE 'B%'",
    "index": "stays AND c_nationkey % 3 = 0",
    "grant": "stays AND c_nationkey % 5 <> 0",
    "comment": "stays AND c_custkey % 2 = 1",
    "rls": "stays AND c_custkey % 3 = 0",
    "policy": "stays AND c_custkey % 3 = 0",
    "enum": "c_custkey % 7 = 0",
}


def histories(t) -> DataFrame:
    return t.spark.sql(HISTORY_SQL, customer=t.customer)


@query("replayed_objects", " UNION ALL ".join(f"SELECT 'h' || c_custkey AS history, '{kind}' AS kind FROM (SELECT *, c_acctbal >= 0 AS stays FROM customer) WHERE {condition}" for kind, condition in _KEPT.items()))
def _(t):
    return replay_histories(histories(t)).select("history", "kind")


@query("replayed_labels", "SELECT 'h' || c_custkey AS history, 'a,b' AS labels FROM customer WHERE c_custkey % 7 = 0")
def _(t):
    labels = F.from_json(F.get_json_object("detail", "$.labels"), "array<string>")
    return replay_histories(histories(t)).where("kind = 'enum'").select("history", F.array_join(labels, ",").alias("labels"))


# --- rules ---------------------------------------------------------------------------------------------------------------------

POLICY_SQL = """SELECT concat('t', CAST(c_custkey % 50 AS STRING)) AS table_name, concat('p', CAST(c_custkey AS STRING)) AS name,
    CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN 'all' WHEN 1 THEN 'select' WHEN 2 THEN 'insert' WHEN 3 THEN 'update' ELSE 'delete' END AS command,
    CASE CAST(c_custkey % 6 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'owner = auth.uid()' WHEN 2 THEN 'owner = (select auth.uid())' WHEN 3 THEN 'auth.role() = 1' ELSE 'true' END AS using_expr,
    CASE WHEN c_custkey % 4 = 0 THEN 'true' END AS check_expr, c_custkey % 3 = 0 AS tenant FROM {customer}"""
ROUTINE_SQL = """SELECT concat('f', CAST(s_suppkey AS STRING)) AS name, s_suppkey % 2 = 0 AS definer,
    CASE CAST(s_suppkey % 5 AS INT) WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '"$user", app' WHEN 3 THEN 'pg_temp, app' ELSE 'app' END AS search_path FROM {supplier}"""


def _model(t) -> packs.Model:
    text = lambda prefix, column: F.concat(F.lit(prefix), F.col(column).cast("string"))
    policies = t.spark.sql(POLICY_SQL, customer=t.customer).withColumn("columns", F.when(F.col("tenant"), F.array(F.lit("id"), F.lit("tenant_id"))).otherwise(F.array(F.lit("id")))).drop("tenant")
    return packs.Model(
        {
            "tables": t.part.select(F.col("p_name").alias("table_name"), F.lower("p_brand").alias("schema_name")),
            "rls": t.nation.select(text("t", "n_nationkey").alias("table_name")),
            "policies": policies,
            "grants": t.orders.select(text("t", "o_orderkey").alias("target"), F.when(F.col("o_orderstatus") == "P", "public").otherwise(text("r", "o_custkey")).alias("grantee"), F.when(F.col("o_orderpriority") == "5-LOW", "all").otherwise("select").alias("privilege"), F.when(F.col("o_custkey") % 2 == 0, "table").otherwise("view").alias("kind")),
            "routines": t.spark.sql(ROUTINE_SQL, supplier=t.supplier),
            "views": t.part.select(text("v", "p_partkey").alias("name"), F.when(F.col("p_size") % 2 == 0, "public").otherwise("inner").alias("schema_name"), F.when(F.col("p_size") % 3 > 0, F.col("p_size") % 3 == 1).alias("security_invoker")),
            "operations": t.orders.select(text("k", "o_orderkey").alias("key"), (F.col("o_orderstatus") == "F").alias("destructive"), (F.col("o_custkey") % 2 == 0).alias("blocked")),
        },
        required_columns=("tenant_id",),
    )


_POLICIES, _ROUTINES = POLICY_SQL.replace("{customer}", "customer").replace("STRING", "VARCHAR"), ROUTINE_SQL.replace("{supplier}", "supplier").replace("STRING", "VARCHAR")
RULES = {
    "destructive": ("D01", "error", "SELECT 'k' || o_orderkey AS subject FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 2 = 1"),
    "missing_predicate": ("S03", "error", f"SELECT name AS subject FROM ({_POLICIES}) WHERE using_expr IS NULL AND (command <> 'insert' OR check_expr IS NULL)"),
    "required_columns": ("S04", "warning", f"SELECT name AS subject FROM ({_POLICIES}) WHERE NOT tenant"),
    "deprecated_call": ("S05", "warning", f"SELECT name AS subject FROM ({_POLICIES}) WHERE using_expr LIKE '%auth.role()%'"),
    "unwrapped_call": ("S06", "warning", f"SELECT name AS subject FROM ({_POLICIES}) WHERE using_expr LIKE '%auth.uid()%' AND using_expr NOT LIKE '%(select%'"),
    "definer_search_path": ("S08", "error", f"""SELECT name || ': ' || issue AS subject FROM (SELECT *, CASE WHEN search_path IS NULL THEN 'unset' WHEN search_path = '' THEN 'empty'
        WHEN contains(search_path, '$user') THEN 'user' WHEN starts_with(search_path, 'pg_temp,') THEN 'temporary first' END AS issue FROM ({_ROUTINES})) WHERE definer AND issue IS NOT NULL"""),
    "all_privileges": ("P02", "warning", "SELECT 't' || o_orderkey AS subject FROM orders WHERE o_orderpriority = '5-LOW' AND o_custkey % 2 = 0"),
    "view_invoker": ("V01", "warning", "SELECT 'v' || p_partkey AS subject FROM part WHERE p_size % 2 = 0 AND p_size % 3 <> 1"),
}
for _name, (_code, _severity, _subjects) in RULES.items():
    query(f"rule_{_name}", f"SELECT '{_code}' AS code, '{_severity}' AS severity, subject FROM ({_subjects})")(lambda t, rule=getattr(packs, _name): rule(_model(t)))


@query("rule_pack", " UNION ALL ".join(f"SELECT '{code}' AS code, count(*) AS n FROM ({subjects})" for code, _, subjects in RULES.values()))
def _(t):
    # All rules of the pack run as one union; of its findings those are counted that the queries above state.
    wanted = [code for code, _, _ in RULES.values()]
    return packs.run_rules(_model(t)).where(F.col("code").isin(*wanted)).groupBy("code").agg(F.count("*").alias("n"))


# --- decisions -----------------------------------------------------------------------------------------------------------------


@query(
    "enum_decisions",
    """SELECT 'e' || p_partkey AS key, CASE WHEN p_size % 3 = 0 THEN 'append' ELSE 'replace' END AS decision, CASE WHEN p_size % 3 = 0 THEN p_brand END AS added FROM part WHERE p_size % 4 > 0 OR p_size % 3 > 0""",
)
def _(t):
    key, size = F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_size")
    before = F.array("p_name", "p_type")
    # Another label at the end, in front, or one less; without a remainder by 12 the labels stay.
    after = F.when(size % 12 == 0, before).when(size % 3 == 0, F.array("p_name", "p_type", "p_brand")).when(size % 3 == 1, F.array("p_brand", "p_name", "p_type")).otherwise(F.array("p_name"))
    return decisions.enum_changes(t.part.select(key, before.alias("labels")), t.part.select(key, after.alias("labels")))


@query("view_decisions", "SELECT 'v' || o_orderkey AS key, CASE WHEN o_custkey % 3 = 2 THEN 'drop_and_create' ELSE 'replace' END AS decision FROM orders")
def _(t):
    key, kind = F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("key"), F.col("o_custkey") % 3
    column = lambda name, of: F.struct(F.lit(name).alias("name"), F.lit(of).alias("type"))
    before = F.array(column("id", "bigint"))
    after = F.when(kind == 0, before).when(kind == 1, F.array(column("id", "bigint"), column("more", "text"))).otherwise(F.array(column("id", "text")))
    return decisions.view_replacements(t.orders.select(key, before.alias("columns")), t.orders.select(key, after.alias("columns")))


@query("routine_decisions", "SELECT 'f' || c_custkey AS key, CASE WHEN c_nationkey % 4 = 0 THEN 'drop_and_create' ELSE 'replace' END AS decision FROM customer")
def _(t):
    key = F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("key")
    after = F.when(F.col("c_nationkey") % 4 > 0, F.col("c_mktsegment"))
    return decisions.routine_replacements(t.customer.select(key, F.col("c_mktsegment").alias("returns")), t.customer.select(key, after.alias("returns")))


@query(
    "operation_dispositions",
    """SELECT 'k' || o_orderkey AS key, o_orderstatus <> 'O' AS destructive, CASE WHEN o_orderstatus = 'O' THEN 'safe' WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 2000) THEN 'intent'
    WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'hint' ELSE 'blocked' END AS disposition FROM orders""",
)
def _(t):
    key = lambda column: F.concat(F.lit("k"), F.col(column).cast("string")).alias("key")
    ops = t.orders.select(key("o_orderkey"), (F.col("o_orderstatus") != "O").alias("destructive"))
    poor = t.customer.where("c_acctbal < 2000").select(F.col("c_custkey").alias("o_custkey"))
    return decisions.dispositions(ops, t.orders.join(poor, "o_custkey").select(key("o_orderkey")), t.lineitem.where("l_returnflag = 'R'").select(key("l_orderkey")))


@query(
    "rename_problems",
    """SELECT 'c' || c_custkey AS from_key, 'c' || (c_custkey + 40) AS to_key, problem FROM (SELECT c.*, CASE WHEN c_custkey % 9 = 0 THEN 'no source' WHEN c_custkey + 40 NOT IN (SELECT c_custkey FROM customer) THEN 'no target'
    WHEN c_mktsegment <> (SELECT x.c_mktsegment FROM customer x WHERE x.c_custkey = c.c_custkey + 40) THEN 'another kind'
    WHEN c_nationkey <> (SELECT x.c_nationkey FROM customer x WHERE x.c_custkey = c.c_custkey + 40) THEN 'another schema' END AS problem FROM customer c) WHERE problem IS NOT NULL""",
)
def _(t):
    key = lambda shift: F.concat(F.lit("c"), (F.col("c_custkey") + shift).cast("string"))
    state = t.customer.select(key(0).alias("key"), F.col("c_mktsegment").alias("kind"), F.col("c_nationkey").cast("string").alias("schema_name"), "c_custkey")
    hints = t.customer.select(key(0).alias("from_key"), key(40).alias("to_key"))
    return decisions.rename_findings(hints, state.where("c_custkey % 9 <> 0"), state)


@query(
    "unresolved_dependencies",
    "SELECT 'view:s.v' || o_orderkey AS key, 's.t' || (o_custkey * 2) AS needs FROM orders WHERE o_custkey * 2 NOT IN (SELECT c_custkey FROM customer)",
)
def _(t):
    none = F.array().cast("array<string>")
    text = lambda prefix, value: F.concat(F.lit(prefix), value.cast("string"))
    tables = t.customer.select(text("table:s.t", F.col("c_custkey")).alias("key"), F.lit("table").alias("kind"), F.lit("s").alias("schema_name"), text("t", F.col("c_custkey")).alias("name"), none.alias("dependencies"))
    views = t.orders.select(text("view:s.v", F.col("o_orderkey")).alias("key"), F.lit("view").alias("kind"), F.lit("s").alias("schema_name"), text("v", F.col("o_orderkey")).alias("name"), F.array(text("s.t", F.col("o_custkey") * 2)).alias("dependencies"))
    return decisions.unresolved(tables.unionByName(views))

