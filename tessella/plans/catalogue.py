"""Named queries: each pairs a DataFrame plan with SQL that gives the same rows.

``@query(name, sql, views...)`` registers a function of (tables).  The SQL stands behind the named views of
``sources.views``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof, diff, fold, graph, rollup, sequence
from ..sources.views import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql, *views) if views else sql
        return build

    return register


# --- comparison of states ------------------------------------------------------------------------------------------------

DIFF_SQL = """SELECT coalesce(f.key, t.key) AS key, CASE WHEN f.key IS NULL THEN 'create' WHEN t.key IS NULL THEN 'drop' ELSE 'change' END AS op
    FROM snap_from f FULL OUTER JOIN snap_to t ON f.key = t.key WHERE f.hash IS DISTINCT FROM t.hash"""


@query("snapshot_diff_ops", DIFF_SQL, "snap_from", "snap_to")
def _(t):
    return diff.snapshot_diff(*t.snapshots())


@query("snapshot_diff_summary", f"SELECT op, count(*) AS n FROM ({DIFF_SQL}) GROUP BY op", "snap_from", "snap_to")
def _(t):
    return diff.summary(diff.snapshot_diff(*t.snapshots()))


@query("snapshot_self_diff_empty", "SELECT count(*) AS n FROM snap_from a FULL OUTER JOIN snap_from b ON a.key = b.key WHERE a.hash IS DISTINCT FROM b.hash", "snap_from")
def _(t):
    before, _ = t.snapshots()
    return diff.snapshot_diff(before, before).agg(F.count("*").alias("n"))


HINTS = [("order:1", "order:10"), ("order:11", "order:20"), ("order:21", "order:30"), ("order:2", "order:40"), ("order:31", "order:32")]


@query(
    "rename_hints_applied",
    f"""SELECT key, op FROM ops WHERE key NOT IN (SELECT from_key FROM matched) AND key NOT IN (SELECT to_key FROM matched)
    UNION ALL SELECT from_key || ' -> ' || to_key, 'rename' FROM matched
    UNION ALL SELECT from_key || ' -> ' || to_key, 'hint_error' FROM hints WHERE (from_key, to_key) NOT IN (SELECT (from_key, to_key) FROM matched)""".replace(
        "SELECT key, op FROM ops", f", ops AS ({DIFF_SQL}), hints(from_key, to_key) AS (VALUES {', '.join(map(str, HINTS))}), matched AS (SELECT h.* FROM hints h JOIN ops d ON d.key = h.from_key AND d.op = 'drop' JOIN ops c ON c.key = h.to_key AND c.op = 'create') SELECT key, op FROM ops", 1
    ),
    "snap_from",
    "snap_to",
)
def _(t):
    hints = t.spark.createDataFrame(HINTS, "from_key string, to_key string")
    return diff.renamed(diff.snapshot_diff(*t.snapshots()), hints)


@query(
    "owner_implied_drops",
    """SELECT d.from_key AS key, d.to_key AS owner FROM deps d WHERE d.from_key LIKE 'order:%' AND CAST(split_part(d.from_key, ':', 2) AS BIGINT) % 3 = 0
    AND NOT EXISTS (SELECT 1 FROM deps o WHERE o.from_key = d.to_key AND CAST(split_part(o.from_key, ':', 2) AS BIGINT) % 3 = 0)""",
    "deps",
)
def _(t):
    drops = t.dependencies().where("CAST(split_part(from_key, ':', 2) AS BIGINT) % 3 = 0").select(F.col("from_key").alias("key"), F.col("to_key").alias("owner"))
    return diff.implied_drops(drops, "owner").where("key LIKE 'order:%'")


@query(
    "selfcheck_three_way",
    f"SELECT key, CASE op WHEN 'drop' THEN 'MISSING' WHEN 'create' THEN 'UNEXPECTED' ELSE 'HASH_MISMATCH' END AS finding FROM ({DIFF_SQL})",
    "snap_from",
    "snap_to",
)
def _(t):
    return diff.three_way(*t.snapshots())


@query(
    "symmetric_difference_keys",
    "SELECT key, 'left' AS side FROM (SELECT key FROM snap_from EXCEPT SELECT key FROM snap_to) UNION ALL SELECT key, 'right' FROM (SELECT key FROM snap_to EXCEPT SELECT key FROM snap_from)",
    "snap_from",
    "snap_to",
)
def _(t):
    return diff.symmetric_difference(*t.snapshots())


@query(
    "history_reconcile",
    "SELECT version, 'missing' AS state FROM disk WHERE version NOT IN (SELECT version FROM applied) UNION ALL SELECT version, 'unexpected' FROM applied WHERE version NOT IN (SELECT version FROM disk)",
    "disk",
    "applied",
)
def _(t):
    return diff.reconcile(*t.histories())


@query(
    "history_status",
    """SELECT coalesce(d.version, a.version) AS version, CASE WHEN d.version IS NULL THEN 'ghost' WHEN a.version IS NOT NULL THEN 'applied'
    WHEN d.version < (SELECT max(version) FROM applied) THEN 'out_of_order' ELSE 'pending' END AS state FROM disk d FULL OUTER JOIN applied a ON d.version = a.version""",
    "disk",
    "applied",
)
def _(t):
    return diff.history_status(*t.histories())


# Columns of two table definitions: one dropped, one of another type, one that became nullable, one table gone.
COLUMNS_BEFORE = [
    ("orders", "o_orderkey", "bigint", True), ("orders", "o_custkey", "bigint", True), ("orders", "o_orderstatus", "text", True), ("orders", "o_totalprice", "numeric", False), ("orders", "o_note", "text", None),
    ("customer", "c_custkey", "bigint", True), ("customer", "c_name", "text", True), ("region", "r_regionkey", "int", True), ("region", "r_name", "text", False),
]
COLUMNS_AFTER = [
    ("orders", "o_orderkey", "bigint", True), ("orders", "o_custkey", "text", True), ("orders", "o_orderstatus", "text", False), ("orders", "o_note", "text", None), ("orders", "o_extra", "text", False),
    ("customer", "c_custkey", "bigint", True), ("customer", "c_name", "text", True),
]
COLUMN_DDL = "table_name string, column_name string, type string, not_null boolean"


def _values(rows: list[tuple]) -> str:
    text = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else repr(v)
    return "VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)


COLUMNS_SQL = f"WITH b(table_name, column_name, type, not_null) AS ({_values(COLUMNS_BEFORE)}), a(table_name, column_name, type, not_null) AS ({_values(COLUMNS_AFTER)}) "


@query(
    "contract_breaking_changes",
    COLUMNS_SQL
    + """SELECT DISTINCT table_name, CASE WHEN change <> 'table_removed' THEN column_name END AS column_name, change FROM (
    SELECT b.table_name, b.column_name, CASE WHEN b.table_name NOT IN (SELECT table_name FROM a) THEN 'table_removed' WHEN a.column_name IS NULL THEN 'column_removed'
    WHEN a.type IS DISTINCT FROM b.type THEN 'type_changed' WHEN a.not_null IS DISTINCT FROM b.not_null THEN 'nullability_changed' END AS change
    FROM b LEFT JOIN a ON a.table_name = b.table_name AND a.column_name = b.column_name) WHERE change IS NOT NULL""",
)
def _(t):
    return diff.contract_breaks(t.spark.createDataFrame(COLUMNS_BEFORE, COLUMN_DDL), t.spark.createDataFrame(COLUMNS_AFTER, COLUMN_DDL))


@query(
    "column_delta_facets",
    COLUMNS_SQL
    + """SELECT coalesce(a.table_name, b.table_name) AS table_name, coalesce(a.column_name, b.column_name) AS column_name,
    CASE WHEN b.table_name IS NULL THEN 'add' WHEN a.table_name IS NULL THEN 'drop' ELSE 'alter' END AS delta,
    CASE WHEN a.table_name IS NULL OR b.table_name IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.not_null IS DISTINCT FROM b.not_null THEN 'not_null' END, CASE WHEN a.type IS DISTINCT FROM b.type THEN 'type' END) END AS facets
    FROM b FULL OUTER JOIN a ON a.table_name = b.table_name AND a.column_name = b.column_name
    WHERE a.table_name IS NULL OR b.table_name IS NULL OR a.type IS DISTINCT FROM b.type OR a.not_null IS DISTINCT FROM b.not_null""",
)
def _(t):
    return diff.column_deltas(t.spark.createDataFrame(COLUMNS_BEFORE, COLUMN_DDL), t.spark.createDataFrame(COLUMNS_AFTER, COLUMN_DDL))


@query(
    "fk_target_completion",
    """SELECT f.name, f.table_name, f.ref_table, p.columns AS ref_columns, EXISTS (SELECT 1 FROM customer c WHERE 't' || c_custkey % 40 = f.table_name AND list_sort(['c' || c_custkey % 3, 'k' || c_custkey % 2]) = list_sort(f.columns)) AS one_to_one
    FROM (SELECT 'fk' || o_orderkey AS name, 't' || o_custkey % 40 AS table_name, ['k' || o_orderkey % 4, 'c' || o_orderkey % 3] AS columns, 't' || o_orderkey % 50 AS ref_table FROM orders) f
    LEFT JOIN (SELECT 't' || n_nationkey AS table_name, 'id,r' || n_regionkey AS columns FROM nation) p ON p.table_name = f.ref_table""",
)
def _(t):
    name = lambda prefix, value: F.concat(F.lit(prefix), value.cast("string"))
    key, cust = F.col("o_orderkey"), F.col("c_custkey")
    own = F.array(name("k", key % 4), name("c", key % 3))
    none = F.lit(None).cast("array<string>")
    fks = t.orders.select(name("fk", key).alias("name"), name("t", F.col("o_custkey") % 40).alias("table_name"), own.alias("columns"), name("t", key % 50).alias("ref_table"), none.alias("ref_columns"))
    primary = t.nation.select(name("t", F.col("n_nationkey")).alias("table_name"), F.array(F.lit("id"), name("r", F.col("n_regionkey"))).alias("columns"))
    unique = t.customer.select(name("t", cust % 40).alias("table_name"), F.array(name("c", cust % 3), name("k", cust % 2)).alias("columns"))
    return diff.fk_targets(fks, primary, unique)


@query(
    "asof_privilege_coverage",
    """SELECT t.ordinal, t.target, bool_and(coalesce((SELECT arg_max(p.verb, p.ordinal) FROM privs p WHERE p.target = t.target AND p.privilege = e.privilege AND p.ordinal <= t.ordinal) = 'GRANT', FALSE)) AS implied
    FROM targets t, (SELECT DISTINCT privilege FROM privs) e GROUP BY t.ordinal, t.target""",
    "privs",
    "targets",
)
def _(t):
    log = t.privileges()
    return asof.covered(t.targets(), log, log.select("privilege").distinct())


@query(
    "residual_vs_baseline",
    """SELECT (SELECT count(*) FROM (SELECT key FROM snap_to EXCEPT SELECT key FROM snap_from)) AS n_new, (SELECT count(*) FROM snap_to) AS n_left,
    (SELECT count(*) FROM (SELECT key FROM snap_to EXCEPT SELECT key FROM snap_from)) = 0 AND (SELECT count(*) FROM snap_to) < (SELECT count(*) FROM snap_from) AS converging""",
    "snap_from",
    "snap_to",
)
def _(t):
    before, after = t.snapshots()
    return diff.residual(after, before)


@query("relational_division_intent", "SELECT DISTINCT l_orderkey FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linestatus IS DISTINCT FROM 'F')")
def _(t):
    return diff.division(t.lineitem, "l_orderkey", F.col("l_linestatus") == "F")


@query("column_dependents", "SELECT d.from_key AS key, d.to_key AS via FROM deps d WHERE d.to_key IN ('nation:3', 'nation:7', 'region:1')", "deps")
def _(t):
    wanted = t.spark.createDataFrame([("nation:3",), ("nation:7",), ("region:1",)], "via string")
    uses = t.dependencies().select(F.col("from_key").alias("key"), F.explode(F.array("to_key")).alias("via"))
    return uses.join(F.broadcast(wanted), "via", "left_semi").select("key", "via")


# --- grouped reports ------------------------------------------------------------------------------------------------------


@query("audit_by_kind", "SELECT kind, count(*) AS n FROM objects GROUP BY kind", "objects")
def _(t):
    return rollup.count_by(t.objects(), "kind")


@query("audit_by_schema", "SELECT coalesce(schema_name, '-') AS schema_name, count(*) AS n FROM objects GROUP BY 1", "objects")
def _(t):
    return rollup.count_by(t.objects(), "schema_name")


@query("audit_kind_schema_grouping_sets", "SELECT kind, s AS schema_name, CAST(grouping(kind) AS BIGINT) AS by_schema, count(*) AS n FROM (SELECT kind, coalesce(schema_name, '-') AS s FROM objects) GROUP BY GROUPING SETS ((kind), (s))", "objects")
def _(t):
    rows = t.objects().withColumn("schema_name", F.coalesce("schema_name", F.lit("-")))
    kind, schema = F.col("kind"), F.col("schema_name")
    return rows.groupingSets([[kind], [schema]], kind, schema).agg(F.grouping("kind").cast("long").alias("by_schema"), F.count("*").alias("n"))


@query("findings_rollup", "SELECT code, count(*) AS n, arg_min(severity, seq) AS severity FROM findings WHERE severity IN ('error', 'warning') GROUP BY code", "findings")
def _(t):
    return rollup.findings_rollup(t.findings())


@query(
    "findings_top5_samples",
    """SELECT code, string_agg(sample, ' | ' ORDER BY seq) AS samples FROM (SELECT code, seq, substring(regexp_replace(trim(regexp_replace(message, '[ \\t\\n\\r\\f]+', ' ', 'g')), '^ | $', '', 'g'), 1, 120) AS sample, row_number() OVER (PARTITION BY code ORDER BY seq) AS n
    FROM findings WHERE severity IN ('error', 'warning')) WHERE n <= 5 GROUP BY code""",
    "findings",
)
def _(t):
    return rollup.top_samples(t.findings())


SCORES_SQL = """SELECT file, errors, warnings, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade
    FROM (SELECT *, greatest(0, 100 - 10 * errors - 3 * warnings) AS score FROM (SELECT file, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM findings GROUP BY file))"""
# Files with a handful of findings each, so that every grade occurs.
FEW_SQL = "(SELECT code, severity, message, seq // 8 AS file, seq FROM findings)"


def _few(t):
    return t.findings().withColumn("file", F.floor(F.col("seq") / 8))


@query("scan_scores", SCORES_SQL.replace("FROM findings", f"FROM {FEW_SQL}"), "findings")
def _(t):
    return rollup.scan_scores(_few(t))


@query("scan_grade_histogram", f"SELECT g.grade, count(s.grade) AS n FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('F')) AS g(grade) LEFT JOIN ({SCORES_SQL.replace('FROM findings', f'FROM {FEW_SQL}')}) s ON s.grade = g.grade GROUP BY g.grade", "findings")
def _(t):
    return rollup.grade_histogram(rollup.scan_scores(_few(t)))


@query("scan_score_stats", f"SELECT count(*) AS n, round(avg(score), 6) AS average, CAST(median(score) AS DOUBLE) AS median, min(score) AS least, max(score) AS most FROM ({SCORES_SQL.replace('FROM findings', f'FROM {FEW_SQL}')})", "findings")
def _(t):
    return rollup.score_stats(rollup.scan_scores(_few(t)))


@query("diagnostic_counts", "SELECT severity, code, count(*) AS n FROM findings GROUP BY severity, code", "findings")
def _(t):
    return rollup.diagnostic_counts(t.findings())


@query("repeat_collapse", "SELECT severity || ' ' || code AS text, count(*) AS n, min(seq) AS first_seq FROM findings GROUP BY 1", "findings")
def _(t):
    return rollup.repeats(t.findings(), F.concat_ws(" ", "severity", "code"))


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return rollup.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("snapshot_fingerprint_by_group", "SELECT grp, sha256(string_agg(key || '=' || hash, chr(10) ORDER BY key || '=' || hash)) AS fingerprint FROM snap_from GROUP BY grp", "snap_from")
def _(t):
    return rollup.fingerprint(t.snapshots()[0], ["grp"])


@query("privilege_union", "SELECT target, grantee, string_agg(DISTINCT privilege, ',' ORDER BY privilege) AS members FROM privs WHERE verb = 'GRANT' GROUP BY 1, 2", "privs")
def _(t):
    return fold.element_union(t.privileges().where("verb = 'GRANT'"), ["target", "grantee"], "privilege")


@query(
    "full_set_to_all",
    "SELECT target, grantee, day, CASE WHEN count(DISTINCT privilege) = 5 THEN 'ALL' ELSE string_agg(DISTINCT privilege, ',' ORDER BY privilege) END AS members FROM (SELECT user_id % 20 AS target, user_id % 7 AS grantee, CAST(ts AS DATE) AS day, event_type AS privilege FROM events WHERE event_id % 3 <> 0) GROUP BY 1, 2, 3",
)
def _(t):
    full = t.spark.createDataFrame([("click",), ("error",), ("purchase",), ("signup",), ("view",)], "privilege string")
    grants = t.events.where("event_id % 3 <> 0").select((F.col("user_id") % 20).alias("target"), (F.col("user_id") % 7).alias("grantee"), F.to_date("ts").alias("day"), F.col("event_type").alias("privilege"))
    return fold.collapse_full(grants, ["target", "grantee", "day"], "privilege", full)


@query("dependency_union", "SELECT to_key, string_agg(DISTINCT split_part(from_key, ':', 1), ',' ORDER BY split_part(from_key, ':', 1)) AS members FROM deps GROUP BY to_key", "deps")
def _(t):
    return fold.element_union(t.dependencies().withColumn("kind", F.split_part("from_key", F.lit(":"), F.lit(1))), ["to_key"], "kind")


@query(
    "precision_recall_f1",
    """SELECT matched, missed, excess, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 9) AS f1 FROM (
    SELECT *, CASE WHEN matched + excess = 0 THEN 1.0::DOUBLE ELSE matched / (matched + excess)::DOUBLE END AS p, CASE WHEN matched + missed = 0 THEN 1.0::DOUBLE ELSE matched / (matched + missed)::DOUBLE END AS r FROM (
    SELECT count(*) FILTER (m.doc_id IS NOT NULL AND e.doc_id IS NOT NULL AND NOT destructive) AS matched, count(*) FILTER (e.doc_id IS NULL) AS missed, count(*) FILTER (e.doc_id IS NOT NULL AND (m.doc_id IS NULL OR destructive)) AS excess
    FROM (SELECT DISTINCT doc_id FROM manifest) m FULL OUTER JOIN emitted e ON m.doc_id = e.doc_id))""",
    "manifest",
    "emitted",
)
def _(t):
    return rollup.precision_recall(*t.scored(), "doc_id", "destructive")


@query(
    "units_by_version",
    "SELECT v AS version, string_agg(version, ',' ORDER BY concurrent, version) AS files, NOT bool_or(concurrent) AS transactional FROM (SELECT version, substring(version, 1, 13) AS v, CAST(version AS BIGINT) % 10 = 7 AS concurrent FROM disk) GROUP BY v",
    "disk",
)
def _(t):
    files = t.histories()[0].select(F.substring("version", 1, 13).alias("version"), F.col("version").alias("name"), (F.col("version").cast("long") % 10 == 7).alias("concurrent"))
    return rollup.units_by_version(files)


# --- ordered folds --------------------------------------------------------------------------------------------------------


@query("latest_per_key", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def _(t):
    return fold.latest(t.events, ["user_id", "event_type"], F.desc("event_id")).select("user_id", "event_type", "event_id", "value")


@query("privilege_net_state", "SELECT target, grantee, privilege FROM privs GROUP BY 1, 2, 3 HAVING arg_max(verb, ordinal) = 'GRANT'", "privs")
def _(t):
    return fold.net_state(t.privileges(), ["target", "grantee", "privilege"])


@query("privilege_net_fold", "SELECT target, grantee, coalesce(string_agg(privilege, ',' ORDER BY privilege) FILTER (v = 'GRANT'), '') AS members FROM (SELECT target, grantee, privilege, arg_max(verb, ordinal) AS v FROM privs GROUP BY 1, 2, 3) GROUP BY 1, 2", "privs")
def _(t):
    return fold.net_fold(t.privileges(), ["target", "grantee"], "privilege").select("target", "grantee", F.array_join("members", ",").alias("members"))


@query(
    "rls_state_fold",
    """SELECT * FROM (SELECT target, coalesce(arg_max(privilege = 'click', ordinal) FILTER (privilege IN ('click', 'view')), FALSE) AS enabled,
    coalesce(arg_max(privilege = 'signup', ordinal) FILTER (privilege IN ('signup', 'error')), FALSE) AS forced FROM privs GROUP BY target) WHERE enabled OR forced""",
    "privs",
)
def _(t):
    return fold.last_flag(t.privileges(), ["target"], {"enabled": (["click"], ["view"]), "forced": (["signup"], ["error"])}, "privilege")


FACETS_SQL = "SELECT ordinal, target, CASE WHEN privilege = 'click' THEN 'd' || grantee END AS default_value, CASE WHEN privilege = 'view' THEN 'i' || grantee END AS identity FROM privs"


@query("facet_last_value", f"SELECT target, arg_max(default_value, ordinal) FILTER (default_value IS NOT NULL) AS default_value, arg_max(identity, ordinal) FILTER (identity IS NOT NULL) AS identity FROM ({FACETS_SQL}) GROUP BY target", "privs")
def _(t):
    rows = t.privileges().select(
        "ordinal", "target", F.when(F.col("privilege") == "click", F.concat(F.lit("d"), F.col("grantee").cast("string"))).alias("default_value"), F.when(F.col("privilege") == "view", F.concat(F.lit("i"), F.col("grantee").cast("string"))).alias("identity")
    )
    return fold.last_facets(rows, ["target"], ["default_value", "identity"])


@query(
    "default_equal_revokes",
    """SELECT ordinal, target, grantee, privilege FROM (SELECT *, max(CASE WHEN verb = 'GRANT' THEN ordinal END) OVER w AS g, max(CASE WHEN verb = 'REVOKE' THEN ordinal END) OVER w AS r FROM privs
    WINDOW w AS (PARTITION BY target, grantee, privilege ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE verb = 'REVOKE' AND (g IS NULL OR r > g)""",
    "privs",
)
def _(t):
    return fold.idle_revokes(t.privileges(), ["target", "grantee"]).select("ordinal", "target", "grantee", "privilege")


@query("previous_row_guard", "SELECT file, idx FROM (SELECT *, lag(tag) OVER (PARTITION BY file ORDER BY idx) AS p FROM stmts) WHERE tag = 'user' AND p IS DISTINCT FROM 'assistant'", "stmts")
def _(t):
    return sequence.missing_guard(t.statements(), "file", "idx", F.col("tag") == "user", F.col("tag") == "assistant").select("file", "idx")


@query(
    "forward_references",
    "SELECT u.file, u.idx, 'assistant' AS name, d.first AS defined_at FROM stmts u JOIN (SELECT file, min(idx) AS first FROM stmts WHERE tag = 'assistant' GROUP BY file) d ON d.file = u.file WHERE u.tag = 'user' AND u.idx < d.first",
    "stmts",
)
def _(t):
    rows = t.statements().withColumn("name", F.lit("assistant"))
    return sequence.forward_references(rows.where("tag = 'user'").select("file", "idx", "name"), rows.where("tag = 'assistant'"), "file", "name", "idx")


@query("enum_add_then_use", "SELECT u.file, u.idx, u.tag AS name FROM stmts u WHERE EXISTS (SELECT 1 FROM stmts a WHERE a.file = u.file AND a.tag = u.tag AND a.idx < u.idx)", "stmts")
def _(t):
    rows = t.statements().select("file", "idx", F.col("tag").alias("name"))
    return sequence.used_after(rows, rows, "file", "name", "idx")


LINEAGE_SQL = "SELECT o_custkey AS chain, o_orderkey AS version, 'f' || (o_orderkey % 3) AS from_fp, 'f' || ((o_orderkey + o_custkey) % 3) AS to_fp, o_orderkey % 11 <> 0 AS known FROM orders"


def _lineage(t):
    name = lambda c: F.concat(F.lit("f"), (c % 3).cast("string"))
    return t.orders.select(F.col("o_custkey").alias("chain"), F.col("o_orderkey").alias("version"), name(F.col("o_orderkey")).alias("from_fp"), name(F.col("o_orderkey") + F.col("o_custkey")).alias("to_fp"), (F.col("o_orderkey") % 11 != 0).alias("known"))


@query("lineage_chain_gaps", f"SELECT chain, version FROM (SELECT *, lag(to_fp) OVER w AS p, row_number() OVER w AS n FROM ({LINEAGE_SQL}) WINDOW w AS (PARTITION BY chain ORDER BY version)) WHERE n > 1 AND p IS DISTINCT FROM from_fp")
def _(t):
    return sequence.chain_gaps(_lineage(t), "version", "from_fp", "to_fp", ["chain"]).select("chain", "version")


@query(
    "stale_lineage",
    f"""WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY version) AS n FROM ({LINEAGE_SQL})),
    r AS (SELECT chain, n, version, NOT known AS stale, CASE WHEN known THEN []::VARCHAR[] ELSE [to_fp] END AS made FROM l WHERE n = 1
    UNION ALL SELECT l.chain, l.n, l.version, NOT l.known OR list_contains(r.made, l.from_fp), CASE WHEN NOT l.known OR list_contains(r.made, l.from_fp) THEN list_append(r.made, l.to_fp) ELSE r.made END FROM r JOIN l ON l.chain = r.chain AND l.n = r.n + 1)
    SELECT chain, version FROM r WHERE stale""",
)
def _(t):
    return sequence.stale_lineage(_lineage(t), "chain")


@query("unproven_tail", "SELECT version FROM disk WHERE version > (SELECT max(version) FROM disk WHERE CAST(version AS BIGINT) % 1000 = 1)", "disk")
def _(t):
    disk = t.histories()[0]
    return sequence.after_baseline(disk, disk.where(F.col("version").cast("long") % 1000 == 1))


@query("ordinal_renumber", "SELECT key, row_number() OVER (PARTITION BY kind ORDER BY ordinal, key) - 1 AS position FROM objects", "objects")
def _(t):
    return sequence.renumber(t.objects(), ["kind"], F.col("ordinal"), F.col("key")).select("key", "position")


_KINDS = ", ".join(f"'{k}'" for k in sequence.KINDS)
_RANKS = " ".join(f"WHEN '{k}' THEN {10 * (i + 1)}" for i, k in enumerate(sequence.KINDS))
OPERATIONS_SQL = f"""SELECT key, op, ordinal, [{_KINDS}][1 + ordinal % {len(sequence.KINDS)}] AS kind FROM (
    SELECT key, op, CAST(split_part(key, ':', 2) AS BIGINT) AS ordinal FROM ({DIFF_SQL}) UNION ALL SELECT 'customer:' || c_custkey, 'rename', c_custkey FROM customer)"""


@query(
    "operation_sort",
    f"""SELECT key, op, kind, rank, row_number() OVER (ORDER BY rank, CASE WHEN op = 'drop' THEN -ordinal ELSE ordinal END, key) AS place FROM (
    SELECT *, CASE op WHEN 'drop' THEN 1000 - r WHEN 'rename' THEN 900 + r WHEN 'change' THEN 1050 + r ELSE 1000 + r END AS rank FROM (SELECT *, CASE kind {_RANKS} END AS r FROM ({OPERATIONS_SQL})))""",
    "snap_from",
    "snap_to",
)
def _(t):
    ops = diff.snapshot_diff(*t.snapshots()).select("key", "op", F.split_part("key", F.lit(":"), F.lit(2)).cast("long").alias("ordinal"))
    renamed = t.customer.select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("key"), F.lit("rename").alias("op"), F.col("c_custkey").alias("ordinal"))
    kinds = F.array(*map(F.lit, sequence.KINDS))
    both = ops.unionByName(renamed).withColumn("kind", kinds[(F.col("ordinal") % len(sequence.KINDS)).cast("int")])
    ranked = both.withColumn("rank", sequence.operation_rank(F.col("op"), F.col("kind")))
    order = ("rank", sequence.operation_ordinal(F.col("op"), F.col("ordinal")), "key")
    return sequence.number(ranked, *order).select("key", "op", "kind", "rank", "place")


@query("topn_per_group", "SELECT o_orderstatus, o_orderkey, place FROM (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 5")
def _(t):
    return sequence.top(t.orders, ["o_orderstatus"], 5, F.desc("o_totalprice"), F.col("o_orderkey")).select("o_orderstatus", "o_orderkey", "place")


# --- graphs ---------------------------------------------------------------------------------------------------------------


@query("dependents_closure", ", r(key) AS (SELECT 'region:1' UNION SELECT d.from_key FROM deps d JOIN r ON d.to_key = r.key) SELECT key FROM r", "deps")
def _(t):
    seeds = t.spark.createDataFrame([("region:1",)], "key string")
    return graph.dependents(t.dependencies(), seeds).select("key")


@query(
    "cascade_closure_depth",
    ", r(key, depth) AS (SELECT * FROM (VALUES ('nation:3', 0), ('region:0', 0)) UNION SELECT d.from_key, r.depth + 1 FROM deps d JOIN r ON d.to_key = r.key) SELECT key, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY key",
    "deps",
)
def _(t):
    return graph.dependents(t.dependencies(), t.spark.createDataFrame([("nation:3",), ("region:0",)], "key string"))


@query(
    "topological_plan_order",
    # Here a nation is ready once its region is out, and goes before the next region.
    """SELECT plan_id, key, row_number() OVER (PARTITION BY plan_id ORDER BY region, step, ordinal) - 1 AS seq, FALSE AS cyclic FROM (
    SELECT CAST(n_regionkey % 2 AS BIGINT) AS plan_id, 'nation:' || n_nationkey AS key, n_regionkey AS region, 1 AS step, n_nationkey AS ordinal FROM nation
    UNION SELECT CAST(n_regionkey % 2 AS BIGINT), 'region:' || n_regionkey, n_regionkey, 0, 0 FROM nation)""",
)
def _(t):
    edges = t.nation.select((F.col("n_regionkey") % 2).cast("long").alias("plan_id"), F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("src"), F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("dst"))
    keys = edges.select("plan_id", F.col("src").alias("key")).unionByName(edges.select("plan_id", F.col("dst").alias("key"))).distinct()
    nodes = keys.withColumn("rank", F.when(F.col("key").startswith("nation"), 1).otherwise(2).cast("long")).withColumn("ordinal", F.split_part("key", F.lit(":"), F.lit(2)).cast("long"))
    return graph.topological_order(nodes, edges)


@query(
    "cycle_detection",
    """WITH RECURSIVE e AS (SELECT s_suppkey AS src, (s_suppkey * s_suppkey + 1) % (SELECT count(*) FROM supplier) AS dst FROM supplier),
    w(start, here) AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT w.start, e.dst FROM w JOIN e ON e.src = w.here WHERE e.src <> e.dst) SELECT DISTINCT 's' || start AS key FROM w WHERE start = here""",
)
def _(t):
    n = t.supplier.agg(F.count("*").alias("n"))
    name = lambda value: F.concat(F.lit("s"), value.cast("string"))
    key = F.col("s_suppkey")
    return graph.cyclic_keys(t.supplier.crossJoin(F.broadcast(n)).select(name(key).alias("src"), name((key * key + 1) % F.col("n")).alias("dst")))


@query(
    "domain_chain",
    """WITH RECURSIVE l AS (SELECT 'd' || p_partkey AS name, CASE WHEN p_size % 5 = 0 THEN 'text' ELSE 'd' || ((p_partkey * 3 + p_size) % (SELECT count(*) FROM part)) END AS base FROM part),
    w(start, here, path, cyclic) AS (SELECT name, base, [name], base = name FROM l
    UNION ALL SELECT w.start, l.base, list_append(w.path, l.name), list_contains(w.path, l.base) OR l.base = l.name FROM w JOIN l ON l.name = w.here WHERE NOT w.cyclic)
    SELECT start, CASE WHEN NOT cyclic THEN here END AS target, len(path) AS length, cyclic FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY len(path) DESC) AS n FROM w) WHERE n = 1""",
)
def _(t):
    n = t.part.agg(F.count("*").alias("n"))
    name = lambda value: F.concat(F.lit("d"), value.cast("string"))
    base = F.when(F.col("p_size") % 5 == 0, F.lit("text")).otherwise(name((F.col("p_partkey") * 3 + F.col("p_size")) % F.col("n")))
    return graph.chains(t.spark, t.part.crossJoin(F.broadcast(n)).select(name(F.col("p_partkey")).alias("name"), base.alias("base")))
