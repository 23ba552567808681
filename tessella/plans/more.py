"""Named queries, continued: joins between facets of the model, folds of privileges, planning decisions, statement text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import diff, fold, graph, rollup, sequence
from ..rules import packs
from ..sources import fixtures, readers
from . import api
from .catalogue import DIFF_SQL, query


@query(
    "prefix_compatible",
    """SELECT a.n_regionkey AS before_region, b.n_regionkey AS after_region, a.names[1:2] = b.names[1:2] AND len(a.names) <= len(b.names) AS compatible
    FROM (SELECT n_regionkey, list(left(n_name, 1) ORDER BY n_nationkey) AS names FROM nation GROUP BY 1) a JOIN (SELECT n_regionkey, list(left(n_name, 1) ORDER BY n_nationkey) AS names FROM nation GROUP BY 1) b ON a.n_regionkey <= b.n_regionkey""",
)
def _(t):
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", F.left("n_name", F.lit(1)).alias("l")))), lambda s: s["l"])
    lists = t.nation.groupBy("n_regionkey").agg(listed.alias("names"))
    a, b = lists.toDF("before_region", "a"), lists.toDF("after_region", "b")
    same = (F.slice("a", 1, 2) == F.slice("b", 1, 2)) & (F.size("a") <= F.size("b"))
    return a.join(b, F.col("before_region") <= F.col("after_region")).select("before_region", "after_region", same.alias("compatible"))


@query(
    "dependent_detection",
    """SELECT from_key AS key, min(reason) AS reason FROM (SELECT from_key, 'owner' AS reason FROM deps WHERE to_key IN ('nation:1', 'nation:2') UNION ALL
    SELECT from_key, 'through' FROM deps WHERE to_key IN (SELECT from_key FROM deps WHERE to_key = 'nation:1')) GROUP BY from_key""",
    "deps",
)
def _(t):
    deps = t.dependencies()
    dropped = t.spark.createDataFrame([("nation:1",), ("nation:2",)], "to_key string")
    owner = deps.join(F.broadcast(dropped), "to_key", "left_semi").select(F.col("from_key").alias("key"), F.lit("owner").alias("reason"))
    inner = deps.where("to_key = 'nation:1'").select(F.col("from_key").alias("to_key"))
    through = deps.join(inner, "to_key", "left_semi").select(F.col("from_key").alias("key"), F.lit("through").alias("reason"))
    return owner.unionByName(through).groupBy("key").agg(F.min("reason").alias("reason"))


@query("grant_target_semi", "SELECT ordinal, target FROM privs WHERE verb = 'GRANT' AND (ordinal, target) IN (SELECT (ordinal, target) FROM targets)", "privs", "targets")
def _(t):
    return t.privileges().where("verb = 'GRANT'").join(t.targets(), ["ordinal", "target"], "left_semi").select("ordinal", "target")


@query(
    "comment_targets",
    "SELECT o.key, c.doc_id FROM objects o JOIN (SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN 'supplier:' ELSE 'customer:' END || doc_id AS key FROM documents) c ON c.key = o.key",
    "objects",
)
def _(t):
    kind = F.when(F.col("doc_id") % 2 == 0, "supplier:").otherwise("customer:")
    comments = t.documents.select("doc_id", F.concat(kind, F.col("doc_id").cast("string")).alias("key"))
    return t.objects().select("key").join(comments, "key").select("key", "doc_id")


@query("routine_prefix_overlap", "SELECT a.key, b.schema_name AS owner FROM objects a JOIN (SELECT DISTINCT schema_name FROM objects WHERE schema_name LIKE 'Brand%') b ON a.kind || '' IS NOT NULL AND (split_part(split_part(a.key, ':', 2), '.', 1) = b.schema_name)", "objects")
def _(t):
    # A string prefix up to the dot is an equality on the part before it: no theta join.
    owners = t.objects().where("schema_name LIKE 'Brand%'").select(F.col("schema_name").alias("owner")).distinct()
    rows = t.objects().select("key", F.split_part(F.split_part("key", F.lit(":"), F.lit(2)), F.lit("."), F.lit(1)).alias("owner"))
    return rows.join(owners, "owner").select("key", "owner")


@query("first_owner_wins", "SELECT name, key FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY kind = 'supplier' DESC, ordinal, key) AS n FROM objects) WHERE n = 1", "objects")
def _(t):
    return fold.latest(t.objects(), ["name"], F.desc(F.col("kind") == "supplier"), F.col("ordinal"), F.col("key")).select("name", "key")


@query(
    "operation_dependencies",
    "SELECT DISTINCT o.key, x.need FROM (SELECT key FROM snap_from) o JOIN (SELECT from_key AS key, to_key AS need FROM deps UNION ALL SELECT d.from_key, e.to_key FROM deps d JOIN deps e ON e.from_key = d.to_key) x ON x.key = o.key",
    "snap_from",
    "deps",
)
def _(t):
    deps = t.dependencies()
    direct = deps.select(F.col("from_key").alias("key"), F.col("to_key").alias("need"))
    second = deps.join(deps.select(F.col("from_key").alias("to_key"), F.col("to_key").alias("need")), "to_key").select(F.col("from_key").alias("key"), "need")
    return t.snapshots()[0].select("key").join(direct.unionByName(second), "key").distinct()


@query(
    "fk_referenced_keys",
    "SELECT l_orderkey, l_linenumber, o_orderkey IS NOT NULL AS resolved FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = l_orderkey",
)
def _(t):
    keys = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(True).alias("_there"))
    return t.lineitem.select("l_orderkey", "l_linenumber").distinct().join(keys, "l_orderkey", "left").select("l_orderkey", "l_linenumber", F.col("_there").isNotNull().alias("resolved"))


@query("edge_orientation", f"SELECT d.from_key, d.to_key, CASE WHEN o.op = 'drop' THEN d.from_key ELSE d.to_key END AS src, CASE WHEN o.op = 'drop' THEN d.to_key ELSE d.from_key END AS dst FROM deps d JOIN ({DIFF_SQL}) o ON o.key = d.from_key", "snap_from", "snap_to", "deps")
def _(t):
    ops = diff.snapshot_diff(*t.snapshots()).select(F.col("key").alias("from_key"), "op")
    drops = F.col("op") == "drop"
    return t.dependencies().join(ops, "from_key").select("from_key", "to_key", F.when(drops, F.col("from_key")).otherwise(F.col("to_key")).alias("src"), F.when(drops, F.col("to_key")).otherwise(F.col("from_key")).alias("dst"))


@query("public_function_without_revoke", "SELECT file, idx FROM stmts s WHERE tag = 'user' AND NOT EXISTS (SELECT 1 FROM stmts r WHERE r.file = s.file AND r.tag = 'system')", "stmts")
def _(t):
    s = t.statements()
    return s.where("tag = 'user'").join(s.where("tag = 'system'").select("file"), "file", "left_anti").select("file", "idx")


@query(
    "type_name_resolution",
    "SELECT name, CASE WHEN count(*) = 1 THEN min(key) END AS resolved, count(*) AS candidates FROM objects WHERE kind <> 'customer' GROUP BY name",
    "objects",
)
def _(t):
    rows = t.objects().where("kind <> 'customer'")
    return rows.groupBy("name").agg(F.when(F.count("*") == 1, F.min("key")).alias("resolved"), F.count("*").alias("candidates"))


@query("role_references", "SELECT DISTINCT role FROM (SELECT CAST(grantee AS VARCHAR) AS role FROM privs UNION ALL SELECT tag FROM stmts)", "privs", "stmts")
def _(t):
    return t.privileges().select(F.col("grantee").cast("string").alias("role")).unionByName(t.statements().select(F.col("tag").alias("role"))).distinct()


@query("header_summary", f"SELECT string_agg(n || ' ' || op, ', ' ORDER BY op) AS header FROM (SELECT op, count(*) AS n FROM ({DIFF_SQL}) GROUP BY op)", "snap_from", "snap_to")
def _(t):
    counted = diff.summary(diff.snapshot_diff(*t.snapshots()))
    return counted.agg(F.expr("listagg(concat(n, ' ', op), ', ') WITHIN GROUP (ORDER BY op)").alias("header"))


@query("plan_fingerprint", f"SELECT sha256(string_agg(op || ' ' || key, chr(10) ORDER BY op || ' ' || key)) AS fingerprint FROM ({DIFF_SQL}) WHERE op <> 'change'", "snap_from", "snap_to")
def _(t):
    ops = diff.snapshot_diff(*t.snapshots()).where("op <> 'change'").select(F.concat_ws(" ", "op", "key").alias("line"))
    return ops.agg(F.sha2(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY line)"), 256).alias("fingerprint"))


@query("merge_split_grants", "SELECT target, grantee, count(DISTINCT privilege) AS n, bool_or(ordinal % 5 = 0) AS grantable FROM privs WHERE verb = 'GRANT' GROUP BY 1, 2 HAVING count(*) >= 2", "privs")
def _(t):
    merged = t.privileges().where("verb = 'GRANT'").groupBy("target", "grantee").agg(F.count("*").alias("_rows"), F.count_distinct("privilege").alias("n"), F.bool_or(F.col("ordinal") % 5 == 0).alias("grantable"))
    return merged.where("_rows >= 2").drop("_rows")


@query(
    "column_grant_absorption",
    """WITH g AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, value > 30 AS whole FROM events)
    SELECT DISTINCT user_id, event_type, day FROM g p WHERE NOT whole AND NOT EXISTS (SELECT 1 FROM g w WHERE w.whole AND w.user_id = p.user_id AND w.event_type = p.event_type AND w.day = p.day)""",
)
def _(t):
    # Low values stand for grants on columns, high ones for grants on whole tables.
    keys = ["user_id", "event_type", "day"]
    grants = t.events.withColumn("day", F.to_date("ts"))
    return grants.where("value <= 30").select(*keys).distinct().join(grants.where("value > 30").select(*keys), keys, "left_anti")


@query("cleared_pairs", "SELECT target, grantee, privilege, count(*) FILTER (verb = 'REVOKE' AND before = 'GRANT') AS cleared FROM (SELECT *, lag(verb) OVER (PARTITION BY target, grantee, privilege ORDER BY ordinal) AS before FROM privs) GROUP BY 1, 2, 3", "privs")
def _(t):
    before = F.lag("verb").over(Window.partitionBy("target", "grantee", "privilege").orderBy("ordinal"))
    rows = t.privileges().withColumn("before", before)
    return rows.groupBy("target", "grantee", "privilege").agg(F.count_if((F.col("verb") == "REVOKE") & (F.col("before") == "GRANT")).alias("cleared"))


@query("routine_overloads", "SELECT p_type, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS overloads, count(DISTINCT p_brand) AS n FROM part GROUP BY p_type")
def _(t):
    return t.part.groupBy("p_type").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), "|").alias("overloads"), F.count_distinct("p_brand").alias("n"))


@query("ambiguous_aliases", "SELECT key, name, count(*) OVER (PARTITION BY name) > 1 AS ambiguous FROM objects", "objects")
def _(t):
    counted = t.objects().groupBy("name").agg(F.count("*").alias("_n"))
    return t.objects().join(counted, "name").select("key", "name", (F.col("_n") > 1).alias("ambiguous"))


@query("timing_reduce", "SELECT user_id, max(value) FILTER (n > 1) AS slowest, coalesce(max(value) FILTER (n > 1) > 45, FALSE) AS over_budget FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) GROUP BY user_id")
def _(t):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    slowest = F.max(F.when(F.col("n") > 1, F.col("value")))
    return t.events.withColumn("n", n).groupBy("user_id").agg(slowest.alias("slowest"), F.coalesce(slowest > 45, F.lit(False)).alias("over_budget"))


@query("remediation_plan", "SELECT file, code, row_number() OVER (PARTITION BY file ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, seq) AS step FROM findings WHERE severity <> 'info'", "findings")
def _(t):
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    numbered = sequence.renumber(t.findings().where("severity <> 'info'"), ["file"], rank, F.col("seq"))
    return numbered.select("file", "code", (F.col("position") + 1).alias("step"))


@query("section_union", "SELECT section, row_number() OVER (PARTITION BY section ORDER BY name) - 1 AS position, name FROM (SELECT 'region' AS section, r_name AS name FROM region UNION ALL SELECT 'nation', n_name FROM nation UNION ALL SELECT 'supplier', s_name FROM supplier)")
def _(t):
    part = lambda df, section, name: df.select(F.lit(section).alias("section"), F.col(name).alias("name"))
    rows = part(t.region, "region", "r_name").unionByName(part(t.nation, "nation", "n_name")).unionByName(part(t.supplier, "supplier", "s_name"))
    return sequence.renumber(rows, ["section"], F.col("name"))


@query("constraint_columns_ordered", "SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS lines FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY 1")
def _(t):
    listed = F.array_sort(F.collect_set("l_linenumber"))
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(listed.cast("array<string>"), ",").alias("lines"))


@query("partition_parents", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey > 1 LEFT JOIN region ON r_regionkey = n_regionkey")
def _(t):
    joined = t.customer.join(t.nation, (F.col("n_nationkey") == F.col("c_nationkey")) & (F.col("n_regionkey") > 1), "left")
    return joined.join(t.region, F.col("r_regionkey") == F.col("n_regionkey"), "left").select("c_custkey", "n_name", "r_name")


@query("default_privileges_not_builtin", "SELECT grantee, privilege, count(*) AS n FROM privs p WHERE NOT EXISTS (SELECT 1 FROM (VALUES (0, 'view'), (1, 'click')) AS d(grantee, privilege) WHERE d.grantee = p.grantee AND d.privilege = p.privilege) GROUP BY 1, 2", "privs")
def _(t):
    builtin = t.spark.createDataFrame([(0, "view"), (1, "click")], "grantee long, privilege string")
    return t.privileges().join(F.broadcast(builtin), ["grantee", "privilege"], "left_anti").groupBy("grantee", "privilege").agg(F.count("*").alias("n"))


@query("bootstrap_subtraction", "SELECT key FROM objects WHERE kind <> 'supplier' AND coalesce(schema_name, '') NOT IN ('BUILDING', 'Brand#3') AND key NOT IN (SELECT key FROM objects WHERE ordinal < 3)", "objects")
def _(t):
    rows = t.objects()
    schemas = t.spark.createDataFrame([("BUILDING",), ("Brand#3",)], "schema_name string")
    declared = rows.where("ordinal < 3").select("key")
    return rows.where("kind <> 'supplier'").join(F.broadcast(schemas), "schema_name", "left_anti").join(declared, "key", "left_anti").select("key")


@query("pruned_comments", "SELECT d.doc_id FROM documents d WHERE d.doc_id % 2 = 0 OR EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def _(t):
    # Kept unless of a filtered family, and then only with a target.
    docs, target = t.documents.select("doc_id"), t.labels.select("doc_id").distinct().withColumn("_there", F.lit(True))
    return docs.join(target, "doc_id", "left").where((F.col("doc_id") % 2 == 0) | F.col("_there").isNotNull()).select("doc_id")


@query("replay_parity", "SELECT key, side FROM (SELECT from_key AS key, 'missing' AS side FROM deps WHERE from_key NOT IN (SELECT key FROM snap_to) AND from_key LIKE 'order:%' UNION ALL SELECT key, 'extra' FROM snap_to WHERE key NOT IN (SELECT from_key FROM deps))", "deps", "snap_to")
def _(t):
    orders = t.dependencies().where("from_key LIKE 'order:%'").select(F.col("from_key").alias("key"))
    sides = diff.symmetric_difference(orders, t.snapshots()[1])
    return sides.select("key", F.when(F.col("side") == "left", "missing").otherwise("extra").alias("side"))


@query("destructive_disposition", f"SELECT key, CASE WHEN op = 'drop' AND ordinal % 4 = 0 THEN 'intent' WHEN op = 'drop' AND ordinal % 6 = 0 THEN 'hint' WHEN op = 'drop' THEN 'blocked' ELSE 'allowed' END AS disposition FROM (SELECT *, CAST(split_part(key, ':', 2) AS BIGINT) AS ordinal FROM ({DIFF_SQL}))", "snap_from", "snap_to")
def _(t):
    ops = diff.snapshot_diff(*t.snapshots()).withColumn("ordinal", F.split_part("key", F.lit(":"), F.lit(2)).cast("long"))
    # Intent found in the history goes before a hint; what has neither is blocked.
    intents = ops.where("ordinal % 4 = 0").select("key", F.lit("intent").alias("_intent"))
    hints = ops.where("ordinal % 6 = 0").select("key", F.lit("hint").alias("_hint"))
    joined = ops.join(intents, "key", "left").join(hints, "key", "left")
    return joined.select("key", F.when(F.col("op") == "drop", F.coalesce("_intent", "_hint", F.lit("blocked"))).otherwise("allowed").alias("disposition"))


@query("changed_field_names", "SELECT f.key, concat_ws(',', CASE WHEN f.grp IS DISTINCT FROM t.grp THEN 'grp' END, CASE WHEN f.status IS DISTINCT FROM t.status THEN 'status' END) AS fields FROM snap_from f JOIN snap_to t ON f.key = t.key WHERE f.hash <> t.hash", "snap_from", "snap_to")
def _(t):
    before, after = t.snapshots()
    joined = before.join(after.select("key", *(F.col(c).alias(f"_{c}") for c in ("hash", "grp", "status"))), "key").where("hash <> _hash")
    names = F.concat_ws(",", *(F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in ("grp", "status")))
    return joined.select("key", names.alias("fields"))


@query("rls_equality_suppression", "SELECT f.key FROM snap_from f JOIN snap_to t ON f.key = t.key WHERE f.hash <> t.hash AND NOT (f.status = t.status AND f.grp = t.grp) AND f.grp <> '5-LOW'", "snap_from", "snap_to")
def _(t):
    before, after = t.snapshots()
    joined = before.join(after.select("key", *(F.col(c).alias(f"_{c}") for c in ("hash", "grp", "status"))), "key").where("hash <> _hash")
    return joined.where(~(F.col("status").eqNullSafe(F.col("_status")) & F.col("grp").eqNullSafe(F.col("_grp"))) & (F.col("grp") != "5-LOW")).select("key")


@query("rule_public_grants", "SELECT 'P01' AS code, 'warning' AS severity, CAST(target AS VARCHAR) AS subject FROM privs WHERE verb = 'GRANT' AND grantee = 0", "privs")
def _(t):
    grants = t.privileges().where("verb = 'GRANT'").select(F.col("target"), F.when(F.col("grantee") == 0, "PUBLIC").otherwise("other").alias("grantee"))
    return packs.public_grants(packs.Model({"grants": grants}))


@query("guard_splice", "SELECT p_partkey, substring(p_name, 1, 4) || 'IF NOT EXISTS ' || substring(p_name, 5) AS guarded FROM part")
def _(t):
    return t.part.select("p_partkey", F.overlay("p_name", F.lit("IF NOT EXISTS "), F.lit(5), F.lit(0)).alias("guarded"))


@query("split_concurrent", "SELECT version, CAST(version AS BIGINT) % 10 = 7 AS own_transaction, row_number() OVER (PARTITION BY CAST(version AS BIGINT) % 10 = 7, substring(version, 1, 11) ORDER BY version) AS place FROM disk", "disk")
def _(t):
    disk = t.histories()[0].withColumn("own_transaction", F.col("version").cast("long") % 10 == 7).withColumn("_p", F.substring("version", 1, 11))
    return sequence.renumber(disk, ["own_transaction", "_p"], F.col("version")).select("version", "own_transaction", (F.col("position") + 1).alias("place"))


@query("sarif_report", "SELECT file, '[' || string_agg('{\"level\":\"' || severity || '\",\"ruleId\":\"' || code || '\"}', ',' ORDER BY seq) || ']' AS results FROM findings WHERE severity = 'error' GROUP BY file", "findings")
def _(t):
    item = F.to_json(F.struct(F.col("severity").alias("level"), F.col("code").alias("ruleId")))
    listed = F.array_sort(F.collect_list(F.struct("seq", item.alias("j"))))
    rows = t.findings().where("severity = 'error'").groupBy("file").agg(F.transform(listed, lambda s: s["j"]).alias("l"))
    return rows.select("file", F.concat(F.lit("["), F.array_join("l", ","), F.lit("]")).alias("results"))


@query("onboarding_readiness", "SELECT file, count(DISTINCT code) AS systems, greatest(0, 100 - 10 * count(*) FILTER (severity = 'error')) >= 90 AND count(DISTINCT code) = 1 AS ready FROM (SELECT severity, split_part(code, '_', 1) AS code, seq // 4 AS file FROM findings) GROUP BY file", "findings")
def _(t):
    rows = t.findings().select("severity", F.split_part("code", F.lit("_"), F.lit(1)).alias("code"), F.floor(F.col("seq") / 4).alias("file"))
    scores = rollup.scan_scores(rows, warning_cost=0)
    systems = rows.groupBy("file").agg(F.count_distinct("code").alias("systems"))
    return systems.join(scores, "file").select("file", "systems", ((F.col("score") >= 90) & (F.col("systems") == 1)).alias("ready"))


# --- scale: schemas of 1,000 and 2,500 tables -----------------------------------------------------------------------------


def _schema_sql(tables: int) -> str:
    before, after = fixtures.state_sql(tables, False, "duckdb"), fixtures.state_sql(tables, True, "duckdb")
    return f"""WITH b AS ({before}), a AS ({after}) SELECT coalesce(a.kind, b.kind) AS object_kind, CASE WHEN b.key IS NULL THEN 'create' WHEN a.key IS NULL THEN 'drop' ELSE 'change' END AS op, count(*) AS n
        FROM b FULL OUTER JOIN a ON a.key = b.key WHERE a.hash IS DISTINCT FROM b.hash GROUP BY 1, 2"""


def _schema_diff(tables: int):
    def build(t):
        return api.operations(*fixtures.states(t.spark, tables)).groupBy("object_kind", "op").agg(F.count("*").alias("n"))

    return build


query("schema_diff_xl", _schema_sql(1_000))(_schema_diff(1_000))
query("schema_diff_xxl", _schema_sql(2_500))(_schema_diff(2_500))


@query("schema_plan_xl")
def _(t):
    return api.plan(*fixtures.states(t.spark, 1_000))


@query("schema_plan_xxl")
def _(t):
    return api.plan(*fixtures.states(t.spark, 2_500))


# The whole way: definition text to states, their difference, the order of operations, and statements.


def _schema_way(tables: int):
    def build(t):
        before, after = (graph.materialise(readers.objects_of(fixtures.texts(t.spark, tables, changed))) for changed in (False, True))
        planned = graph.materialise(api.plan(before, after))
        return api.render(planned, before, after)

    return build


query("schema_way_xl")(_schema_way(1_000))
query("schema_way_xxl")(_schema_way(2_500))
