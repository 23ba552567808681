"""Named queries, continued: catalog-shaped queries, filters, rules, checks, SELECT constructs and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import checks, rollup
from ..rules import packs
from .catalogue import query

# --- catalog-shaped queries -----------------------------------------------------------------------------------------------


@query("acl_explode_group", "SELECT target, grantee, string_agg(DISTINCT p, ',' ORDER BY p) AS privileges FROM (SELECT target, grantee, unnest(acl) AS p FROM (SELECT target, grantee, list(privilege) AS acl FROM privs GROUP BY 1, 2)) GROUP BY 1, 2", "privs")
def _(t):
    acl = t.privileges().groupBy("target", "grantee").agg(F.collect_set("privilege").alias("acl"))
    return acl.select("target", "grantee", F.explode("acl").alias("p")).groupBy("target", "grantee").agg(F.array_join(F.array_sort(F.collect_set("p")), ",").alias("privileges"))


@query("with_ordinality", "SELECT vec_id, CAST(i AS INTEGER) AS pos, CAST(e AS DOUBLE) AS x FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)")
def _(t):
    return t.embeddings.select("vec_id", F.posexplode("embedding").alias("pos", "e")).select("vec_id", "pos", F.col("e").cast("double").alias("x"))


@query("ordered_string_agg", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def _(t):
    return t.nation.groupBy("n_regionkey").agg(F.expr("listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name)").alias("names"))


@query("filtered_distinct_agg", "SELECT user_id, count(DISTINCT event_type) FILTER (value > 10) AS kinds, count(*) FILTER (event_type = 'error') AS errors, coalesce(string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (value > 40), '') AS large FROM events GROUP BY 1")
def _(t):
    large = F.array_join(F.array_sort(F.collect_set(F.when(F.col("value") > 40, F.col("event_type")))), ",")
    return t.events.groupBy("user_id").agg(F.count_distinct(F.when(F.col("value") > 10, F.col("event_type"))).alias("kinds"), F.count_if(F.col("event_type") == "error").alias("errors"), large.alias("large"))


@query("anti_join_members", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def _(t):
    members = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.select("o_orderkey").join(members, "o_orderkey", "left_anti")


@query("semi_join_policies", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')")
def _(t):
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey").join(urgent, "c_custkey", "left_semi")


# --- filters and rules ----------------------------------------------------------------------------------------------------


@query("schema_filter", "SELECT key, kind FROM objects WHERE schema_name IN ('Brand#1', 'Brand#2', 'BUILDING', 'MACHINERY') AND kind <> 'supplier'", "objects")
def _(t):
    return t.objects().where(F.col("schema_name").isin("Brand#1", "Brand#2", "BUILDING", "MACHINERY") & (F.col("kind") != "supplier")).select("key", "kind")


@query("severity_gate", "SELECT file, bool_or(severity = 'error') AS blocked, count(*) FILTER (severity = 'error') AS errors FROM findings GROUP BY file", "findings")
def _(t):
    return t.findings().groupBy("file").agg(F.bool_or(F.col("severity") == "error").alias("blocked"), F.count_if(F.col("severity") == "error").alias("errors"))


@query("severity_remap", "SELECT code, CASE severity WHEN 'error' THEN 'warning' ELSE severity END AS severity, count(*) AS n FROM findings GROUP BY 1, 2", "findings")
def _(t):
    return rollup.diagnostic_counts(packs.remap(t.findings(), "report_only")).select("code", "severity", "n")


@query("rule_naming", "SELECT key, lower(schema_name) AS low FROM objects WHERE NOT regexp_full_match(lower(schema_name), '[a-z0-9_]+')", "objects")
def _(t):
    return packs.odd_names(t.objects().withColumn("low", F.lower("schema_name")), "low").select("key", "low")


@query("rule_rls_no_policy", "SELECT 'S01' AS code, 'warning' AS severity, CAST(c_custkey AS VARCHAR) AS subject FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(t):
    m = packs.Model({"rls": t.customer.select(F.col("c_custkey").alias("table_name")), "policies": t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("table_name"))})
    return packs.rls_without_policy(m)


@query("rule_policy_no_rls", "SELECT DISTINCT 'S02' AS code, 'error' AS severity, CAST(o_custkey AS VARCHAR) AS subject FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(t):
    m = packs.Model({"rls": t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("table_name")), "policies": t.orders.select(F.col("o_custkey").alias("table_name"))})
    return packs.policy_without_rls(m)


@query("rule_exposed_no_rls", "SELECT 'S07' AS code, 'error' AS severity, CAST(s_suppkey AS VARCHAR) AS subject FROM supplier WHERE s_nationkey < 20 AND s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R') AND s_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 3000)")
def _(t):
    tables = t.supplier.select(F.col("s_suppkey").alias("table_name"), F.when(F.col("s_nationkey") < 20, "public").otherwise("private").alias("schema_name"))
    grants = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("target"), F.lit("anon").alias("grantee"))
    m = packs.Model({"tables": tables, "grants": grants, "rls": t.supplier.where("s_acctbal > 3000").select(F.col("s_suppkey").alias("table_name"))})
    return packs.exposed_without_rls(m)


@query("rule_undeclared_grantee", "SELECT ordinal, grantee FROM privs WHERE verb = 'GRANT' AND grantee NOT IN (0, 1, 2, 3)", "privs")
def _(t):
    allowed = t.spark.createDataFrame([(i,) for i in range(4)], "grantee long")
    return t.privileges().where("verb = 'GRANT'").join(F.broadcast(allowed), "grantee", "left_anti").select("ordinal", "grantee")


# --- row checks -----------------------------------------------------------------------------------------------------------


@query("check_numeric_bounds", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE NOT (l_quantity >= 5 AND l_discount < 0.09)")
def _(t):
    return checks.check_rows(t.lineitem, "l_quantity >= 5 AND l_discount < 0.09").select("l_orderkey", "l_linenumber", "l_quantity")


@query("check_in_list", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def _(t):
    return checks.check_rows(t.orders, "o_orderstatus IN ('F', 'O')").select("o_orderkey", "o_orderstatus")


@query("check_between", "SELECT p_partkey, p_size FROM part WHERE NOT (p_size BETWEEN 10 AND 40)")
def _(t):
    return checks.check_rows(t.part, "p_size BETWEEN 10 AND 40").select("p_partkey", "p_size")


@query("check_length", "SELECT p_partkey, p_name FROM part WHERE length(p_name) > 7")
def _(t):
    return checks.check_rows(t.part, "char_length(p_name) <= 7").select("p_partkey", "p_name")


@query("check_column_pair", "SELECT count(*) AS n FROM lineitem WHERE NOT coalesce(l_discount <= l_tax, TRUE)")
def _(t):
    return checks.check_rows(t.lineitem, "l_discount <= l_tax").agg(F.count("*").alias("n"))


@query("domain_check_inheritance", "SELECT 'quantity' AS check_name, count(*) FILTER (NOT (l_quantity BETWEEN 1 AND 45)) AS violations FROM lineitem UNION ALL SELECT 'rate', count(*) FILTER (NOT (l_tax < 0.08)) FROM lineitem")
def _(t):
    # Domains and the columns that have them: each column inherits its domain's check.
    domains = {"quantity_d": "VALUE BETWEEN 1 AND 45", "rate_d": "VALUE < 0.08"}
    columns = {"quantity": ("l_quantity", "quantity_d"), "rate": ("l_tax", "rate_d")}
    return checks.counted(t.lineitem, **{name: F.expr(domains[d].replace("VALUE", column)) for name, (column, d) in columns.items()})


# --- SELECT constructs ----------------------------------------------------------------------------------------------------


def sql_query(name: str, sql: str, spark_sql: str | None = None):
    """A query that is the same SQL in both engines, or nearly."""

    def run(t):
        for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "documents"):
            if table in (spark_sql or sql):
                getattr(t, table).createOrReplaceTempView(table)
        return t.spark.sql(spark_sql or sql)

    query(name, sql)(run)


sql_query("view_cte", "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT o_custkey AS k, n FROM big WHERE n > 3) SELECT c.c_custkey, t.n FROM customer c JOIN top t ON c.c_custkey = t.k")
sql_query("view_set_ops", "(SELECT n_nationkey AS k FROM nation WHERE n_regionkey < 3 UNION SELECT s_nationkey FROM supplier) EXCEPT SELECT c_nationkey FROM customer WHERE c_custkey < 30 UNION ALL (SELECT r_regionkey FROM region INTERSECT SELECT n_regionkey FROM nation)")
sql_query("view_values", "SELECT v.code, v.label, count(*) AS n FROM (VALUES ('O', 'open'), ('F', 'filled')) AS v(code, label) JOIN orders ON o_orderstatus = v.code GROUP BY v.code, v.label")
sql_query("view_using_join", "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) JOIN (SELECT r_regionkey AS k, r_name FROM region) USING (k)")
sql_query("view_natural_join", "SELECT * FROM (SELECT n_regionkey AS k, n_name FROM nation) NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region)")
sql_query("view_cross_product", "SELECT a.r_name AS left_name, b.r_name AS right_name FROM region a, region b WHERE a.r_regionkey < b.r_regionkey")
sql_query("view_lateral", "SELECT c_custkey, o.total, o.n FROM customer, LATERAL (SELECT round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders WHERE o_custkey = c_custkey) o")
sql_query("view_scalar_subquery", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS largest FROM customer")
sql_query("view_exists_any", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
sql_query("view_case_coalesce", "SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'small' END AS size_class, coalesce(nullif(o_orderstatus, 'P'), 'pending') AS status, greatest(o_custkey, 500) AS g, least(o_custkey, 500) AS l FROM orders")
sql_query("view_distinct_from", "SELECT o_orderkey, nullif(o_orderstatus, 'P') IS DISTINCT FROM 'F' AS other FROM orders WHERE o_orderpriority ILIKE '%high%' AND o_orderstatus NOT LIKE 'X%'")
sql_query("view_having_limit", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 20 ORDER BY n DESC, l_suppkey LIMIT 25")
sql_query(
    "view_window_functions",
    "SELECT o_orderkey, row_number() OVER w AS place, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2) OVER w AS after, first_value(o_orderkey) OVER w AS first, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS last, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS place, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2) OVER w AS after, first_value(o_orderkey) OVER w AS first, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS last, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
)
sql_query(
    "view_ordered_set_aggs",
    "SELECT l_returnflag, round(quantile_cont(l_quantity, 0.5), 6) AS middle, quantile_disc(l_quantity, 0.9) AS high, bool_and(l_quantity > 0) AS positive, bool_or(l_discount > 0.09) AS deep FROM lineitem GROUP BY l_returnflag",
    "SELECT l_returnflag, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity), 6) AS middle, percentile_disc(0.9) WITHIN GROUP (ORDER BY l_quantity) AS high, bool_and(l_quantity > 0) AS positive, bool_or(l_discount > 0.09) AS deep FROM lineitem GROUP BY l_returnflag",
)
sql_query(
    "view_string_functions",
    "SELECT c_custkey, lower(c_name) AS low, upper(c_mktsegment) AS up, trim('  ' || c_name || ' ') AS trimmed, replace(c_name, '#', '-') AS replaced, split_part(c_name, '#', 2) AS part, substring(c_name, 2, 4) AS sub, length(c_name) AS n, left(c_name, 3) AS l, right(c_name, 3) AS r, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS padded, strpos(c_name, '#') AS pos, concat_ws('/', c_mktsegment, c_name) AS joined, md5(c_name) AS digest, reverse(c_name) AS back, regexp_replace(c_name, '[0-9]+', 'N', 'g') AS masked FROM customer",
    "SELECT c_custkey, lower(c_name) AS low, upper(c_mktsegment) AS up, trim('  ' || c_name || ' ') AS trimmed, replace(c_name, '#', '-') AS replaced, split_part(c_name, '#', 2) AS part, substring(c_name, 2, 4) AS sub, CAST(length(c_name) AS BIGINT) AS n, left(c_name, 3) AS l, right(c_name, 3) AS r, lpad(CAST(c_custkey AS STRING), 6, '0') AS padded, CAST(instr(c_name, '#') AS BIGINT) AS pos, concat_ws('/', c_mktsegment, c_name) AS joined, md5(c_name) AS digest, reverse(c_name) AS back, regexp_replace(c_name, '[0-9]+', 'N') AS masked FROM customer",
)
sql_query(
    "view_json_functions",
    "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0 AS even, json_extract_string(props, '$.none') AS none FROM events",
    "SELECT event_id, get_json_object(props, '$.k') AS k, CAST(variant_get(parse_json(props), '$.k', 'bigint') % 2 = 0 AS BOOLEAN) AS even, get_json_object(props, '$.none') AS none FROM events",
)
sql_query(
    "view_array_functions",
    "SELECT vec_id, len(embedding) AS n, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(CAST(list_max(embedding) AS DOUBLE), 6) AS top, round(CAST(embedding[len(embedding)] AS DOUBLE), 6) AS last FROM embeddings",
    "SELECT vec_id, CAST(size(embedding) AS BIGINT) AS n, round(CAST(element_at(embedding, 1) AS DOUBLE), 6) AS first, round(CAST(array_max(embedding) AS DOUBLE), 6) AS top, round(CAST(element_at(embedding, -1) AS DOUBLE), 6) AS last FROM embeddings",
)
sql_query(
    "view_generate_series",
    "SELECT r_regionkey, g AS step FROM region, LATERAL (SELECT unnest(generate_series(1, CAST(r_regionkey AS BIGINT) + 1)) AS g)",
    "SELECT r_regionkey, g AS step FROM region LATERAL VIEW explode(sequence(1L, CAST(r_regionkey AS BIGINT) + 1L)) s AS g",
)


# --- scalar functions -----------------------------------------------------------------------------------------------------


@query("sha256_stable_hash", "SELECT p_partkey, sha256(p_brand || '|' || p_type) AS digest FROM part")
def _(t):
    return t.part.select("p_partkey", F.sha2(F.concat_ws("|", "p_brand", "p_type"), 256).alias("digest"))


@query("slug", "SELECT p_partkey, regexp_replace(substring(regexp_replace(regexp_replace(lower(p_brand || ' ' || p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 60), '_+$', '', 'g') AS slug FROM part")
def _(t):
    return t.part.select("p_partkey", X.slug(F.concat_ws(" ", "p_brand", "p_type")).alias("slug"))


@query("version_prefix", "SELECT o_orderkey, nullif(regexp_extract(name, '^([0-9]{8,})', 1), '') AS version FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y%m%d') || '_' || o_orderkey ELSE o_orderkey || '_x.sql' END AS name FROM orders)")
def _(t):
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat_ws("_", F.date_format("o_orderdate", "yyyyMMdd"), F.col("o_orderkey").cast("string"))).otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit("_x.sql")))
    return t.orders.select("o_orderkey", X.version_prefix(name).alias("version"))


@query("whitespace_collapse", "SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'))) AS digest FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(X.collapse(F.col("text"))).alias("digest"))


@query("timestamp_format", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d%H%M%S') AS stamp, strftime(o_orderdate + INTERVAL 1 SECOND, '%Y%m%d%H%M%S') AS next FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyyMMddHHmmss").alias("stamp"), F.date_format(F.col("o_orderdate") + F.expr("interval 1 second"), "yyyyMMddHHmmss").alias("next"))


@query("tablesample")
def _(t):
    t.lineitem.createOrReplaceTempView("lineitem")
    return t.spark.sql("SELECT count(*) AS n FROM (SELECT * FROM lineitem) TABLESAMPLE (10 PERCENT) REPEATABLE (7)")


@query("secret_redaction", "SELECT page_id, regexp_replace(regexp_replace(url, '(?i)(postgres(?:ql)?://[^:/\\s]+:)[^@\\s]+@', '\\1***@', 'g'), '(?i)((?:password|passwd|pwd|secret|token|api[_-]?key)\\s*[=:]\\s*)[^\\s&;,''\"]+', '\\1***', 'g') AS url FROM (SELECT page_id, url || '?token=abc' || page_id || '&x=1' AS url FROM pages)")
def _(t):
    url = F.concat(F.col("url"), F.lit("?token=abc"), F.col("page_id").cast("string"), F.lit("&x=1"))
    return t.pages.select("page_id", X.redact(url).alias("url"))


@query("quoted_names", "SELECT p_partkey, CASE WHEN regexp_full_match(p_name, '[a-z_][a-z0-9_$]*') THEN p_name ELSE '\"' || replace(p_name, '\"', '\"\"') || '\"' END AS name FROM part")
def _(t):
    return t.part.select("p_partkey", X.quote_name(F.col("p_name")).alias("name"))


@query(
    "canonical_types",
    """SELECT p_partkey, CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN 'integer' WHEN 1 THEN 'character varying(' || p_size || ')' WHEN 2 THEN 'numeric(' || p_size || ',2)'
    WHEN 3 THEN 'bigint[]' WHEN 4 THEN 'my_type_' || p_size ELSE 'boolean' END AS canonical FROM part""",
)
def _(t):
    size = F.col("p_size").cast("string")
    names = [F.lit("int4"), F.concat(F.lit("varchar("), size, F.lit(")")), F.concat(F.lit("DECIMAL("), size, F.lit(",2)")), F.lit("int8[]"), F.concat(F.lit("my_type_"), size), F.lit("Bool")]
    name = F.array(*names)[(F.col("p_partkey") % 6).cast("int")]
    return t.part.select("p_partkey", X.canonical_type(name).alias("canonical"))
