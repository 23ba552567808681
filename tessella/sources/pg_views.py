"""System catalogs as tables.

``Catalog`` hands out frames shaped like the PostgreSQL system catalogs that the operators read.  ``fixture`` makes them
from ordinary tables by plain projections, which ``FIXTURE_SQL`` states for either engine; access lists are text, entries
of ``grantee=letters/grantor`` with commas between them, and ``ints(...)`` stands for an array of numbers.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FIXTURE_SQL = {
    "pg_roles": "SELECT r_regionkey AS oid, 'role_' || lower(replace(r_name, ' ', '_')) AS rolname FROM region",
    "pg_namespace": """SELECT n_nationkey AS oid, CASE WHEN n_nationkey % 8 = 3 THEN 'pg_' ELSE 's_' END || lower(replace(n_name, ' ', '_')) AS nspname,
        n_regionkey AS nspowner, CASE WHEN n_nationkey % 3 > 0 THEN 'role_asia=U/owner,=UC*/owner' END AS nspacl FROM nation""",
    "pg_extension": "SELECT r_regionkey AS oid, 'ext_' || lower(r_name) AS extname, r_regionkey AS extnamespace, '1.' || r_regionkey AS extversion FROM region",
    "pg_class": """SELECT p_partkey AS oid, 'r' || p_partkey AS relname, CAST(p_partkey % 25 AS INT) AS relnamespace, substr('rrpvmSifr', p_size % 9 + 1, 1) AS relkind,
        CAST(p_partkey % 5 AS INT) AS relowner, p_size % 4 = 1 AS relrowsecurity, p_size % 12 = 5 AS relforcerowsecurity, p_size % 9 = 1 AS relispartition,
        CASE WHEN p_size % 5 = 0 THEN 'fillfactor=70,security_invoker=true' END AS reloptions,
        CASE CAST(p_partkey % 4 AS INT) WHEN 1 THEN 'role_asia=arw*/owner,=r/owner' WHEN 2 THEN 'role_europe=rd/owner' WHEN 3 THEN 'owner=arwd/owner,role_africa=r/owner' END AS relacl FROM part""",
    "pg_inherits": "SELECT p_partkey AS inhrelid, p_partkey - p_partkey % 10 + 1 AS inhparent FROM part",
    "pg_type": """SELECT s_suppkey AS oid, 't' || s_suppkey AS typname, s_nationkey AS typnamespace, substr('bedc', CAST(s_suppkey % 4 AS INT) + 1, 1) AS typtype,
        s_suppkey - s_suppkey % 4 AS typbasetype, s_acctbal < 2000 AS typnotnull, s_suppkey * 3 AS typrelid,
        CASE WHEN s_suppkey % 2 = 0 THEN '=U/owner,role_asia=U*/owner' END AS typacl FROM supplier""",
    "pg_attribute": """SELECT l_partkey AS attrelid, l_linenumber AS attnum, 'c' || l_linenumber AS attname, min(l_suppkey) AS atttypid, max(l_quantity) > 40 AS attnotnull,
        max(l_returnflag) = 'A' AS attisdropped, CASE WHEN min(l_discount) < 0.02 THEN 'role_europe=rw/owner' END AS attacl FROM lineitem GROUP BY 1, 2""",
    "pg_attrdef": "SELECT l_partkey AS adrelid, l_linenumber AS adnum, 'value ' || l_linenumber AS adsrc FROM lineitem GROUP BY 1, 2 HAVING min(l_tax) < 0.01",
    "pg_constraint": """SELECT oid, conname, conrelid, contype, confrelid, ints(k) AS conkey, CASE WHEN contype = 'f' THEN ints(k) END AS confkey, conindid, contypid, convalidated FROM (
        SELECT o_orderkey AS oid, 'k' || o_orderkey AS conname, o_custkey AS conrelid, substr('pufcx', CAST(substr(o_orderpriority, 1, 1) AS INT), 1) AS contype,
        CASE WHEN substr(o_orderpriority, 1, 1) = '3' THEN o_custkey * 7 % 100 END AS confrelid, CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN '1' WHEN 1 THEN '2,1' ELSE '3,1,2' END AS k,
        CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN o_custkey * 5 ELSE 0 END AS conindid,
        CASE WHEN substr(o_orderpriority, 1, 1) = '4' THEN o_custkey % 40 ELSE 0 END AS contypid, o_orderstatus <> 'P' AS convalidated FROM orders)""",
    "pg_index": "SELECT c_custkey AS indexrelid, c_custkey * 3 % 150 AS indrelid, c_acctbal > 5000 AS indisunique, 'CREATE INDEX r' || c_custkey AS indexdef FROM customer",
    "pg_depend": """SELECT DISTINCT CAST(user_id % 4 AS INT) AS classid, event_id AS objid, CASE event_type WHEN 'error' THEN 'e' WHEN 'view' THEN 'a' ELSE 'n' END AS deptype,
        user_id AS refobjid, CAST(event_id % 7 AS INT) + 1 AS refobjsubid FROM events""",
    "pg_proc": """SELECT c_custkey AS oid, 'f' || (c_custkey % 200) AS proname, c_nationkey AS pronamespace, CASE substr(c_mktsegment, 1, 1) WHEN 'B' THEN 'f' WHEN 'A' THEN 'p' WHEN 'M' THEN 'a' ELSE 'f' END AS prokind,
        'integer, t' || (c_custkey % 3) AS proargs, c_acctbal < 0 AS prosecdef, CASE WHEN c_custkey % 3 > 0 THEN CASE WHEN c_custkey % 2 = 0 THEN '=X/owner,role_asia=X/owner' ELSE 'role_asia=X*/owner' END END AS proacl FROM customer""",
    "pg_trigger": "SELECT o_orderkey AS oid, 'g' || o_orderkey AS tgname, o_custkey AS tgrelid, o_custkey * 3 % 150 AS tgfoid, o_orderstatus = 'F' AS tgisinternal FROM orders",
    "pg_policy": """SELECT c_custkey AS oid, 'p' || c_custkey AS polname, c_custkey * 2 AS polrelid, substr('rawd*', CAST(c_custkey % 5 AS INT) + 1, 1) AS polcmd, CAST(c_custkey % 6 AS INT) AS polrole,
        CASE WHEN c_custkey % 5 <> 1 THEN 'owner = ' || c_nationkey END AS polqual, c_acctbal > 0 AS polpermissive FROM customer""",
    "pg_enum": "SELECT p_partkey AS oid, p_size AS enumtypid, p_retailprice + p_partkey AS enumsortorder, p_name || ' ' || p_partkey AS enumlabel FROM part",
    "pg_sequence": "SELECT p_partkey AS seqrelid, p_size AS seqtypid, p_partkey * 10 AS seqstart, p_size AS seqincrement FROM part",
    "pg_description": """SELECT event_id AS objoid, CAST(user_id % 4 AS INT) AS classoid, CASE WHEN user_id % 3 = 0 THEN CAST(event_id % 7 AS INT) + 1 ELSE 0 END AS objsubid, event_type || ' note' AS description FROM events""",
    "pg_init_privs": "SELECT s_suppkey AS objoid, 0 AS classoid, '=r/owner' AS initprivs FROM supplier",
    "pg_foreign_data_wrapper": "SELECT r_regionkey AS oid, 'w_' || lower(r_name) AS fdwname FROM region",
    "pg_foreign_server": "SELECT n_nationkey AS oid, 'srv_' || n_nationkey AS srvname, n_regionkey AS srvfdw FROM nation",
    "pg_foreign_table": "SELECT p_partkey AS ftrelid, p_partkey % 25 AS ftserver, 'table_name=x' || p_partkey AS ftoptions FROM part",
    "pg_default_acl": """SELECT c_custkey AS oid, c_nationkey % 5 AS defaclrole, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_nationkey END AS defaclnamespace, substr('rSfTn', CAST(c_custkey % 5 AS INT) + 1, 1) AS defaclobjtype,
        CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN 'role_asia=X/owner' WHEN 1 THEN '=XU/owner,role_europe=rU*/owner' ELSE 'role_africa=r/owner' END AS defaclacl FROM customer""",
}

INTS = re.compile(r"ints\((\w+)\)")


class Catalog:
    """The system catalogs, by attribute."""

    def __init__(self, read: Callable[[str], DataFrame]):
        self._read, self._known = read, {}

    def __getattr__(self, name: str) -> DataFrame:
        if not name.startswith("pg_"):
            raise AttributeError(name)
        if name not in self._known:
            self._known[name] = self._read(name)
        return self._known[name]


def fixture(spark: SparkSession, path: str) -> Catalog:
    """The catalogs of FIXTURE_SQL over the tables in ``path``."""
    tables = "region nation customer supplier part orders lineitem events".split()

    def read(name: str) -> DataFrame:
        sql = INTS.sub(r"CAST(split(\1, ',') AS ARRAY<INT>)", FIXTURE_SQL[name])
        used = [t for t in tables if re.search(rf"FROM {t}\b", sql)]
        for t in used:
            sql = re.sub(rf"FROM {t}\b", "FROM {" + t + "}", sql)
        return spark.sql(sql, **{t: spark.read.parquet(f"{path}/{t}.parquet") for t in used})

    return Catalog(read)


def duck_views(sql: str) -> str:
    """``sql`` behind those catalogs that it names."""
    used: list[str] = [n for n in FIXTURE_SQL if re.search(rf"\b{n}\b", sql)]
    arrays = lambda text: INTS.sub(lambda m: f"CAST(string_split({m[1]}, ',') AS INTEGER[])", text)
    return "WITH " + ", ".join(f"{n} AS ({arrays(FIXTURE_SQL[n])})" for n in used) + " " + sql


def database(spark: SparkSession, url: str, **options: str) -> Catalog:
    """The catalogs of a live database over JDBC; the driver must be on the class path."""
    read = lambda query: spark.read.format("jdbc").options(url=url, query=query, **options).load()
    return Catalog(lambda name: read(LIVE_SQL.get(name, f"SELECT * FROM pg_catalog.{name}")))


def _listed(column: str) -> str:
    return f"array_to_string({column}, ',')"


# What a live database must be asked for, where it differs from the plain table: text of access lists, options and definitions.
LIVE_SQL = {
    "pg_namespace": f"SELECT oid, nspname, nspowner, {_listed('nspacl')} AS nspacl FROM pg_catalog.pg_namespace",
    "pg_class": f"SELECT oid, relname, relnamespace, relkind, relowner, relrowsecurity, relforcerowsecurity, relispartition, {_listed('reloptions')} AS reloptions, {_listed('relacl')} AS relacl FROM pg_catalog.pg_class",
    "pg_type": f"SELECT oid, typname, typnamespace, typtype, typbasetype, typnotnull, typrelid, {_listed('typacl')} AS typacl FROM pg_catalog.pg_type",
    "pg_attribute": f"SELECT attrelid, attnum, attname, atttypid, attnotnull, attisdropped, {_listed('attacl')} AS attacl FROM pg_catalog.pg_attribute",
    "pg_attrdef": "SELECT adrelid, adnum, pg_get_expr(adbin, adrelid) AS adsrc FROM pg_catalog.pg_attrdef",
    "pg_index": "SELECT indexrelid, indrelid, indisunique, pg_get_indexdef(indexrelid) AS indexdef FROM pg_catalog.pg_index",
    "pg_proc": f"SELECT oid, proname, pronamespace, prokind, pg_get_function_identity_arguments(oid) AS proargs, prosecdef, {_listed('proacl')} AS proacl FROM pg_catalog.pg_proc",
    "pg_policy": "SELECT p.oid, polname, polrelid, polcmd, r AS polrole, pg_get_expr(polqual, polrelid) AS polqual, polpermissive FROM pg_catalog.pg_policy p, unnest(polroles) r",
    "pg_init_privs": f"SELECT objoid, CASE classoid WHEN 'pg_class'::regclass THEN 0 ELSE 9 END AS classoid, {_listed('initprivs')} AS initprivs FROM pg_catalog.pg_init_privs",
    "pg_depend": "SELECT CASE classid WHEN 'pg_class'::regclass THEN 0 WHEN 'pg_proc'::regclass THEN 1 WHEN 'pg_type'::regclass THEN 2 WHEN 'pg_foreign_data_wrapper'::regclass THEN 3 ELSE 9 END AS classid, objid, deptype, refobjid, refobjsubid FROM pg_catalog.pg_depend",
    "pg_description": "SELECT objoid, CASE classoid WHEN 'pg_class'::regclass THEN 0 WHEN 'pg_proc'::regclass THEN 1 WHEN 'pg_type'::regclass THEN 2 WHEN 'pg_namespace'::regclass THEN 3 ELSE 9 END AS classoid, objsubid, description FROM pg_catalog.pg_description",
    "pg_foreign_table": f"SELECT ftrelid, ftserver, {_listed('ftoptions')} AS ftoptions FROM pg_catalog.pg_foreign_table",
    "pg_default_acl": f"SELECT oid, defaclrole, defaclnamespace, defaclobjtype, {_listed('defaclacl')} AS defaclacl FROM pg_catalog.pg_default_acl",
}
