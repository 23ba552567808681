"""Model-shaped views over ordinary tables: snapshots, privilege logs, findings, dependencies, histories.

Each view is a plain projection.  ``VIEWS_SQL`` states the same projections in SQL, as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """The tables of one directory, by attribute."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def snapshots(self) -> tuple[DataFrame, DataFrame]:
        """Two states of ``orders``: (key, hash, ordinal, status, grp)."""
        base = self.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
        moved = F.when(F.col("o_orderkey") % 7 == 0, F.lit("X")).otherwise(F.col("o_orderstatus"))

        def snapshot(rows: DataFrame, status) -> DataFrame:
            return rows.select(
                F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("key"),
                F.sha2(F.concat(status, F.lit("|"), F.col("o_orderpriority")), 256).alias("hash"),
                F.col("o_orderkey").alias("ordinal"),
                status.alias("status"),
                F.col("o_orderpriority").alias("grp"),
            )

        return snapshot(base.where("o_orderkey % 10 <> 0"), F.col("o_orderstatus")), snapshot(base.where("o_orderkey % 10 <> 1"), moved)

    def objects(self) -> DataFrame:
        """(key, kind, schema_name, name, ordinal) from parts, suppliers and customers."""
        part = self.part.select(
            F.concat_ws("", "p_type", F.lit(":"), "p_brand", F.lit("."), F.col("p_partkey").cast("string")).alias("key"), F.col("p_type").alias("kind"), F.col("p_brand").alias("schema_name"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ordinal")
        )
        supplier = self.supplier.select(
            F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("key"), F.lit("supplier").alias("kind"), F.lit(None).cast("string").alias("schema_name"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("ordinal")
        )
        customer = self.customer.select(
            F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("key"), F.lit("customer").alias("kind"), F.col("c_mktsegment").alias("schema_name"), F.col("c_name").alias("name"), F.col("c_custkey").alias("ordinal")
        )
        return part.unionByName(supplier).unionByName(customer)

    def findings(self) -> DataFrame:
        """(code, severity, message, file, seq) from events."""
        severity = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "warning").otherwise("info")
        return self.events.select(
            F.concat("event_type", F.lit("_"), (F.col("user_id") % 10).cast("string")).alias("code"), severity.alias("severity"), F.concat(F.lit("  "), "event_type", F.lit("   on \n"), "props").alias("message"), F.col("user_id").alias("file"), F.col("event_id").alias("seq")
        )

    def privileges(self) -> DataFrame:
        """(ordinal, verb, privilege, target, grantee) from events: an ordered log of grants and revokes."""
        verb = F.when(F.col("event_id") % 3 == 0, "REVOKE").otherwise("GRANT")
        return self.events.select(F.col("event_id").alias("ordinal"), verb.alias("verb"), F.col("event_type").alias("privilege"), (F.col("user_id") % 20).alias("target"), (F.col("user_id") % 7).alias("grantee"))

    def targets(self) -> DataFrame:
        return self.orders.select(F.col("o_orderkey").alias("ordinal"), (F.col("o_custkey") % 20).alias("target"))

    def dependencies(self) -> DataFrame:
        """(from_key, to_key): who depends on whom, from foreign keys."""
        name = lambda kind, column: F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))
        edges = [
            self.nation.select(name("nation", "n_nationkey").alias("from_key"), name("region", "n_regionkey").alias("to_key")),
            self.customer.select(name("customer", "c_custkey").alias("from_key"), name("nation", "c_nationkey").alias("to_key")),
            self.supplier.select(name("supplier", "s_suppkey").alias("from_key"), name("nation", "s_nationkey").alias("to_key")),
            self.orders.select(name("order", "o_orderkey").alias("from_key"), name("customer", "o_custkey").alias("to_key")),
        ]
        out = edges[0]
        for e in edges[1:]:
            out = out.unionByName(e)
        return out

    def scored(self) -> tuple[DataFrame, DataFrame]:
        """A manifest (doc_id) and what was emitted (doc_id, destructive)."""
        return self.labels.where("quality = 1").select("doc_id"), self.documents.where("n_chars > 500").select("doc_id", (F.col("doc_id") % 50 == 0).alias("destructive"))

    def histories(self) -> tuple[DataFrame, DataFrame]:
        """Versions on disk and versions applied: (version), zero-padded."""
        version = F.lpad(F.col("o_orderkey").cast("string"), 14, "0").alias("version")
        orders = self.orders.select("o_orderkey")
        bound = orders.agg((F.max("o_orderkey") * 0.8).alias("bound"))
        disk = orders.where("o_orderkey % 3 <> 0").select(version)
        applied = orders.join(F.broadcast(bound)).where("o_orderkey % 4 <> 0 AND o_orderkey < bound").select(version)
        return disk, applied

    def statements(self) -> DataFrame:
        """(file, idx, tag) from conversations."""
        return self.conversations.select(F.col("conv_id").alias("file"), F.col("turn").alias("idx"), F.col("role").alias("tag"))


VIEWS_SQL = {
    "snap_from": "SELECT 'order:' || o_orderkey AS key, sha256(o_orderstatus || '|' || o_orderpriority) AS hash, o_orderkey AS ordinal, o_orderstatus AS status, o_orderpriority AS grp FROM orders WHERE o_orderkey % 10 <> 0",
    "snap_to": "SELECT 'order:' || o_orderkey AS key, sha256((CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END) || '|' || o_orderpriority) AS hash, o_orderkey AS ordinal, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS status, o_orderpriority AS grp FROM orders WHERE o_orderkey % 10 <> 1",
    "objects": "SELECT p_type || ':' || p_brand || '.' || p_partkey AS key, p_type AS kind, p_brand AS schema_name, p_name AS name, p_partkey AS ordinal FROM part UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', NULL, s_name, s_suppkey FROM supplier UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_mktsegment, c_name, c_custkey FROM customer",
    "findings": "SELECT event_type || '_' || (user_id % 10) AS code, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' ELSE 'info' END AS severity, '  ' || event_type || '   on ' || chr(10) || props AS message, user_id AS file, event_id AS seq FROM events",
    "privs": "SELECT event_id AS ordinal, CASE WHEN event_id % 3 = 0 THEN 'REVOKE' ELSE 'GRANT' END AS verb, event_type AS privilege, user_id % 20 AS target, user_id % 7 AS grantee FROM events",
    "targets": "SELECT o_orderkey AS ordinal, o_custkey % 20 AS target FROM orders",
    "deps": "SELECT 'nation:' || n_nationkey AS from_key, 'region:' || n_regionkey AS to_key FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey FROM orders",
    "manifest": "SELECT doc_id FROM labels WHERE quality = 1",
    "emitted": "SELECT doc_id, doc_id % 50 = 0 AS destructive FROM documents WHERE n_chars > 500",
    "disk": "SELECT lpad(CAST(o_orderkey AS VARCHAR), 14, '0') AS version FROM orders WHERE o_orderkey % 3 <> 0",
    "applied": "SELECT lpad(CAST(o_orderkey AS VARCHAR), 14, '0') AS version FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey < (SELECT max(o_orderkey) * 0.8 FROM orders)",
    "stmts": "SELECT conv_id AS file, turn AS idx, role AS tag FROM conversations",
}


def with_views(sql: str, *names: str) -> str:
    """``sql`` behind the named views."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({VIEWS_SQL[n]})" for n in names) + " " + sql
