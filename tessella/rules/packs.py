"""Rules: functions from a model to findings (code, severity, subject), run as one union."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Model:
    """What rules read.  tables (table_name, schema_name), rls (table_name), policies (table_name, name, command, roles,
    using_expr, check_expr, columns), grants (target, grantee, privilege, kind), routines (name, definer, search_path),
    views (name, schema_name, security_invoker), operations (key, destructive, blocked)."""

    parts: dict[str, DataFrame]
    exposed_schemas: tuple[str, ...] = ("public",)
    api_roles: tuple[str, ...] = ("anon", "authenticated")
    allowed_grantees: tuple[str, ...] = ()
    required_columns: tuple[str, ...] = ()
    multi_privilege_kinds: tuple[str, ...] = field(default=("table", "schema", "sequence", "database"))

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["parts"][name]
        except KeyError:
            raise AttributeError(name) from None


Rule = Callable[[Model], DataFrame]


def finding(rows: DataFrame, code: str, severity: str, subject: str) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col(subject).cast("string").alias("subject"))


def odd_names(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(~F.col(name).rlike("^[a-z0-9_]+$"))


def naming(m: Model) -> DataFrame:
    return finding(odd_names(m.tables, "table_name"), "N01", "warning", "table_name")


def destructive(m: Model) -> DataFrame:
    return finding(m.operations.where("destructive AND NOT blocked"), "D01", "error", "key")


def rls_without_policy(m: Model) -> DataFrame:
    return finding(m.rls.join(m.policies, "table_name", "left_anti"), "S01", "warning", "table_name")


def policy_without_rls(m: Model) -> DataFrame:
    return finding(m.policies.select("table_name").distinct().join(m.rls, "table_name", "left_anti"), "S02", "error", "table_name")


def missing_predicate(m: Model) -> DataFrame:
    reads, writes = F.col("command").isin("all", "select", "update", "delete"), F.col("command").isin("all", "insert", "update")
    return finding(m.policies.where((reads & F.col("using_expr").isNull()) | (writes & F.col("check_expr").isNull() & F.col("using_expr").isNull())), "S03", "error", "name")


def required_columns(m: Model) -> DataFrame:
    if not m.required_columns:
        return finding(m.policies.limit(0), "S04", "warning", "name")
    needed = F.array(*map(F.lit, m.required_columns))
    return finding(m.policies.where(F.size(F.array_except(needed, F.coalesce("columns", F.array().cast("array<string>")))) > 0), "S04", "warning", "name")


# A session function that is no longer maintained, and one that runs per row unless a sub-select wraps it.
DEPRECATED_CALL, ROW_CALL = r"\bauth ?\. ?role ?\(", r"\bauth ?\. ?uid ?\("


def _policy_text():
    return F.lower(F.concat_ws(" ", "using_expr", "check_expr"))


def deprecated_call(m: Model) -> DataFrame:
    return finding(m.policies.where(_policy_text().rlike(DEPRECATED_CALL)), "S05", "warning", "name")


def unwrapped_call(m: Model) -> DataFrame:
    bare = F.regexp_replace(_policy_text(), r"\( ?select " + ROW_CALL[2:], "")
    return finding(m.policies.where(bare.rlike(ROW_CALL)), "S06", "warning", "name")


def exposed_without_rls(m: Model) -> DataFrame:
    granted = m.grants.where(F.col("grantee").isin(*m.api_roles)).select(F.col("target").alias("table_name"))
    open_ = m.tables.where(F.col("schema_name").isin(*m.exposed_schemas)).join(granted, "table_name", "left_semi")
    return finding(open_.join(m.rls, "table_name", "left_anti"), "S07", "error", "table_name")


def definer_search_path(m: Model) -> DataFrame:
    path = F.col("search_path")
    issue = F.when(path.isNull(), "unset").when(F.trim(path) == "", "empty").when(path.contains("$user"), "user").when(path.rlike("(^|,)\\s*pg_temp\\s*,"), "temporary first")
    return finding(m.routines.where(F.col("definer")).withColumn("_issue", issue).where("_issue IS NOT NULL").withColumn("_s", F.concat_ws(": ", "name", "_issue")), "S08", "error", "_s")


def public_grants(m: Model) -> DataFrame:
    return finding(m.grants.where("upper(grantee) = 'PUBLIC'"), "P01", "warning", "target")


def all_privileges(m: Model) -> DataFrame:
    return finding(m.grants.where((F.upper("privilege") == "ALL") & F.col("kind").isin(*m.multi_privilege_kinds)), "P02", "warning", "target")


def undeclared_grantee(m: Model) -> DataFrame:
    rows = m.grants.where(~F.col("grantee").isin(*m.allowed_grantees)) if m.allowed_grantees else m.grants.limit(0)
    return finding(rows, "P03", "error", "grantee")


def view_invoker(m: Model) -> DataFrame:
    return finding(m.views.where(F.col("schema_name").isin(*m.exposed_schemas) & ~F.coalesce("security_invoker", F.lit(False))), "V01", "warning", "name")


PACKS: dict[str, tuple[Rule, ...]] = {
    "hygiene": (naming, destructive),
    "grants": (public_grants, all_privileges, undeclared_grantee),
    "rls": (rls_without_policy, policy_without_rls, missing_predicate, required_columns, deprecated_call, unwrapped_call, exposed_without_rls, definer_search_path, view_invoker),
}
PACKS["scan"] = PACKS["grants"] + PACKS["hygiene"] + PACKS["rls"]
PACKS["deploy"] = tuple(r for r in PACKS["scan"] if r is not definer_search_path)


def run_rules(model: Model, pack: str = "scan") -> DataFrame:
    return reduce(DataFrame.unionByName, (rule(model) for rule in PACKS[pack]))


def gate(findings: DataFrame) -> DataFrame:
    """One row: blocked if any finding is an error."""
    return findings.agg(F.coalesce(F.bool_or(F.col("severity") == "error"), F.lit(False)).alias("blocked"))


def remap(findings: DataFrame, policy: str) -> DataFrame:
    """disabled: none; report_only: errors become warnings; deploy_blocking: warnings become errors."""
    if policy == "disabled":
        return findings.limit(0)
    pairs = {"report_only": ("error", "warning"), "deploy_blocking": ("warning", "error")}
    was, now = pairs[policy]
    return findings.withColumn("severity", F.when(F.col("severity") == was, now).otherwise(F.col("severity")))
