"""Objects out of system catalogs: each function takes a catalog (``sources.pg_views.Catalog``) and gives rows of one kind.

Managed are objects of schemas whose names do not begin with pg_, and that are no members of an extension.  Joins are
plain equalities on object ids, filters stand before them, and only the columns used are read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Letters of access lists, and kinds of objects by their class in pg_depend and pg_description.
PRIVILEGES = {
    "r": "SELECT", "a": "INSERT", "w": "UPDATE", "d": "DELETE", "D": "TRUNCATE", "x": "REFERENCES", "t": "TRIGGER",
    "X": "EXECUTE", "U": "USAGE", "C": "CREATE", "c": "CONNECT", "T": "TEMPORARY", "m": "MAINTAIN",
}
RELATION, ROUTINE, TYPE, NAMESPACE, WRAPPER = 0, 1, 2, 3, 3
PUBLIC, OWNER = "PUBLIC", "owner"


def namespaces(c) -> DataFrame:
    return c.pg_namespace.where("nspname NOT LIKE 'pg\\_%' AND nspname <> 'information_schema'")


def not_members(rows: DataFrame, c, kind: int, oid: str = "oid") -> DataFrame:
    """Without the members of extensions."""
    members = c.pg_depend.where(f"classid = {kind} AND deptype = 'e'").select(F.col("objid").alias(oid))
    return rows.join(members, oid, "left_anti")


def in_schema(rows: DataFrame, c, column: str) -> DataFrame:
    """Rows of managed schemas, with the schema's name."""
    return rows.join(namespaces(c).select(F.col("oid").alias(column), "nspname"), column)


def relations(c, kinds: str) -> DataFrame:
    """Managed relations of some kinds (letters)."""
    return in_schema(not_members(c.pg_class.where(F.col("relkind").isin(*kinds)), c, RELATION), c, "relnamespace")


def ordered(value: Column, *order: Column) -> Column:
    """Aggregate: values in order, as text with commas between them."""
    listed = F.array_sort(F.collect_list(F.struct(*order, value.alias("_value"))))
    return F.array_join(F.transform(listed, lambda s: s["_value"]), ",")


def schemas(c) -> DataFrame:
    return namespaces(c).join(c.pg_roles.select(F.col("oid").alias("nspowner"), "rolname"), "nspowner").select("nspname", "rolname")


def extensions(c) -> DataFrame:
    return c.pg_extension.join(c.pg_namespace.select(F.col("oid").alias("extnamespace"), "nspname"), "extnamespace").select("extname", "nspname", "extversion")


def routines(c) -> DataFrame:
    rows = not_members(c.pg_proc.where("prokind IN ('f', 'p', 'w')"), c, ROUTINE)
    return in_schema(rows, c, "pronamespace").select("nspname", "proname", "proargs", "prokind", "prosecdef")


def views(c) -> DataFrame:
    invoker = F.array_contains(F.split(F.coalesce("reloptions", F.lit("")), ","), "security_invoker=true")
    return relations(c, "vm").select("nspname", "relname", "relkind", invoker.alias("invoker"))


def indexes(c) -> DataFrame:
    """Indexes that no constraint stands on."""
    own = relations(c, "i").select(F.col("oid").alias("indexrelid"), "nspname", "relname")
    tables = c.pg_class.where("relkind IN ('r', 'p', 'm')").select(F.col("oid").alias("indrelid"), F.col("relname").alias("table_name"))
    backing = c.pg_constraint.select(F.col("conindid").alias("indexrelid"))
    rows = c.pg_index.join(own, "indexrelid").join(tables, "indrelid").join(backing, "indexrelid", "left_anti")
    return rows.select("nspname", "relname", "table_name", "indisunique", "indexdef")


def triggers(c) -> DataFrame:
    on = relations(c, "rpvf").select(F.col("oid").alias("tgrelid"), "nspname", "relname")
    calls = c.pg_proc.select(F.col("oid").alias("tgfoid"), "proname")
    return c.pg_trigger.where("NOT tgisinternal").join(on, "tgrelid").join(calls, "tgfoid").select("nspname", "relname", "tgname", "proname")


def rls(c) -> DataFrame:
    return relations(c, "rp").where("relrowsecurity OR relforcerowsecurity").select("nspname", "relname", "relrowsecurity", "relforcerowsecurity")


def policies(c) -> DataFrame:
    """With their roles as a sorted list; a role that does not exist is PUBLIC."""
    on = relations(c, "rp").select(F.col("oid").alias("polrelid"), "nspname", "relname")
    roles = c.pg_roles.select(F.col("oid").alias("polrole"), "rolname")
    named = c.pg_policy.join(on, "polrelid").join(roles, "polrole", "left").withColumn("rolname", F.coalesce("rolname", F.lit(PUBLIC)))
    return named.groupBy("nspname", "relname", "polname", "polcmd", "polqual", "polpermissive").agg(F.array_join(F.array_sort(F.collect_set("rolname")), ",").alias("roles"))


def tables(c) -> DataFrame:
    """With the parent of a partition."""
    parents = c.pg_class.select(F.col("oid").alias("inhparent"), F.col("relname").alias("parent"), F.col("relnamespace").alias("_in"))
    parents = parents.join(c.pg_namespace.select(F.col("oid").alias("_in"), F.col("nspname").alias("parent_schema")), "_in", "left").drop("_in")
    own = relations(c, "rp")
    part = own.where("relispartition").select("oid").join(c.pg_inherits.withColumnRenamed("inhrelid", "oid"), "oid").join(parents, "inhparent", "left").select("oid", "parent_schema", "parent")
    return own.join(part, "oid", "left").select("oid", "nspname", "relname", "relispartition", "parent_schema", "parent")


def columns(c) -> DataFrame:
    """Columns of managed tables, with defaults and types."""
    of = relations(c, "rp").select(F.col("oid").alias("attrelid"))
    defaults = c.pg_attrdef.select(F.col("adrelid").alias("attrelid"), F.col("adnum").alias("attnum"), "adsrc")
    types = c.pg_type.select(F.col("oid").alias("atttypid"), "typname")
    rows = c.pg_attribute.where("attnum > 0 AND NOT attisdropped").join(of, "attrelid", "left_semi")
    return rows.join(defaults, ["attrelid", "attnum"], "left").join(types, "atttypid", "left").select("attrelid", "attnum", "attname", "typname", "attnotnull", "adsrc")


def _key_names(c, rows: DataFrame, relation: str, numbers: str, name: str) -> DataFrame:
    """(oid, name): the columns that an array of numbers means, in the array's order."""
    spread = rows.select("oid", F.col(relation).alias("attrelid"), F.posexplode(numbers).alias("_place", "attnum"))
    named = spread.join(c.pg_attribute.select("attrelid", "attnum", "attname"), ["attrelid", "attnum"])
    return named.groupBy("oid").agg(ordered(F.col("attname"), F.col("_place")).alias(name))


def constraints(c) -> DataFrame:
    on = relations(c, "rp").select(F.col("oid").alias("conrelid"), "nspname", "relname")
    to = c.pg_class.select(F.col("oid").alias("confrelid"), F.col("relname").alias("ref_table"))
    rows = c.pg_constraint.where("contype IN ('p', 'u', 'f', 'c', 'x')").join(on, "conrelid").join(to, "confrelid", "left")
    rows = rows.join(_key_names(c, rows, "conrelid", "conkey", "columns"), "oid", "left")
    rows = rows.join(_key_names(c, rows.where("confkey IS NOT NULL"), "confrelid", "confkey", "ref_columns"), "oid", "left")
    return rows.select("nspname", "relname", "conname", "contype", "columns", "ref_table", "ref_columns", "convalidated")


def table_children(c) -> DataFrame:
    """Each table with its columns in one list."""
    lists = columns(c).groupBy("attrelid").agg(F.count("*").alias("n_columns"), ordered(F.col("attname"), F.col("attnum")).alias("column_list"))
    return tables(c).join(lists.withColumnRenamed("attrelid", "oid"), "oid", "left").select("nspname", "relname", F.coalesce("n_columns", F.lit(0)).alias("n_columns"), F.coalesce("column_list", F.lit("")).alias("column_list"))


def types(c, kind: str) -> DataFrame:
    return in_schema(not_members(c.pg_type.where(F.col("typtype") == kind), c, TYPE), c, "typnamespace")


def enums(c) -> DataFrame:
    labels = c.pg_enum.groupBy(F.col("enumtypid").alias("oid")).agg(ordered(F.col("enumlabel"), F.col("enumsortorder")).alias("labels"))
    return types(c, "e").join(labels, "oid").select("nspname", "typname", "labels")


def domains(c) -> DataFrame:
    checks = c.pg_constraint.where("contypid <> 0").groupBy(F.col("contypid").alias("oid")).agg(ordered(F.col("conname"), F.col("conname")).alias("checks"))
    base = c.pg_type.select(F.col("oid").alias("typbasetype"), F.col("typname").alias("base"))
    return types(c, "d").join(base, "typbasetype", "left").join(checks, "oid", "left").select("nspname", "typname", "base", "typnotnull", F.coalesce("checks", F.lit("")).alias("checks"))


def composites(c) -> DataFrame:
    """Attributes in order, and the distinct domains and enums among their types."""
    of = c.pg_type.select(F.col("oid").alias("atttypid"), F.col("typname").alias("of_type"), F.col("typtype").alias("of_kind"))
    rows = c.pg_attribute.where("attnum > 0 AND NOT attisdropped").join(of, "atttypid").withColumnRenamed("attrelid", "typrelid")
    own = F.array_join(F.array_sort(F.collect_set(F.when(F.col("of_kind").isin("d", "e"), F.col("of_type")))), ",")
    lists = rows.groupBy("typrelid").agg(ordered(F.concat_ws(" ", "attname", "of_type"), F.col("attnum")).alias("attributes"), own.alias("uses"))
    return types(c, "c").join(lists, "typrelid").select("nspname", "typname", "attributes", "uses")


def sequences(c) -> DataFrame:
    """With their type and the column that owns them, if any."""
    own = relations(c, "S").select(F.col("oid").alias("seqrelid"), "nspname", "relname")
    owner = c.pg_depend.where(f"classid = {RELATION} AND deptype = 'a'").select(F.col("objid").alias("seqrelid"), "refobjid", "refobjsubid")
    of = c.pg_class.where("relkind IN ('r', 'p')").select(F.col("oid").alias("refobjid"), F.col("relname").alias("owner_table"))
    column = c.pg_attribute.select(F.col("attrelid").alias("refobjid"), F.col("attnum").alias("refobjsubid"), F.col("attname").alias("owner_column"))
    typed = c.pg_type.select(F.col("oid").alias("seqtypid"), "typname")
    rows = c.pg_sequence.join(own, "seqrelid").join(typed, "seqtypid", "left").join(owner, "seqrelid", "left").join(of, "refobjid", "left").join(column, ["refobjid", "refobjsubid"], "left")
    return rows.select("nspname", "relname", "typname", "seqstart", "seqincrement", "owner_table", "owner_column")


def wrappers(c) -> DataFrame:
    return not_members(c.pg_foreign_data_wrapper, c, WRAPPER).select("fdwname")


def servers(c) -> DataFrame:
    return c.pg_foreign_server.join(c.pg_foreign_data_wrapper.select(F.col("oid").alias("srvfdw"), "fdwname"), "srvfdw").select("srvname", "fdwname")


def foreign_tables(c) -> DataFrame:
    own = relations(c, "f").select(F.col("oid").alias("ftrelid"), "nspname", "relname")
    server = c.pg_foreign_server.select(F.col("oid").alias("ftserver"), "srvname")
    lists = c.pg_attribute.where("attnum > 0 AND NOT attisdropped").groupBy(F.col("attrelid").alias("ftrelid")).agg(ordered(F.col("attname"), F.col("attnum")).alias("column_list"))
    return c.pg_foreign_table.join(own, "ftrelid").join(server, "ftserver").join(lists, "ftrelid", "left").select("nspname", "relname", "srvname", "ftoptions", F.coalesce("column_list", F.lit("")).alias("column_list"))


# --- privileges --------------------------------------------------------------------------------------------------------------


def exploded(rows: DataFrame, acl: str) -> DataFrame:
    """A row per grantee and privilege of an access list; rows without a list have none."""
    names = F.create_map(*(F.lit(x) for kv in PRIVILEGES.items() for x in kv))
    entry = rows.withColumn("_entry", F.explode(F.split(acl, ",")))
    grantee = F.split_part("_entry", F.lit("="), F.lit(1))
    given = F.split_part(F.split_part("_entry", F.lit("="), F.lit(2)), F.lit("/"), F.lit(1))
    letters = entry.select("*", F.when(grantee == "", PUBLIC).otherwise(grantee).alias("grantee"), F.split_part("_entry", F.lit("/"), F.lit(2)).alias("grantor"), F.explode(F.regexp_extract_all(given, F.lit("([a-zA-Z][*]?)"))).alias("_letter"))
    return letters.select("*", names[F.substring("_letter", 1, 1)].alias("privilege"), F.col("_letter").endswith("*").alias("grantable")).drop("_entry", "_letter")


def _sorted(column: str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(column)), ",")


def relation_grants(c) -> DataFrame:
    """Without what a relation came with (pg_init_privs) and what its owner has."""
    given = exploded(relations(c, "rpvmSf"), "relacl").where(F.col("grantee") != OWNER)
    initial = exploded(c.pg_init_privs.where(f"classoid = {RELATION}").withColumnRenamed("objoid", "oid"), "initprivs")
    keys = ["oid", "grantee", "grantor", "privilege", "grantable"]
    left = given.join(initial.select(*keys), keys, "left_anti")
    return left.groupBy("nspname", "relname", "grantee", "grantable").agg(_sorted("privilege").alias("privileges"))


def column_grants(c) -> DataFrame:
    """Columns of one relation with the same privilege stand together."""
    on = relations(c, "rpvmf").select(F.col("oid").alias("attrelid"), "nspname", "relname")
    given = exploded(c.pg_attribute.where("attnum > 0 AND NOT attisdropped").join(on, "attrelid"), "attacl").where(F.col("grantee") != OWNER)
    return given.groupBy("nspname", "relname", "grantee", "privilege", "grantable").agg(ordered(F.col("attname"), F.col("attnum")).alias("column_list"))


def other_grants(c) -> DataFrame:
    """(kind, identity, grantee, grantable, privileges) of schemas, routines and types."""
    schema = namespaces(c).select(F.lit("schema").alias("kind"), F.col("nspname").alias("identity"), F.col("nspacl").alias("acl"))
    routine = in_schema(not_members(c.pg_proc.where("prokind IN ('f', 'p', 'w')"), c, ROUTINE), c, "pronamespace")
    routine = routine.select(F.lit("routine").alias("kind"), F.concat("nspname", F.lit("."), "proname", F.lit("("), "proargs", F.lit(")")).alias("identity"), F.col("proacl").alias("acl"))
    of_type = in_schema(not_members(c.pg_type.where("typtype IN ('d', 'e', 'c')"), c, TYPE), c, "typnamespace")
    of_type = of_type.select(F.lit("type").alias("kind"), F.concat_ws(".", "nspname", "typname").alias("identity"), F.col("typacl").alias("acl"))
    given = exploded(schema.unionByName(routine).unionByName(of_type), "acl").where(F.col("grantee") != OWNER)
    return given.groupBy("kind", "identity", "grantee", "grantable").agg(_sorted("privilege").alias("privileges"))


def revoked_public(c) -> DataFrame:
    """Routines whose access list leaves PUBLIC out; without a list PUBLIC may call them."""
    listed = in_schema(not_members(c.pg_proc.where("prokind IN ('f', 'p', 'w') AND proacl IS NOT NULL"), c, ROUTINE), c, "pronamespace")
    open_ = exploded(listed.select("oid", "proacl"), "proacl").where((F.col("grantee") == PUBLIC) & (F.col("privilege") == "EXECUTE")).select("oid")
    return listed.join(open_, "oid", "left_anti").select("nspname", "proname", "proargs")


def _default_lists(c) -> DataFrame:
    roles = c.pg_roles.select(F.col("oid").alias("defaclrole"), "rolname")
    spaces = c.pg_namespace.select(F.col("oid").alias("defaclnamespace"), "nspname")
    # A namespace of 0 means all schemas.
    nowhere = F.when(F.col("_all"), None).otherwise(F.col("nspname"))
    rows = c.pg_default_acl.withColumn("_all", F.col("defaclnamespace") == 0).join(roles, "defaclrole").join(spaces, "defaclnamespace", "left")
    return rows.withColumn("nspname", nowhere).drop("_all")


def default_privileges(c) -> DataFrame:
    given = exploded(_default_lists(c), "defaclacl").where(F.col("grantee") != OWNER)
    return given.groupBy("rolname", "nspname", "defaclobjtype", "grantee", "grantable").agg(_sorted("privilege").alias("privileges"))


def revoked_defaults(c) -> DataFrame:
    """Lists for routines and types in all schemas that leave out what PUBLIC has by default."""
    rows = _default_lists(c).where("nspname IS NULL AND defaclobjtype IN ('f', 'T')")
    public = exploded(rows.select("oid", "defaclacl"), "defaclacl").where(F.col("grantee") == PUBLIC).select("oid")
    return rows.join(public, "oid", "left_anti").select("rolname", "defaclobjtype").distinct()


def comments(c) -> DataFrame:
    """(kind, identity, description) of relations, their columns, routines, types and schemas."""
    notes = c.pg_description.select(F.col("objoid").alias("oid"), "classoid", "objsubid", "description")
    whole = notes.where("objsubid = 0")
    on = relations(c, "rpvmSf").select("oid", F.concat_ws(".", "nspname", "relname").alias("identity"))
    attributes = c.pg_attribute.select(F.col("attrelid").alias("oid"), F.col("attnum").alias("objsubid"), "attname")
    of = {
        "relation": whole.where(f"classoid = {RELATION}").join(on, "oid"),
        "column": notes.where(f"classoid = {RELATION} AND objsubid > 0").join(on, "oid").join(attributes, ["oid", "objsubid"]).withColumn("identity", F.concat_ws(".", "identity", "attname")),
        "routine": whole.where(f"classoid = {ROUTINE}").join(in_schema(c.pg_proc, c, "pronamespace").select("oid", F.concat("nspname", F.lit("."), "proname", F.lit("("), "proargs", F.lit(")")).alias("identity")), "oid"),
        "type": whole.where(f"classoid = {TYPE}").join(in_schema(c.pg_type, c, "typnamespace").select("oid", F.concat_ws(".", "nspname", "typname").alias("identity")), "oid"),
        "schema": whole.where(f"classoid = {NAMESPACE}").join(namespaces(c).select("oid", F.col("nspname").alias("identity")), "oid"),
    }
    return reduce(DataFrame.unionByName, (rows.select(F.lit(kind).alias("kind"), "identity", "description") for kind, rows in of.items()))


# The sections of a state, in order.
SECTIONS: dict[str, tuple[Callable, str]] = {
    "schema": (schemas, "nspname"),
    "extension": (extensions, "extname"),
    "enum": (enums, "concat_ws('.', nspname, typname)"),
    "type": (composites, "concat_ws('.', nspname, typname)"),
    "domain": (domains, "concat_ws('.', nspname, typname)"),
    "sequence": (sequences, "concat_ws('.', nspname, relname)"),
    "foreign-data-wrapper": (wrappers, "fdwname"),
    "foreign-server": (servers, "srvname"),
    "table": (table_children, "concat_ws('.', nspname, relname)"),
    "foreign-table": (foreign_tables, "concat_ws('.', nspname, relname)"),
    "constraint": (constraints, "concat_ws('.', nspname, relname, conname)"),
    "index": (indexes, "concat_ws('.', nspname, relname)"),
    "routine": (routines, "concat(nspname, '.', proname, '(', proargs, ')')"),
    "view": (views, "concat_ws('.', nspname, relname)"),
    "trigger": (triggers, "concat_ws('.', nspname, relname, tgname)"),
    "rls": (rls, "concat_ws('.', nspname, relname)"),
    "policy": (policies, "concat_ws('.', nspname, relname, polname)"),
    "grant": (relation_grants, "concat_ws('.', nspname, relname, grantee, CASE WHEN grantable THEN 'grantable' ELSE '' END)"),
    "comment": (comments, "concat_ws('.', kind, identity)"),
}


def objects(c) -> DataFrame:
    """All sections as (kind, identity, hash): the hash is of the row's other columns as JSON, in the order of their names."""
    parts = []
    for kind, (build, identity) in SECTIONS.items():
        rows = build(c)
        body = F.to_json(F.struct(*(F.col(n) for n in sorted(rows.columns) if n != "oid")))
        parts.append(rows.select(F.lit(kind).alias("kind"), F.expr(identity).alias("identity"), F.sha2(body, 256).alias("hash"), body.alias("detail")))
    return reduce(DataFrame.unionByName, parts)


def state(c, history: str = "database") -> DataFrame:
    """The objects in the shape of every source, so that a live state can be planned, audited and compared."""
    found = objects(c)
    rows = numbered(found).join(found, ["kind", "identity"])
    split = F.split("identity", "\\.", 2)
    schema = F.when(F.size(split) > 1, split[0])
    needs = F.when(schema.isNull(), F.array().cast("array<string>")).otherwise(F.array(schema))
    text = {"history": F.lit(history), "key": F.concat_ws(":", "kind", "identity"), "kind": F.col("kind"), "schema_name": schema, "name": F.element_at(split, -1), "table_name": F.lit(None).cast("string")}
    rest = {"hash": F.col("hash"), "ordinal": F.col("ordinal"), "file": F.lit(None).cast("string"), "detail": F.col("detail"), "sql": F.lit(None).cast("string"), "dependencies": needs}
    return rows.select(*(value.alias(name) for name, value in (text | rest).items()))


def numbered(rows: DataFrame) -> DataFrame:
    """(kind, identity, ordinal): sections one after the other, ordinals from 0 throughout.

    Each section is numbered alone; the sections' sizes, a row each, are added up.
    """
    place = F.create_map(*(F.lit(x) for kv in ((k, i) for i, k in enumerate(SECTIONS)) for x in kv))
    sizes = rows.groupBy("kind").agg(F.count("*").alias("_n")).withColumn("_place", place[F.col("kind")])
    before = F.sum("_n").over(Window.orderBy("_place").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("kind", F.coalesce(before, F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("kind").orderBy("identity"))
    return rows.withColumn("_at", within).join(starts, "kind").select("kind", "identity", (F.col("_start") + F.col("_at") - 1).cast("long").alias("ordinal"))
