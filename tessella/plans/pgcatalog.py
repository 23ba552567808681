"""Named queries over system catalogs, with their SQL."""

from __future__ import annotations

from ..operators import pgcatalog as P
from ..sources.pg_views import duck_views, fixture
from .catalogue import ORACLE_SQL, QUERIES

# Managed schemas; objects that are members of an extension.
NS = "(SELECT oid, nspname FROM pg_namespace WHERE left(nspname, 3) <> 'pg_' AND nspname <> 'information_schema')"


def _free(kind: int, oid: str) -> str:
    return f"NOT EXISTS (SELECT 1 FROM pg_depend x WHERE x.classid = {kind} AND x.deptype = 'e' AND x.objid = {oid})"


def _relations(kinds: str) -> str:
    listed = ", ".join(f"'{k}'" for k in kinds)
    return f"(SELECT c.*, n.nspname FROM pg_class c JOIN {NS} n ON n.oid = c.relnamespace WHERE c.relkind IN ({listed}) AND {_free(0, 'c.oid')})"


def _types(kind: str) -> str:
    return f"(SELECT t.*, n.nspname FROM pg_type t JOIN {NS} n ON n.oid = t.typnamespace WHERE t.typtype = '{kind}' AND {_free(2, 't.oid')})"


def _procs() -> str:
    return f"(SELECT p.*, n.nspname FROM pg_proc p JOIN {NS} n ON n.oid = p.pronamespace WHERE p.prokind IN ('f', 'p', 'w') AND {_free(1, 'p.oid')})"


def _acl(rows: str, acl: str) -> str:
    names = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.PRIVILEGES.items())
    return f"""(SELECT *, CASE WHEN split_part(e, '=', 1) = '' THEN 'PUBLIC' ELSE split_part(e, '=', 1) END AS grantee, split_part(e, '/', 2) AS grantor,
        CASE left(l, 1) {names} END AS privilege, ends_with(l, '*') AS grantable FROM (
        SELECT *, unnest(regexp_extract_all(split_part(split_part(e, '=', 2), '/', 1), '[a-zA-Z][*]?')) AS l FROM (SELECT *, unnest(string_split({acl}, ',')) AS e FROM {rows} r0) r1) r2)"""


ROUTINE = "p.nspname || '.' || p.proname || '(' || p.proargs || ')'"
LIVE = "attnum > 0 AND NOT attisdropped"
DEFAULTS = """(SELECT a.*, r.rolname, CASE WHEN a.defaclnamespace <> 0 THEN n.nspname END AS nspname FROM pg_default_acl a JOIN pg_roles r ON r.oid = a.defaclrole LEFT JOIN pg_namespace n ON n.oid = a.defaclnamespace)"""
COLUMNS = f"""SELECT a.attrelid, a.attnum, a.attname, t.typname, a.attnotnull, d.adsrc FROM pg_attribute a LEFT JOIN pg_attrdef d ON d.adrelid = a.attrelid AND d.adnum = a.attnum
    LEFT JOIN pg_type t ON t.oid = a.atttypid WHERE {LIVE} AND a.attrelid IN (SELECT oid FROM {_relations("rp")})"""

SQL = {
    "schemas": f"SELECT n.nspname, r.rolname FROM pg_namespace n JOIN pg_roles r ON r.oid = n.nspowner WHERE n.oid IN (SELECT oid FROM {NS})",
    "extensions": "SELECT e.extname, n.nspname, e.extversion FROM pg_extension e JOIN pg_namespace n ON n.oid = e.extnamespace",
    "routines": f"SELECT nspname, proname, proargs, prokind, prosecdef FROM {_procs()}",
    "views": f"SELECT nspname, relname, relkind, coalesce(list_contains(string_split(reloptions, ','), 'security_invoker=true'), FALSE) AS invoker FROM {_relations('vm')}",
    "indexes": f"""SELECT i.nspname, i.relname, t.relname AS table_name, x.indisunique, x.indexdef FROM pg_index x JOIN {_relations("i")} i ON i.oid = x.indexrelid
        JOIN pg_class t ON t.oid = x.indrelid AND t.relkind IN ('r', 'p', 'm') WHERE NOT EXISTS (SELECT 1 FROM pg_constraint k WHERE k.conindid = x.indexrelid)""",
    "triggers": f"SELECT c.nspname, c.relname, g.tgname, p.proname FROM pg_trigger g JOIN {_relations('rpvf')} c ON c.oid = g.tgrelid JOIN pg_proc p ON p.oid = g.tgfoid WHERE NOT g.tgisinternal",
    "rls": f"SELECT nspname, relname, relrowsecurity, relforcerowsecurity FROM {_relations('rp')} WHERE relrowsecurity OR relforcerowsecurity",
    "policies": f"""SELECT c.nspname, c.relname, p.polname, p.polcmd, p.polqual, p.polpermissive, string_agg(DISTINCT coalesce(r.rolname, 'PUBLIC'), ',' ORDER BY coalesce(r.rolname, 'PUBLIC')) AS roles
        FROM pg_policy p JOIN {_relations("rp")} c ON c.oid = p.polrelid LEFT JOIN pg_roles r ON r.oid = p.polrole GROUP BY ALL""",
    "tables": f"""SELECT c.oid, c.nspname, c.relname, c.relispartition, pn.nspname AS parent_schema, pc.relname AS parent FROM {_relations("rp")} c
        LEFT JOIN pg_inherits h ON h.inhrelid = c.oid AND c.relispartition LEFT JOIN pg_class pc ON pc.oid = h.inhparent LEFT JOIN pg_namespace pn ON pn.oid = pc.relnamespace""",
    "columns": COLUMNS,
    "constraints": f"""SELECT c.nspname, c.relname, k.conname, k.contype, (SELECT string_agg(a.attname, ',' ORDER BY u.i) FROM (SELECT unnest(k.conkey) AS num, generate_subscripts(k.conkey, 1) AS i) u
        JOIN pg_attribute a ON a.attrelid = k.conrelid AND a.attnum = u.num) AS columns, f.relname AS ref_table, (SELECT string_agg(a.attname, ',' ORDER BY u.i)
        FROM (SELECT unnest(k.confkey) AS num, generate_subscripts(k.confkey, 1) AS i) u JOIN pg_attribute a ON a.attrelid = k.confrelid AND a.attnum = u.num) AS ref_columns, k.convalidated
        FROM pg_constraint k JOIN {_relations("rp")} c ON c.oid = k.conrelid LEFT JOIN pg_class f ON f.oid = k.confrelid WHERE k.contype IN ('p', 'u', 'f', 'c', 'x')""",
    "table_children": f"""SELECT c.nspname, c.relname, count(a.attname) AS n_columns, coalesce(string_agg(a.attname, ',' ORDER BY a.attnum), '') AS column_list
        FROM {_relations("rp")} c LEFT JOIN ({COLUMNS}) a ON a.attrelid = c.oid GROUP BY c.oid, c.nspname, c.relname""",
    "enums": f"SELECT t.nspname, t.typname, string_agg(e.enumlabel, ',' ORDER BY e.enumsortorder) AS labels FROM {_types('e')} t JOIN pg_enum e ON e.enumtypid = t.oid GROUP BY t.oid, t.nspname, t.typname",
    "domains": f"""SELECT t.nspname, t.typname, b.typname AS base, t.typnotnull, coalesce((SELECT string_agg(k.conname, ',' ORDER BY k.conname) FROM pg_constraint k WHERE k.contypid = t.oid AND k.contypid <> 0), '') AS checks
        FROM {_types("d")} t LEFT JOIN pg_type b ON b.oid = t.typbasetype""",
    "composites": f"""SELECT t.nspname, t.typname, string_agg(a.attname || ' ' || y.typname, ',' ORDER BY a.attnum) AS attributes,
        coalesce(string_agg(DISTINCT y.typname, ',' ORDER BY y.typname) FILTER (y.typtype IN ('d', 'e')), '') AS uses
        FROM {_types("c")} t JOIN pg_attribute a ON a.attrelid = t.typrelid AND {LIVE} JOIN pg_type y ON y.oid = a.atttypid GROUP BY t.oid, t.nspname, t.typname""",
    "sequences": f"""SELECT c.nspname, c.relname, t.typname, s.seqstart, s.seqincrement, oc.relname AS owner_table, a.attname AS owner_column FROM pg_sequence s JOIN {_relations("S")} c ON c.oid = s.seqrelid
        LEFT JOIN pg_type t ON t.oid = s.seqtypid LEFT JOIN pg_depend d ON d.classid = 0 AND d.objid = s.seqrelid AND d.deptype = 'a' LEFT JOIN pg_class oc ON oc.oid = d.refobjid AND oc.relkind IN ('r', 'p')
        LEFT JOIN pg_attribute a ON a.attrelid = d.refobjid AND a.attnum = d.refobjsubid""",
    "wrappers": f"SELECT w.fdwname FROM pg_foreign_data_wrapper w WHERE {_free(3, 'w.oid')}",
    "servers": "SELECT s.srvname, w.fdwname FROM pg_foreign_server s JOIN pg_foreign_data_wrapper w ON w.oid = s.srvfdw",
    "foreign_tables": f"""SELECT c.nspname, c.relname, s.srvname, f.ftoptions, coalesce((SELECT string_agg(a.attname, ',' ORDER BY a.attnum) FROM pg_attribute a WHERE a.attrelid = c.oid AND {LIVE}), '') AS column_list
        FROM pg_foreign_table f JOIN {_relations("f")} c ON c.oid = f.ftrelid JOIN pg_foreign_server s ON s.oid = f.ftserver""",
    "relation_grants": f"""SELECT g.nspname, g.relname, g.grantee, g.grantable, string_agg(DISTINCT g.privilege, ',' ORDER BY g.privilege) AS privileges FROM {_acl(_relations("rpvmSf"), "relacl")} g
        WHERE g.grantee <> 'owner' AND NOT EXISTS (SELECT 1 FROM {_acl("(SELECT * FROM pg_init_privs WHERE classoid = 0)", "initprivs")} i
        WHERE i.objoid = g.oid AND i.grantee = g.grantee AND i.grantor = g.grantor AND i.privilege = g.privilege AND i.grantable = g.grantable) GROUP BY 1, 2, 3, 4""",
    "column_grants": f"""SELECT g.nspname, g.relname, g.grantee, g.privilege, g.grantable, string_agg(g.attname, ',' ORDER BY g.attnum) AS column_list
        FROM {_acl(f"(SELECT a.*, c.nspname, c.relname FROM pg_attribute a JOIN {_relations('rpvmf')} c ON c.oid = a.attrelid WHERE {LIVE})", "attacl")} g WHERE g.grantee <> 'owner' GROUP BY 1, 2, 3, 4, 5""",
    "other_grants": f"""SELECT g.kind, g.identity, g.grantee, g.grantable, string_agg(DISTINCT g.privilege, ',' ORDER BY g.privilege) AS privileges FROM {_acl(f'''(SELECT 'schema' AS kind, nspname AS identity, nspacl AS acl
        FROM pg_namespace WHERE oid IN (SELECT oid FROM {NS}) UNION ALL SELECT 'routine', {ROUTINE}, p.proacl FROM {_procs()} p
        UNION ALL SELECT 'type', t.nspname || '.' || t.typname, t.typacl FROM (SELECT * FROM {_types("d")} UNION ALL SELECT * FROM {_types("e")} UNION ALL SELECT * FROM {_types("c")}) t)''', "acl")} g WHERE g.grantee <> 'owner' GROUP BY 1, 2, 3, 4""",
    "revoked_public": f"""SELECT p.nspname, p.proname, p.proargs FROM {_procs()} p WHERE p.proacl IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM {_acl("pg_proc", "proacl")} a WHERE a.oid = p.oid AND a.grantee = 'PUBLIC' AND a.privilege = 'EXECUTE')""",
    "default_privileges": f"SELECT rolname, nspname, defaclobjtype, grantee, grantable, string_agg(DISTINCT privilege, ',' ORDER BY privilege) AS privileges FROM {_acl(DEFAULTS, 'defaclacl')} WHERE grantee <> 'owner' GROUP BY 1, 2, 3, 4, 5",
    "revoked_defaults": f"""SELECT DISTINCT d.rolname, d.defaclobjtype FROM {DEFAULTS} d WHERE d.nspname IS NULL AND d.defaclobjtype IN ('f', 'T')
        AND NOT EXISTS (SELECT 1 FROM {_acl("pg_default_acl", "defaclacl")} a WHERE a.oid = d.oid AND a.grantee = 'PUBLIC')""",
    "comments": f"""SELECT 'relation' AS kind, c.nspname || '.' || c.relname AS identity, d.description FROM pg_description d JOIN {_relations("rpvmSf")} c ON c.oid = d.objoid WHERE d.classoid = 0 AND d.objsubid = 0
        UNION ALL SELECT 'column', c.nspname || '.' || c.relname || '.' || a.attname, d.description FROM pg_description d JOIN {_relations("rpvmSf")} c ON c.oid = d.objoid
        JOIN pg_attribute a ON a.attrelid = d.objoid AND a.attnum = d.objsubid WHERE d.classoid = 0 AND d.objsubid > 0
        UNION ALL SELECT 'routine', {ROUTINE}, d.description FROM pg_description d JOIN (SELECT q.*, n.nspname FROM pg_proc q JOIN {NS} n ON n.oid = q.pronamespace) p ON p.oid = d.objoid WHERE d.classoid = 1 AND d.objsubid = 0
        UNION ALL SELECT 'type', n.nspname || '.' || t.typname, d.description FROM pg_description d JOIN pg_type t ON t.oid = d.objoid JOIN {NS} n ON n.oid = t.typnamespace WHERE d.classoid = 2 AND d.objsubid = 0
        UNION ALL SELECT 'schema', n.nspname, d.description FROM pg_description d JOIN {NS} n ON n.oid = d.objoid WHERE d.classoid = 3 AND d.objsubid = 0""",
    "extension_members": f"SELECT c.oid, c.relname FROM pg_class c WHERE {_free(0, 'c.oid')}",
}
# Identities of the sections, as the objects name them.
IDENTITY = {kind: (build.__name__, identity) for kind, (build, identity) in P.SECTIONS.items()}
SECTION_SQL = " UNION ALL ".join(f"SELECT {i} AS place, '{kind}' AS kind, {identity} AS identity FROM ({SQL[name]}) s{i}" for i, (kind, (name, identity)) in enumerate(IDENTITY.items()))
SQL["sections"] = f"SELECT kind, identity, row_number() OVER (ORDER BY place, identity) - 1 AS ordinal FROM ({SECTION_SQL})"


def _register(name: str, build) -> None:
    QUERIES[f"catalog_{name}"] = lambda spark, sf_dir: build(fixture(spark, sf_dir))
    ORACLE_SQL[f"catalog_{name}"] = duck_views(SQL[name])


for _name in SQL:
    if _name == "sections":
        _register(_name, lambda c: P.numbered(P.objects(c)))
    elif _name == "extension_members":
        _register(_name, lambda c: P.not_members(c.pg_class.select("oid", "relname"), c, P.RELATION))
    else:
        _register(_name, getattr(P, _name))
