"""Kernels against plain Python, and invariants."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import asof, checks, diff, fold, graph, rollup, sequence
from tessella.rules import packs


def log(seed, n=400):
    rng = random.Random(seed)
    return [(i, rng.choice(["GRANT", "REVOKE"]), rng.choice("abcd"), rng.randint(0, 4)) for i in range(n)]


LOG = "ordinal long, verb string, privilege string, target long"


@pytest.mark.parametrize("seed", [1, 2])
def test_the_last_event_is_the_fold(spark, seed):
    rows = log(seed)
    held = defaultdict(set)
    for _, verb, p, t in rows:
        (held[t].add if verb == "GRANT" else held[t].discard)(p)
    df = spark.createDataFrame(rows, LOG)
    net = defaultdict(set)
    for r in fold.net_state(df, ["target", "privilege"]).collect():
        net[r.target].add(r.privilege)
    assert {k: v for k, v in held.items() if v} == net
    assert {r.target: set(r.members) for r in fold.net_fold(df, ["target"], "privilege").collect()} == held


@pytest.mark.parametrize("width", [1, 7, 100_000])
def test_asof_does_not_depend_on_ranges(spark, width):
    rows = log(3)
    rng = random.Random(9)
    probes = [(rng.randint(-5, 450), rng.randint(0, 6), rng.choice("abcd"), i) for i in range(200)]
    expected = {}
    for at, target, p, i in probes:
        last = [v for o, v, q, t in rows if t == target and q == p and o <= at]
        expected[i] = last[-1] if last else None
    df = spark.createDataFrame(probes, "ordinal long, target long, privilege string, id long")
    got = asof.asof_last(df, spark.createDataFrame(rows, LOG), ["target", "privilege"], "verb", width=width)
    assert {r.id: r.verb for r in got.collect()} == expected


def test_diff_invariants(spark):
    rng = random.Random(4)
    rows = lambda: spark.createDataFrame([(f"k{i}", rng.choice(["x", "y", None])) for i in range(60) if rng.random() < 0.8], "key string, hash string")
    a, b = rows(), rows()
    there, back = ({r.key: r.op for r in diff.snapshot_diff(*p).collect()} for p in ((a, b), (b, a)))
    assert back == {k: {"create": "drop", "drop": "create"}.get(v, v) for k, v in there.items()}
    assert diff.snapshot_diff(a, a).count() == 0


def test_last_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, None)], "key string, ordinal long, hash string")
    assert sorted(map(tuple, diff.last_wins(df).collect())) == [("a", 3, "z"), ("b", 1, None)]


def test_topological_order_is_valid_and_stable(spark):
    rng = random.Random(5)
    keys = [f"n{i:02}" for i in range(40)]
    nodes = [("p", k, rng.randint(0, 3), i) for i, k in enumerate(keys)]
    edges = [("p", keys[i], keys[j]) for i in range(40) for j in range(i + 1, 40) if rng.random() < 0.08]
    got = graph.topological_order(spark.createDataFrame(nodes, "plan_id string, key string, rank long, ordinal long"), spark.createDataFrame(edges, "plan_id string, src string, dst string")).collect()
    at = {r.key: r.seq for r in got}
    assert sorted(at.values()) == list(range(40)) and all(at[a] < at[b] for _, a, b in edges)
    cyclic = [("p", "n00", "n01"), ("p", "n01", "n00")]
    got = graph.topological_order(spark.createDataFrame(nodes, "plan_id string, key string, rank long, ordinal long"), spark.createDataFrame(cyclic, "plan_id string, src string, dst string")).collect()
    assert {r.key for r in got if r.cyclic} == {"n00", "n01"} and max(r.seq for r in got if not r.cyclic) == 37


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "c"), ("z", "y")], "from_key string, to_key string")
    got = {r.key: r.depth for r in graph.dependents(edges, spark.createDataFrame([("a",)], "key string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_scores(spark):
    manifest = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    emitted = spark.createDataFrame([("a", False), ("b", True), ("d", False)], "key string, destructive boolean")
    r = rollup.precision_recall(manifest, emitted, "key", "destructive").first()
    assert (r.matched, r.missed, r.excess, r.precision, r.recall) == (1, 1, 2, round(1 / 3, 9), 0.5)
    none = rollup.precision_recall(manifest.limit(0), emitted.limit(0), "key", "destructive").first()
    assert (none.precision, none.recall, none.f1) == (1.0, 1.0, 1.0)


def test_bag_fingerprint_ignores_order_but_not_content(spark):
    rows = [(f"k{i}", f"h{i}") for i in range(50)]
    one = lambda r, n: rollup.bag_fingerprint(spark.createDataFrame(r, "key string, hash string").repartition(n)).first()[0]
    assert one(rows, 1) == one(rows[::-1], 5) != one([*rows[:-1], ("k49", "x")], 2)


@pytest.mark.parametrize(
    "expression,sound,left",
    [
        ("a >= 1 AND b IN ('x', 'y''z')", "(a >= 1) AND (b IN ('x', 'y''z'))", []),
        ("(a BETWEEN 1 AND 2) AND char_length(b) < 5", "(a BETWEEN 1 AND 2) AND (char_length(b) < 5)", []),
        ("a > 1 OR b > 2", None, ["a > 1 OR b > 2"]),
        ("active AND lower(a) = 'x' AND -1 < a", "(active) AND (-1 < a)", ["lower(a) = 'x'"]),
        ("note <> 'this and that' and a = b", "(a = b)", ["note <> 'this and that'"]),
    ],
)
def test_check_lowering(expression, sound, left):
    assert checks.lower_check(expression) == (sound, left)


def test_checks_pass_on_null(spark):
    df = spark.createDataFrame([(1, None), (None, 2), (5, 3)], "a int, b int")
    assert checks.check_rows(df, "a <= b").collect() == [(5, 3)]


def test_sequence(spark):
    rows = spark.createDataFrame([("20260101000000",), ("20260301000000",), ("bad",)], "version string")
    assert sequence.next_version(rows, "version", "2026-02-01 00:00:00").first()[0] == "20260301000001"
    assert sequence.next_version(rows, "version", "2027-01-01 00:00:00").first()[0] == "20270101000000"


def test_rules(spark):
    one = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    m = packs.Model(
        {
            "tables": one([("t", "public"), ("Bad-name", "public")], "table_name string, schema_name string"),
            "rls": one([("r",)], "table_name string"),
            "policies": one([("t", "p", "select", ["a"], None, None, ["x"])], "table_name string, name string, command string, roles array<string>, using_expr string, check_expr string, columns array<string>"),
            "grants": one([("t", "anon", "SELECT", "table"), ("t", "PUBLIC", "ALL", "table"), ("f", "anon", "ALL", "function")], "target string, grantee string, privilege string, kind string"),
            "routines": one([("f", True, None), ("g", True, "app, pg_temp"), ("h", False, None), ("i", True, "$user")], "name string, definer boolean, search_path string"),
            "views": one([("v", "public", None), ("w", "public", True)], "name string, schema_name string, security_invoker boolean"),
            "operations": one([("k", True, False), ("l", True, True)], "key string, destructive boolean, blocked boolean"),
        },
        allowed_grantees=("anon",),
        required_columns=("tenant",),
    )
    found = sorted((r.code, r.subject) for r in packs.run_rules(m).collect())
    assert found == [("D01", "k"), ("N01", "Bad-name"), ("P01", "t"), ("P02", "t"), ("P03", "PUBLIC"), ("S01", "r"), ("S02", "t"), ("S03", "p"), ("S04", "p"), ("S07", "t"), ("S08", "f: unset"), ("S08", "i: user"), ("V01", "v")]
    assert packs.gate(packs.run_rules(m)).first().blocked
    assert not packs.gate(packs.remap(packs.run_rules(m), "report_only")).first().blocked


def test_text(spark):
    df = spark.createDataFrame([(" A\t b\n\n", "postgres://me:secret@host/db?password=x&y=1", "a  \r\nb\n\n\n\nc ; ")], "a string, b string, c string")
    got = df.select(X.collapse(F.col("a")), X.redact(F.col("b")), X.normal_sql(F.col("c")), X.slug(F.lit("__Add  Col-1!")), X.stable_json(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2)))).first()
    assert tuple(got) == ("A b", "postgres://me:***@host/db?password=***&y=1", "a\nb\n\nc", "add_col_1", '{"a":2,"b":1}')


def test_decisions(spark):
    from tessella.operators import decisions as d

    one = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    labels = "key string, labels array<string>"
    got = d.enum_changes(one([("a", ["x"]), ("b", ["x", "y"]), ("c", ["x"]), ("d", [])], labels), one([("a", ["x", "z", "w"]), ("b", ["y", "x"]), ("c", ["x"]), ("d", ["q"])], labels))
    assert sorted(map(tuple, got.collect())) == [("a", "append", "z,w"), ("b", "replace", None), ("d", "append", "q")]
    views = "key string, columns array<struct<name string, type string>>"
    got = d.view_replacements(one([("a", [("x", "int")]), ("b", [("x", "int")])], views), one([("a", [("x", "int"), ("y", "int")]), ("b", [("x", "text")])], views))
    assert sorted(map(tuple, got.collect())) == [("a", "replace"), ("b", "drop_and_create")]
    got = d.routine_replacements(one([("f", "int"), ("g", None)], "key string, returns string"), one([("f", "text"), ("g", None)], "key string, returns string"))
    assert sorted(map(tuple, got.collect())) == [("f", "drop_and_create"), ("g", "replace")]
    ops = one([("a", True), ("b", True), ("c", True), ("e", False)], "key string, destructive boolean")
    intents, hints = one([("a",)], "key string"), one([("a",), ("b",)], "key string")
    state = lambda hints, policy="hint": {r.key: r.disposition for r in d.dispositions(ops, intents, hints, policy).collect()}
    assert state(hints) == {"a": "intent", "b": "hint", "c": "blocked", "e": "safe"}
    assert state(one([("*",)], "key string"))["c"] == "hint"
    assert state(hints, "block")["b"] == "blocked" and state(hints, "allow")["c"] == "allowed"
    objects = "key string, kind string, schema_name string"
    before, after = one([("t1", "table", "a"), ("t2", "table", "a")], objects), one([("u1", "view", "a"), ("u2", "table", "b"), ("u3", "table", "a")], objects)
    hints = one([("t1", "u1"), ("t1", "u2"), ("t2", "u3"), ("t9", "u3"), ("t1", "u9")], "from_key string, to_key string")
    got = {(r.from_key, r.to_key): r.problem for r in d.rename_findings(hints, before, after).collect()}
    assert got == {("t1", "u1"): "another kind", ("t1", "u2"): "another schema", ("t9", "u3"): "no source", ("t1", "u9"): "no target"}
    fp = lambda x: one([(x,)], "fingerprint string")
    assert d.drift(ops.limit(0), fp("a"), fp("b")).first().drift and not d.drift(ops, fp("a"), fp("b")).first().drift


def test_policy_calls(spark):
    rows = [("a", "auth . uid ( ) = owner", None), ("b", "( select auth . uid ( ) ) = owner", None), ("c", None, "auth.role() = 'x'"), ("d", "true", "( select auth.uid() ) = o and auth.uid() = p")]
    m = packs.Model({"policies": spark.createDataFrame(rows, "name string, using_expr string, check_expr string")})
    assert [r.subject for r in packs.deprecated_call(m).collect()] == ["c"]
    assert sorted(r.subject for r in packs.unwrapped_call(m).collect()) == ["a", "d"]


@pytest.mark.parametrize("width", [3, 50, 100_000])
def test_coverage_is_the_fold_at_every_point(spark, width):
    rows = log(8, 200)
    probes = [(i - 3, t) for i, t in enumerate([0, 1, 2, 3, 4, 9] * 35)]
    expected = {}
    for at, target in probes:
        held = set()
        for o, verb, p, t in rows:
            if o <= at and t == target:
                (held.add if verb == "GRANT" else held.discard)(p)
        expected[at, target] = held >= {"a", "b"}
    elements = spark.createDataFrame([("a",), ("b",)], "privilege string")
    got = asof.covered(spark.createDataFrame(probes, "ordinal long, target long"), spark.createDataFrame(rows, LOG), elements, width=width)
    assert {(r.ordinal, r.target): r.implied for r in got.collect()} == expected and any(expected.values())


def test_intake(spark):
    deep = "{" + '"a":{' * 70 + "}" * 70 + "}"
    docs = ['{"name": "x", "list": [[1]]}', "[1]", "nonsense", '{"list": 1}', '{"name": "x", "password": "hunter2"}', '{"name": "password=hunter2"}', deep.replace("{", '{"name":1,', 1), '{"name": "{[{["}']
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string")
    got = [r.p for r in df.orderBy("i").select(X.intake_problem(F.col("d"), ("name",)).alias("p")).collect()]
    assert got == [None, "no object", "no object", "no name", None, "secret", "too deep", None]
    assert df.where("i in (0, 7)").orderBy("i").select(X.json_depth(F.col("d"))).collect() == [(3,), (1,)]


def test_chains_are_followed_to_their_end(spark):
    links = [(f"t{i}", f"t{i + 1}") for i in range(70)] + [(f"c{i}", f"c{(i + 1) % 66}") for i in range(66)] + [("self", "self"), ("into", "c0")]
    got = {r.start: (r.target, r.length, r.cyclic) for r in graph.chains(spark, spark.createDataFrame(links, "name string, base string").coalesce(1)).collect()}
    assert got["t0"] == ("t70", 70, False) and got["t69"] == ("t70", 1, False)
    assert got["c0"] == (None, 66, True) and got["into"] == (None, 67, True) and got["self"] == (None, 1, True)
    assert len(got) == len(links)


def _chain(links, start):
    path, at, cyclic = {start}, links[start], links[start] == start
    while at in links and not cyclic:
        path.add(at)
        at, cyclic = links[at], links[at] in path
    return (None, len(path), None) if at is None else (None if cyclic else at, len(path), cyclic)


def test_chains_beyond_the_rows_of_a_recursion(spark):
    # 1.2 million steps from the many alone.
    links = {f"t{i}": f"t{i + 1}" for i in range(150)} | {f"m{i}": "t0" for i in range(8000)} | {f"a{i}": f"a{i + 1}" for i in range(37)} | {"a37": "a30", "two": "owt", "owt": "two", "to": "two", "self": "self", "open": None, "on": "open"}
    links |= {f"r{i}": f"r{(i * i + 1) % 211}" for i in range(200)}
    rows = [*links.items(), ("to", "two"), (None, "t0"), (None, None)]
    got = sorted(map(tuple, graph.chains(spark, spark.createDataFrame(rows, "name string, base string").repartition(3)).collect()), key=str)
    assert got == sorted([(k, *_chain(links, k)) for k in links] + [(None, None, 1, None)], key=str)
    assert graph.chains(spark, spark.createDataFrame([], "name string, base string")).count() == 0


def test_chains_of_names_with_several_bases(spark):
    rows = [("a", "b"), ("a", "end"), ("b", "c"), ("c", "end")]
    got = sorted(map(tuple, graph.chains(spark, spark.createDataFrame(rows, "name string, base string")).collect()))
    assert got == [("a", "end", 3, False), ("b", "end", 2, False), ("c", "end", 1, False)]
