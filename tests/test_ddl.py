"""Tokenizer, facts, replay, checks, sources and the facade."""

from __future__ import annotations

import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.ddl import checks
from tessella.ddl.facts import read
from tessella.ddl.replay import object_rows, replay
from tessella.ddl.tokens import split_statements, tokens
from tessella.plans import api
from tessella.sources import readers

TREE = {
    "001_base.sql": """
create schema if not exists shop;
create type shop.state as enum ('new', 'paid');
create table if not exists shop.people (id bigint generated by default as identity primary key, name text not null default '', mail text unique);
create table if not exists shop.sales (id bigint primary key, person bigint not null references shop.people(id), total numeric(12, 2) default 0 check (total >= 0), state shop.state);
create index if not exists sales_person on shop.sales (person);
alter table shop.sales enable row level security;
drop policy if exists sales_read on shop.sales;
create policy sales_read on shop.sales for select to reader using (total >= 0);
create or replace view shop.totals as select p.name, sum(s.total) as total from shop.people p join shop.sales s on s.person = p.id group by p.name;
grant select, insert on shop.sales to reader;
comment on table shop.sales is 'Sales; all of them';
""",
    "002_more.sql": """
-- a comment; with a semicolon
revoke insert on shop.sales from reader;
alter type shop.state add value if not exists 'sent' after 'new';
alter table shop.people add column if not exists note text, alter column name drop default;
create or replace function shop.total(p bigint) returns numeric language sql set search_path = shop as $body$ select sum(total) from shop.sales where person = p; $body$;
insert into shop.people(name) values ('x;y') on conflict do nothing;
""",
}


def keys(state):
    return set(state.objects)


def test_split_respects_quotes_brackets_bodies_and_comments():
    sql = "select ';' ; /* ; */ create function f() returns int as $a$ begin; end $a$; -- ;\n select \"a;b\"; select (1;2); é"
    parts = [t for _, t in split_statements(sql)]
    assert parts == ["select ';'", "create function f() returns int as $a$ begin; end $a$", 'select "a;b"', "select (1;2)", "é"]
    for at, text in split_statements(sql):
        assert sql.encode()[at:].startswith(text.encode())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab'\"$;()-/* \n\\é", max_size=40))
def test_tokens_never_overlap_or_hang(sql):
    at = 0
    for t in tokens(sql):
        assert t.at >= at and sql.startswith(t.text, t.at)
        at = t.at + len(t.text)
    split_statements(sql)


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="abcdefgh ;()'$.,createtabldropviewon", max_size=60))
def test_read_takes_anything(sql):
    for _, text in split_statements(sql):
        read(text).digest


def test_facts():
    f = read("CREATE POLICY p ON app.t FOR UPDATE TO a, b USING (x > 1) WITH CHECK (x > 2)")
    assert (f.key, f.detail) == ("policy:app.p:t", {"command": "update", "using": "x > 1", "check": "x > 2", "roles": ["a", "b"]})
    f = read('create function "My".f(a int, b character varying(3) default null, out c text) returns text security definer as $$ select 1 from x.y $$')
    assert f.key == "function:My.f(int,character varying ( 3 ),text)" and f.detail["definer"] and f.dependencies == ["x.y"]
    assert read("drop table if exists a.b cascade").cascade and not read("drop table a.b").guarded
    # Equal up to case, blanks and casts of literals.
    assert read("create view v as SELECT 'a'::text FROM t").digest == read("create  view v as select 'a' from   T").digest
    assert read("create view v as select 1 from t").digest != read("create view v as select 2 from t").digest


def test_replay():
    state = replay(list(TREE.items()))
    assert not state.problems
    assert keys(state) >= {"schema:shop", "enum:shop.state", "table:shop.people", "constraint:shop.people_pkey:people", "constraint:shop.people_mail_key:people", "constraint:shop.sales_person_fkey:sales", "constraint:shop.sales_total_check:sales", "index:shop.sales_person", "rls:shop.sales", "policy:shop.sales_read:sales", "view:shop.totals", "function:shop.total(bigint)", "grant:shop.sales:table:reader", "comment:public.table shop.sales"}
    assert state.objects["enum:shop.state"]["detail"]["labels"] == ["new", "sent", "paid"]
    assert state.objects["grant:shop.sales:table:reader"]["detail"]["privileges"] == ["SELECT"]
    names = [c["name"] for c in state.objects["table:shop.people"]["detail"]["columns"]]
    assert names == ["id", "name", "mail", "note"]


@pytest.mark.parametrize(
    "events,net",
    [
        (["G SELECT,INSERT", "R SELECT", "G SELECT", "R INSERT", "G INSERT"], {"INSERT", "SELECT"}),
        (["G SELECT,INSERT", "R SELECT", "G SELECT"], {"INSERT", "SELECT"}),
        (["G INSERT,UPDATE", "R SELECT,UPDATE", "G UPDATE", "R UPDATE", "R INSERT,UPDATE"], set()),
        (["G ALL", "R TRUNCATE"], {"SELECT", "INSERT", "UPDATE", "DELETE", "REFERENCES", "TRIGGER"}),
    ],
)
def test_interleaved_privileges(events, net):
    sql = "create table t (a int);" + ";".join(f"{'grant' if e[0] == 'G' else 'revoke'} {e[2:]} on t {'to' if e[0] == 'G' else 'from'} r" for e in events)
    held = replay([("a", sql)]).objects.get("grant:public.t:table:r")
    assert (set(held["detail"]["privileges"]) if held else set()) == net


def test_drops_take_what_belongs_to_them():
    gone = "drop table shop.sales cascade;"
    state = replay([*TREE.items(), ("003", gone)])
    left = keys(state)
    assert not any("sales" in k for k in left) and "view:shop.totals" not in left and "table:shop.people" in left
    assert not state.problems


def test_net_zero_churn():
    churn = "create view shop.v as select 1; grant select on shop.v to reader; comment on view shop.v is 'x'; drop view shop.v; grant delete on shop.sales to reader; revoke delete on shop.sales from reader; alter table shop.people enable row level security; alter table shop.people disable row level security;"
    before, after = replay(list(TREE.items())), replay([*TREE.items(), ("003", churn)])
    digest = lambda s: {r[1]: r[6] for r in object_rows("h", s)}
    assert digest(before) == digest(after)


def test_problems():
    state = replay([("a", "create table t (a int); create table t (a int); drop view v; alter table t drop column b; alter table t add column a int; drop table if exists nothing; frobnicate x")])
    assert [p[2] for p in state.problems] == ["R01", "R02", "R02", "R01", "R99"]


def test_renames():
    state = replay([("a", "create table t (a int primary key); create view v as select a from t; alter table t rename to u; alter table u rename column a to b")])
    assert "table:public.u" in state.objects and "constraint:public.t_pkey:u" in state.objects
    assert state.objects["view:public.v"]["dependencies"] == ["public.u"]
    assert state.objects["constraint:public.t_pkey:u"]["detail"]["columns"] == ["b"]


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    base = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        (base / name).write_text(text)
    (base / "_bootstrap").mkdir()
    (base / "_bootstrap" / "000.sql").write_text("create schema boot;")
    return base


def test_sources(spark, tree, tmp_path):
    objects = readers.read_source(spark, f"dir:{tree}")
    expected = keys(replay(list(TREE.items())))
    assert {r.key for r in objects.collect()} == expected
    assert readers.sql_directory(spark, str(tree), bootstrap=True).count() == 1
    readers.write_catalog(objects, str(tmp_path / "saved"))
    again = readers.read_source(spark, f"catalog:{tmp_path / 'saved'}")
    assert api.selfcheck(objects, again).count() == 0
    assert readers.read_source(spark, "empty:").count() == 0
    run = lambda *a: subprocess.run(["git", "-C", str(tree), *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", ".")
    run("-c", "user.email=a@b.c", "-c", "user.name=n", "commit", "-qm", "x")
    for ref in ("HEAD", "INDEX"):
        assert api.selfcheck(objects, readers.objects_of(readers.git(spark, ref, repository=str(tree)))).count() == 0
    with pytest.raises(ValueError):
        readers.read_source(spark, "nowhere:x")


def test_migration_files_and_lineage(spark, tmp_path):
    (tmp_path / "20260101000000_a.sql").write_text("-- lineage: from=f0 to=f1 format=7\nselect 1;")
    (tmp_path / "20260102000000_b.sql").write_text("create index concurrently i on t (a);")
    files = {r.name: (r.version, r.concurrent) for r in readers.migration_files(spark, str(tmp_path)).collect()}
    assert files == {"20260101000000_a.sql": ("20260101000000", False), "20260102000000_b.sql": ("20260102000000", True)}
    assert [tuple(r)[1:] for r in readers.lineage(spark, str(tmp_path)).collect()] == [("20260101000000", "f0", "f1", 7)]
    assert readers.applied_versions(spark, str(tmp_path / "none")).count() == 0


def test_plan(spark, tree):
    before, after = readers.read_source(spark, "empty:"), readers.read_source(spark, f"dir:{tree}")
    order = [r.key for r in api.plan(before, after).orderBy("seq").collect()]
    at = {k: i for i, k in enumerate(order)}
    assert at["schema:shop"] < at["enum:shop.state"] < at["table:shop.sales"] < at["view:shop.totals"] < at["comment:public.table shop.sales"]
    back = [r.key for r in api.plan(after, before).orderBy("seq").collect()]
    at = {k: i for i, k in enumerate(back)}
    assert at["view:shop.totals"] < at["table:shop.sales"] < at["enum:shop.state"] < at["schema:shop"]
    assert api.plan(after, after).count() == 0
    rendered = {r.key: r.sql for r in api.render(api.plan(after, before), after, before).collect()}
    assert rendered["policy:shop.sales_read:sales"] == "DROP POLICY IF EXISTS sales_read ON shop.sales"
    assert api.audit(after).where("by = 'kind' AND value = 'table'").first().n == 2
    assert len(api.fingerprint(after).first().fingerprint) == 64


BAD = """create table t (a int);
create type s as enum ('a');
alter type s add value 'b';
select 'b'::s;
create view w as select * from later;
create table if not exists later (a int);
create policy p on t using (true);
drop table t cascade;
insert into t values (1);
update t set a = 1;
set search_path = x;
alter table t alter column a set not null;
alter table t add constraint c check (a > 0);
alter table t add column n uuid not null default gen_random_uuid();
create function f() returns int language sql security definer as 'select 1';
create index concurrently i on t (a);
"""


def test_static_checks(spark):
    files = spark.createDataFrame([("bad.sql", BAD), ("good.sql", TREE["001_base.sql"]), ("null.sql", None)], "file string, sql string")
    found = {(r.file, r.code) for r in api.check(files).collect()}
    bad = {c for f, c in found if f == "bad.sql"}
    assert bad >= {"C01", "C02", "C03", "C05", "C06", "C07", "C08", "C09", "C10", "C11", "C12", "C14", "C15", "C17", "C18", "C19", "C20"}
    assert {c for f, c in found if f == "good.sql"} == {"C02"}
    scores = {r.file: r.score for r in api.scan(api.check(files)).collect()}
    assert scores["bad.sql"] == 0 and scores["good.sql"] == 90


def test_facts_are_distributed_and_stateless(spark):
    files = spark.createDataFrame([(f"{i}.sql", TREE["001_base.sql"]) for i in range(20)], "file string, sql string")
    assert checks.facts(checks.statements(files)).groupBy("file").count().where("count <> 11").count() == 0


def test_checks_read_each_text_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(parts):
        for part in parts:
            read.add(len(part))
            yield part

    files = spark.createDataFrame([(f"{i}.sql", BAD) for i in range(10)], "file string, sql string").mapInPandas(counted, "file string, sql string")
    found = api.check(files).collect()
    assert {f: sum(r.file == f for r in found) for f in {r.file for r in found}} == {f"{i}.sql": len(found) // 10 for i in range(10)}
    assert read.value == 10


def test_facts_of_files_are_those_of_their_statements(spark):
    texts = [BAD, TREE["001_base.sql"], None, "", ";;", "select 'ä;' ; -- ö;\ncreate table \"Ü;\" (a int) ;\n", "do $x$ begin; end $x$; select $$;", "insert into t values ('open", "create function f(a int) returns int as $$ select 1; $$ language sql; /* ; */ drop view v;) ; select (;"]
    texts += ["alter table é.t add column b int not null;" * 50, "/* open; select 1"]
    files = spark.createDataFrame([(f"{i}.sql", t) for i, t in enumerate(texts)], "file string, sql string")
    rows = lambda f: sorted(map(tuple, f.collect()), key=lambda r: r[:2])
    assert rows(checks.file_facts(files)) == rows(checks.facts(checks.statements(files)))
    for r in checks.file_facts(files).collect():
        whole = texts[int(r.file.split(".")[0])].encode()
        assert whole[r.byte_start :].startswith(r.text.encode())


def test_watch(spark, tree, tmp_path):
    from tessella.streaming.watch import watch

    seen = []
    base = readers.empty(spark)
    query = watch(spark, str(tree), base, lambda plan, n: seen.append(plan.count()), str(tmp_path / "cp"), once=True)
    query.awaitTermination(120)
    assert seen and seen[-1] == len(keys(replay(list(TREE.items()))))


@pytest.mark.parametrize(
    "a,b",
    [
        ("check (state in ('a', 'b'))", "check (state = any (array['a'::text, 'b'::text]))"),
        ("check (state not in ('a'))", "check (state <> all (array['a'::text]))"),
        ("check (n between 1 and 5)", "check (n >= 1 and n <= 5)"),
        ("check (n > 0)", "check (N > 0::numeric)"),
    ],
)
def test_equal_predicates_are_equal(a, b):
    digest = lambda c: replay([("f", f"create table t (n int, state text, constraint k {c})")]).objects["constraint:public.k:t"]["body"]
    assert digest(a) == digest(b)


def test_sequence_defaults_and_policies():
    assert read("create sequence s increment by 1 no maxvalue start with 1").digest == read("create sequence s").digest != read("create sequence s start 5").digest
    state = replay([("a", "create table t (a int); create policy p on t for select to b, a using (a > 0); alter policy p on t to c using (a between 1 and 2)")])
    assert state.objects["policy:public.p:t"]["detail"] == {"command": "select", "roles": ["c"], "using": "a >= 1 and a <= 2", "check": None}


def test_do_blocks_are_guarded():
    block = "do $$ begin if not exists (select 1 from pg_type) then create type mood as enum ('x'); end if; execute 'create table d (a int)'; exception when duplicate_object then null; end $$;"
    state = replay([("a", block), ("b", block)])
    assert keys(state) == {"enum:public.mood", "table:public.d"} and not state.problems


def test_view_types(spark):
    from pyspark.sql import functions as F

    from tessella.plans import typing

    columns = spark.createDataFrame([("app.t", "id", "int8", 1), ("app.t", "tags", "text[]", 2), ("app.t", "total", "numeric(10, 2)", 3), ("app.t", "at", "timestamptz", 4), ("app.u", "id", "int", 1)], "table_name string, column_name string, type string, position int")
    views = {
        "app.b": "WITH x AS (SELECT * FROM app.a) SELECT id, total * 2 AS twice FROM x JOIN app.u USING (id)",
        "app.a": "SELECT id, total, CASE WHEN total > 1 THEN 'big' END AS size, row_number() OVER (ORDER BY id) AS n, (SELECT max(id) FROM app.u) AS top FROM app.t",
        "app.c": "SELECT nothing FROM app.t",
    }
    typed, failed = typing.view_columns(spark, columns, views)
    assert {f.name: f.dataType.simpleString() for f in typed["app.a"]} == {"id": "bigint", "total": "decimal(10,2)", "size": "string", "n": "int", "top": "int"}
    assert [f.name for f in typed["app.b"]] == ["id", "twice"] and list(failed) == ["app.c"]
    assert typing.is_updatable("select a, b from t x where a > 1 order by b")
    for no in ("select distinct a from t", "select a from t, u", "select count(*) from t", "select a from t join u using (a)", "select a from t limit 1", "select 1"):
        assert not typing.is_updatable(no)


def test_unresolved_dependencies(spark):
    from tessella.operators import decisions

    objects = readers.objects_of(spark.createDataFrame([("a", "create view v as select * from x.gone; create table t (a int); create view w as select * from public.t")], "file string, sql string"))
    assert [tuple(r) for r in decisions.unresolved(objects).collect()] == [("view:public.v", "x.gone")]


def test_intents(spark):
    files = [("1", "alter table t drop column a, drop column b; update t set c = a;"), ("2", "alter table u drop column x; drop view if exists v; alter type e add value 'q'"), ("3", "alter table w drop column y; do $$ begin end $$")]
    f = checks.facts(checks.statements(spark.createDataFrame(files, "file string, sql string")))
    got = {(r.file, r.intent, r.column_name) for r in checks.intents(f).collect()}
    assert got >= {("1", "drop_column", "a"), ("1", "rows", None), ("2", "drop", None), ("2", "add_label", "q"), ("3", "block", None)}
    assert [tuple(r) for r in checks.silent_column_drops(f).collect()] == [("table:public.u", "x")]


CHANGED = """
create schema shop;
create type shop.state as enum ('new', 'sent', 'paid', 'back');
create table shop.people (id bigint generated by default as identity primary key, name text not null, mail varchar(80) unique, note text default 'none');
create table shop.sales (id bigint primary key, person bigint references shop.people(id), total numeric(12, 2) default 0 check (total > 0), state shop.state not null);
create table shop.added (id int, constraint both_ways check (id <> 0));
create index sales_state on shop.sales (state);
alter table shop.sales enable row level security; alter table shop.sales force row level security;
create policy sales_read on shop.sales to reader using (total in (1, 2));
create policy sales_write on shop.sales for insert to reader, writer with check (true);
create view shop.totals as select sum(total) as total from shop.sales;
create function shop.total(p bigint) returns numeric language sql as $x$ select 1 $x$;
grant select, update on shop.sales to reader; grant all on shop.people to writer;
comment on table shop.people is 'People';
"""


@pytest.mark.parametrize("there", [True, False])
def test_a_rendered_plan_leads_to_the_other_state(spark, there):
    """Replaying what is rendered on top of one state gives the other, and once more changes nothing."""
    texts = ["".join(TREE.values()), CHANGED]
    first, second = texts if there else texts[::-1]
    state = lambda sql: readers.objects_of(spark.createDataFrame([("a", sql)], "file string, sql string"))
    before, after = state(first), state(second)
    text = api.migration(api.render(api.plan(before, after), before, after)).first().sql
    assert "-- to be written" not in text or not there
    for sql in (first + text, first + text + text):
        got = replay([("a", sql)])
        left = {r.key: r.finding for r in api.selfcheck(after, state(sql)).collect()}
        if there:
            assert not left
        else:
            # A label cannot be taken from an enum.
            assert set(left) <= {"enum:shop.state"}
        assert not [p for p in got.problems if p[2] != "R99"]


def test_view_options():
    base = "create view v as select 1; create table t (a int);"
    plain = replay([("a", base)]).objects
    there = replay([("a", base + "alter view v set (security_invoker = true, security_barrier); alter table t set (fillfactor = 70)")]).objects
    back = replay([("a", base + "alter view v set (security_invoker = true); alter view v reset (security_invoker); alter table t set (fillfactor = 70); alter table t reset (fillfactor)")]).objects
    assert there["view:public.v"]["detail"]["options"] == {"security_barrier": "true", "security_invoker": "true"}
    for key in ("view:public.v", "table:public.t"):
        assert there[key]["body"] != plain[key]["body"] == back[key]["body"]
