"""Every named query against its SQL."""

from __future__ import annotations

import pytest

from tessella import plans


def _rows(columns, rows):
    order = sorted(columns)
    value = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(value(dict(zip(columns, r))[c]) for c in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, data, duck, name):
    df = plans.QUERIES[name](spark, data)
    got = _rows(df.columns, df.collect())
    assert got, "a query that finds nothing proves nothing"
    if name in plans.ORACLE_SQL:
        expected = duck.sql(plans.ORACLE_SQL[name])
        assert got == _rows(expected.columns, expected.fetchall())


def test_entry_runs_without_the_pipeline(spark, data):
    import __spark_entry__ as e

    assert e.queries()["snapshot_diff_summary"](spark, data).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())


def test_whole_tables_are_read(spark, data, duck):
    count = lambda sql: duck.sql(sql).fetchall()[0][0]
    run = lambda name: plans.QUERIES[name](spark, data)
    assert run("with_ordinality").count() == count("SELECT sum(len(embedding)) FROM embeddings")
    assert run("operation_dependencies").select("key").distinct().count() == count("SELECT count(*) FROM orders WHERE o_orderkey % 10 <> 0")
    assert run("acl_explode_group").selectExpr("sum(size(split(privileges, ',')))").first()[0] == count("SELECT count(DISTINCT (user_id % 20, user_id % 7, event_type)) FROM events")
    members = [r.members for r in run("full_set_to_all").collect()]
    assert "ALL" in members and len(set(members)) > 1
    assert sum(5 if m == "ALL" else m.count(",") + 1 for m in members) == count("SELECT count(DISTINCT (user_id % 20, user_id % 7, CAST(ts AS DATE), event_type)) FROM events WHERE event_id % 3 <> 0")


def test_a_catalog_is_a_state_like_any_other(spark, data):
    from tessella.ddl.replay import OBJECTS
    from tessella.operators import pgcatalog
    from tessella.plans import api
    from tessella.sources.pg_views import fixture

    state = pgcatalog.state(fixture(spark, data))
    assert [f"{n} {t}" for n, t in state.dtypes] == [c.replace(" long", " bigint") for c in OBJECTS.split(", ")]
    n = state.count()
    assert n == state.select("key").distinct().count() == state.select("ordinal").distinct().count()
    assert api.audit(state).where("by = 'kind'").selectExpr("sum(n)").first()[0] == n
    planned = api.plan(state.where("kind <> 'enum'"), state.where("kind <> 'policy'"))
    assert {(r.op, r.object_kind) for r in planned.collect()} == {("create", "enum"), ("drop", "policy")}
