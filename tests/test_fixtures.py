from __future__ import annotations

from tessella.plans import api
from tessella.sources import fixtures


def test_a_plan_over_the_generated_schema_is_ordered(spark):
    before, after = fixtures.states(spark, 60)
    assert before.groupBy("key").count().where("count > 1").count() == 0
    assert 6 < before.count() / 60 < 9
    planned = api.plan(before, after).collect()
    at = {r.key: r.seq for r in planned}
    assert sorted(at.values()) == list(range(len(planned))) and not any(r.cyclic for r in planned)
    assert "table:app.audit_events" in at and "enum:app.status" in at
    ops = {(r.op, r.object_kind) for r in planned}
    assert ("drop", "index") in ops and ("change", "table") in ops and ("create", "table") in ops
    # A table that changes comes after the type it needs.
    assert at["enum:app.status"] < min(s for k, s in at.items() if k.startswith("table:app.entity"))


def test_no_change_is_no_plan(spark):
    before, _ = fixtures.states(spark, 20)
    assert api.plan(before, before).count() == 0


def test_texts_go_the_whole_way(spark):
    """Both states from text; the plan's statements, replayed on the first state's text, lead to the second."""
    from tessella.plans import api
    from tessella.sources import fixtures, readers

    files = [fixtures.texts(spark, 40, changed) for changed in (False, True)]
    before, after = (readers.objects_of(f) for f in files)
    planned = api.plan(before, after)
    found = {(r.op, r.object_kind): r["count"] for r in planned.groupBy("op", "object_kind").count().collect()}
    assert found["change", "table"] == 13 and found["create", "table"] == 1 and found["change", "enum"] == 1
    assert found["drop", "index"] == 1 and found["change", "index"] == 1 and found["change", "policy"] == 1
    assert found["change", "view"] == 1 and found["change", "function"] == 1 and found["change", "comment"] == 1
    rendered = api.render(planned, before, after)
    assert rendered.where("sql IS NOT NULL").count() > 15
    lines = api.migration(rendered).first()["sql"]
    both = files[0].unionByName(spark.createDataFrame([("999999999", lines)], "file string, sql string"))
    again = {r.key: r.hash for r in readers.objects_of(both).collect()}
    wanted = {r.key: r.hash for r in after.collect()}
    assert set(again) == set(wanted)
    assert sum(again[k] != wanted[k] for k in wanted) <= 1
