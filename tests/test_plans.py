"""The driver keeps each running plan and reports it anew after every stage: plans that many results share are cut by tables."""

from wattframe.network import sample
from wattframe.operators import topology
from wattframe.operators.validate import validate
from wattframe.sources.testgrid import grid


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_findings_are_stored_check_by_check(spark):
    net = sample(spark)
    found = validate(net)
    assert "Join" not in _plan(found) and "Aggregate" not in _plan(found)
    assert {r.code for r in found.collect()} <= {"possible-backfeed", "isolated-device", "unreachable"}


def test_the_grid_is_not_planned_twice(spark):
    net = grid(spark, "/root/testdata/sf0.001")
    assert all(x not in _plan(net.objects) + _plan(net.terminals) for x in ("Join", "Window"))
    assert net.objects.where("type = 'load'").count() == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()


def test_no_walk_of_small_feeders_where_all_are_large(spark, monkeypatch):
    net = sample(spark)
    whole = sorted(r.mrid for r in topology.trees(net.objects, net.terminals, net.links).collect())
    schemas, walk = [], topology._walks
    monkeypatch.setattr(topology, "LARGE", 5)
    monkeypatch.setattr(topology, "_walks", lambda members, ends, schema: schemas.append(schema) or walk(members, ends, schema))
    assert sorted(r.mrid for r in topology.trees(net.objects, net.terminals, net.links).collect()) == whole
    assert schemas == [topology.PRUNED]
