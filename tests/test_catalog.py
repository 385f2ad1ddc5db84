import pytest

from wattframe import catalog, catalog_more
from wattframe.errors import NameProblem
from wattframe.network import Network, normalized

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["csv_round_trip", "cim_round_trip", "sqlite_round_trip"])
def test_round_trips_hold_the_whole_network(spark, monkeypatch, name):
    seen, plain = [], catalog_more.execute
    monkeypatch.setattr(catalog_more, "execute", lambda net, text: seen.append(net) or plain(net, text))
    out = {(r.feeder, r.type, r.state): (r["COUNT(*)"], r["COUNT(depth)"]) for r in catalog.queries()[name](spark, SF).collect()}
    net = catalog.network(spark, SF)
    rows = lambda n: sorted((r.mrid, r.type, r.feeder or "", r.substation or "", r.state or "", r.kw or 0, r.kva or 0) for r in n.objects.collect())
    pairs = lambda n: sorted((r.mrid, r.node) for r in n.terminals.collect())
    assert rows(seen[0]) == rows(net) and len({r[2] for r in rows(net)}) == 26
    assert len(pairs(seen[0])) == len(pairs(net))
    assert out == {(r.feeder, r.type, r.state): (r["count"], r["count"]) for r in net.objects.where("is_device").groupBy("feeder", "type", "state").count().collect()}


def test_validation_counts_dark_sections_with_a_generator(spark):
    net = catalog.network(spark, SF)
    live = {r.mrid for r in net.energy.where("energized").collect()}
    dark = {r.mrid: r for r in net.objects.where("is_device").collect() if r.mrid not in live}
    nodes = {}
    for r in net.terminals.collect():
        nodes.setdefault(r.mrid, []).append(r.node)
    near = {}
    for mrid, r in dark.items():
        if not (r.is_switch and r.state == "OPEN"):
            for n in nodes[mrid]:
                near.setdefault(n, set()).update(nodes[mrid])
    left, sections = {n for m in dark if m.startswith("PV-") for n in nodes[m]}, 0
    while left:
        todo, sections = [left.pop()], sections + 1
        seen = set(todo)
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        left -= seen
    out = {r.code: (r.severity, r.n) for r in catalog.queries()["validate_codes"](spark, SF).collect()}
    assert sections and out["possible-backfeed"] == ("warning", sections)


def test_order_desc_ends_with_every_breaker(spark):
    out = [(r.type, r.kw) for r in catalog.queries()["order_desc_nulls_last"](spark, "/root/testdata/sf0.01").collect()]
    kw = [k for _, k in out if k is not None]
    assert len(kw) == 206 and kw == sorted(kw, reverse=True) and out[206:] == [("breaker", None)] * 25


def test_an_exact_mrid_wins_over_many_names(spark):
    rows = [(f"d{k}", "x") for k in range(1500)] + [("X", "other"), ("x2", "Y"), ("x3", "y")]
    net = Network(normalized(spark.createDataFrame(rows, "mrid string, name string").selectExpr("*", "'load' as type").coalesce(1)), spark.createDataFrame([], "mrid string, seq int, node string"), spark.createDataFrame([], "a string, b string"))
    assert net.find("X").mrid == "X" and net.find("x").mrid == "X"
    with pytest.raises(NameProblem):
        net.find("y")


def test_switching_twice(spark):
    net = catalog.network(spark, SF)
    state = lambda rows: {r.mrid: r.state for r in net.with_state(spark.createDataFrame(rows, "mrid string, state string")).objects.where("type = 'recloser'").collect()}
    plain = state([("nothing", "OPEN")])
    one = sorted(plain)[0]
    assert state([(one, "open"), (one, "OPEN")]) == plain | {one: "OPEN"}
    with pytest.raises(Exception, match="two states"):
        state([(one, "open"), (one, "CLOSED")])
