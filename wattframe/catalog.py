"""The queries over the test grid, with the same results in DuckDB's SQL.

A network is made once per session and folder; its trees and energy are stored tables that all queries share.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wattframe.network import Network
from wattframe.operators.storage import drop_stored, shared_folder
from wattframe.plans.compiler import execute, execute_script
from wattframe.sources.testgrid import DEVICES, grid

_made: dict[tuple[str, str], Network] = {}


def network(spark: SparkSession, sf_dir: str) -> Network:
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _made:
        # Stored once: every query, name lookup and tree reads tables laid out by feeder, not the join that made them.
        path = f"{shared_folder(spark)}/grid-{uuid.uuid4().hex}"
        made = grid(spark, sf_dir)
        made.save(path)
        drop_stored(made.terminals)
        loaded = Network.load(spark, path)
        _made[key] = Network(loaded.objects, loaded.terminals, loaded.links, source=sf_dir)
    return _made[key]


_ALL = """obj AS (
SELECT mrid, mrid AS name, type, feeder, substation, state, normal_state, is_tie, kva, kw, kind, parent, n1, n2, x_priority, x_status, x_flag FROM dev
UNION ALL SELECT concat('FDR-', n_nationkey), n_name, 'feeder', NULL, concat('SUB-', n_regionkey), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM nation
UNION ALL SELECT concat('SUB-', r_regionkey), r_name, 'substation', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM region)"""
_TREE = """up AS (SELECT mrid, parent, 0 AS step, parent AS above FROM dev UNION ALL SELECT u.mrid, u.parent, u.step + 1, d.parent FROM up u JOIN dev d ON d.mrid = u.above WHERE u.above IS NOT NULL),
depths AS (SELECT mrid, count(above) AS depth FROM up GROUP BY mrid),
guard AS (SELECT mrid, first(above ORDER BY step) AS protected_by FROM up WHERE above IS NOT NULL AND split_part(above, '-', 1) IN ('BRK', 'REC', 'FU') GROUP BY mrid),
tree AS (SELECT dev.*, CAST(depth AS integer) AS depth, protected_by FROM dev JOIN depths USING (mrid) LEFT JOIN guard USING (mrid))"""
_LIVE = """ed AS (SELECT mrid, n1, n2, type NOT IN ('breaker', 'switch', 'recloser', 'fuse') OR state = 'CLOSED' AS conducts FROM dev),
live(node) AS (SELECT unnest([n1, n2]) FROM ed WHERE conducts AND mrid LIKE 'BRK-%' UNION SELECT CASE WHEN e.n1 = l.node THEN e.n2 ELSE e.n1 END FROM live l JOIN ed e ON conducts AND n2 IS NOT NULL AND (e.n1 = l.node OR e.n2 = l.node)),
hot AS (SELECT mrid FROM ed WHERE mrid LIKE 'BRK-%' OR n1 IN (SELECT node FROM live) OR n2 IN (SELECT node FROM live)),
cold AS (SELECT * FROM ed WHERE mrid NOT IN (SELECT mrid FROM hot)),
unk(node) AS (SELECT n1 FROM cold WHERE mrid LIKE 'PV-%' UNION SELECT CASE WHEN e.n1 = l.node THEN e.n2 ELSE e.n1 END FROM unk l JOIN cold e ON conducts AND n2 IS NOT NULL AND (e.n1 = l.node OR e.n2 = l.node)),
energy AS (SELECT dev.*, CASE WHEN mrid IN (SELECT mrid FROM hot) THEN true WHEN n1 IN (SELECT node FROM unk) OR n2 IN (SELECT node FROM unk) THEN NULL ELSE false END AS energized FROM dev)"""


def _sql(select: str, *parts: str) -> str:
    return f"WITH RECURSIVE {DEVICES}" + "".join(f",\n{p}" for p in parts) + f"\n{select}"


_SW = "type IN ('switch', 'recloser', 'breaker', 'fuse', 'sectionalizer')"
_COLS = "mrid, name, type, feeder, 'ABC' AS phases"

#: Name, query text, and the oracle's SELECT with the parts it needs.
_QUERIES: list[tuple[str, str, str]] = [
    ("transformers_by_feeder", "FIND transformers WHERE kva >= 300 SELECT feeder, COUNT(*), SUM(kva) GROUP BY feeder ORDER BY SUM(kva) DESC", _sql("""SELECT feeder, count(*) AS "COUNT(*)", sum(kva) AS "SUM(kva)" FROM dev WHERE type = 'transformer' AND kva >= 300 GROUP BY feeder""")),
    ("type_scan", "FIND reclosers", _sql(f"SELECT {_COLS}, CAST(NULL AS double) AS voltage, state, normal_state FROM obj WHERE type = 'recloser'", _ALL)),
    ("supertype_scan", "FIND switches SELECT mrid, type", _sql(f"SELECT mrid, type FROM dev WHERE {_SW}")),
    ("where_eq", "FIND fuses WHERE state = open SELECT mrid, feeder", _sql("SELECT mrid, feeder FROM dev WHERE type = 'fuse' AND state = 'OPEN'")),
    ("where_ne", "FIND switches WHERE state != normal_state SELECT mrid", _sql(f"SELECT mrid FROM dev WHERE {_SW} AND state <> normal_state")),
    ("where_lt", "FIND loads WHERE kw < 3 SELECT mrid, kw", _sql("SELECT mrid, kw FROM dev WHERE type = 'load' AND kw < 3")),
    ("where_ge", "FIND transformers WHERE kva >= 300 SELECT mrid, kva", _sql("SELECT mrid, kva FROM dev WHERE type = 'transformer' AND kva >= 300")),
    ("unit_literal", "FIND transformers WHERE kva >= 0.4MVA SELECT mrid, kva", _sql("SELECT mrid, kva FROM dev WHERE type = 'transformer' AND kva >= 400")),
    ("and_or_not", "FIND switches WHERE NOT (state = closed OR is_tie) AND type = fuse OR type = breaker SELECT mrid", _sql(f"SELECT mrid FROM dev WHERE {_SW} AND (NOT (state = 'CLOSED' OR is_tie) AND type = 'fuse' OR type = 'breaker')")),
    ("in_list", "FIND devices WHERE feeder IN ('fdr-3', FDR-7) AND type IN (breaker, recloser) SELECT mrid", _sql("SELECT mrid FROM dev WHERE feeder IN ('FDR-3', 'FDR-7') AND type IN ('breaker', 'recloser')")),
    ("contains", "FIND transformers WHERE mrid CONTAINS x-99 SELECT mrid", _sql("SELECT mrid FROM dev WHERE type = 'transformer' AND lower(mrid) LIKE '%x-99%'")),
    ("like", "FIND devices WHERE mrid LIKE 'fu-_1%' SELECT mrid", _sql("SELECT mrid FROM dev WHERE lower(mrid) LIKE 'fu-_1%'")),
    ("is_missing", "FIND devices WHERE kw IS MISSING AND kva IS MISSING SELECT type, COUNT(*) GROUP BY type", _sql("""SELECT type, count(*) AS "COUNT(*)" FROM dev WHERE kw IS NULL AND kva IS NULL GROUP BY type""")),
    ("is_not_missing", "FIND devices WHERE kw IS NOT MISSING SELECT COUNT(*)", _sql("""SELECT count(*) AS "COUNT(*)" FROM dev WHERE kw IS NOT NULL""")),
    ("truthy", "FIND devices WHERE is_tie SELECT mrid", _sql("SELECT mrid FROM dev WHERE is_tie")),
    ("extras_filter", "FIND transformers WHERE priority = '1-urgent' SELECT mrid, priority", _sql("SELECT mrid, x_priority AS priority FROM dev WHERE lower(x_priority) = '1-urgent'")),
    ("text_as_number", "FIND devices WHERE priority > 3 OR flag != 5 SELECT type, COUNT(*) GROUP BY type", _sql("""SELECT type, count(*) AS "COUNT(*)" FROM dev WHERE x_flag IS NOT NULL GROUP BY type""")),
    ("select_columns", "FIND generators SELECT MRID, kind, kw", _sql("SELECT mrid AS \"MRID\", kind, kw FROM dev WHERE type = 'generator'")),
    ("default_columns", "FIND generators WHERE kw > 90", _sql(f"SELECT {_COLS}, CAST(NULL AS double) AS voltage, kind, kw, kva, CAST(NULL AS double) AS kwh FROM obj WHERE type = 'generator' AND kw > 90", _ALL)),
    ("count_star", "FIND devices SELECT COUNT(*)", _sql("""SELECT count(*) AS "COUNT(*)" FROM dev""")),
    ("count_attr", "FIND devices SELECT COUNT(kva), COUNT(kw), COUNT(state)", _sql("""SELECT count(kva) AS "COUNT(kva)", count(kw) AS "COUNT(kw)", count(state) AS "COUNT(state)" FROM dev""")),
    ("aggregates", "FIND loads SELECT SUM(kw), AVG(kw), MIN(kw), MAX(kw)", _sql("""SELECT sum(kw) AS "SUM(kw)", avg(kw) AS "AVG(kw)", min(kw) AS "MIN(kw)", max(kw) AS "MAX(kw)" FROM dev WHERE type = 'load'""")),
    ("min_text", "FIND devices SELECT MIN(mrid), MAX(feeder), MIN(is_tie)", _sql("""SELECT min(mrid) AS "MIN(mrid)", max(feeder) AS "MAX(feeder)", 'False' AS "MIN(is_tie)" FROM dev""")),
    ("global_agg_empty", "FIND transformers WHERE kva > 900000 SELECT COUNT(*), SUM(kva), MAX(mrid)", _sql("""SELECT count(*) AS "COUNT(*)", sum(kva) AS "SUM(kva)", max(mrid) AS "MAX(mrid)" FROM dev WHERE kva > 900000""")),
    ("group_by_two", "FIND devices SELECT substation, type, COUNT(*), SUM(kw) GROUP BY substation, type", _sql("""SELECT substation, type, count(*) AS "COUNT(*)", sum(kw) AS "SUM(kw)" FROM dev GROUP BY substation, type""")),
    ("group_default_count", "FIND devices GROUP BY state", _sql("""SELECT state, count(*) AS "COUNT(*)" FROM dev GROUP BY state""")),
    ("order_desc_nulls_last", "FIND devices WHERE type IN (generator, breaker) ORDER BY kw DESC", _sql(f"SELECT {_COLS}, CAST(NULL AS double) AS voltage, state, normal_state, kind, kw, kva, CAST(NULL AS double) AS kwh FROM obj WHERE type IN ('generator', 'breaker') ORDER BY kw DESC NULLS LAST, mrid", _ALL)),
    ("order_hidden_aggregate", "FIND loads SELECT feeder GROUP BY feeder ORDER BY SUM(kw) DESC, feeder LIMIT 5", _sql("SELECT feeder FROM dev WHERE type = 'load' GROUP BY feeder ORDER BY sum(kw) DESC, feeder LIMIT 5")),
    ("limit_topk", "FIND transformers SELECT mrid, kva ORDER BY kva DESC LIMIT 20", _sql("SELECT mrid, kva FROM dev WHERE type = 'transformer' ORDER BY kva DESC, mrid LIMIT 20")),
    ("downstream_device", "FIND devices DOWNSTREAM OF 'REC-1' SELECT mrid, hops", _sql("SELECT t.mrid, t.depth - 1 AS hops FROM tree t WHERE t.mrid IN (SELECT mrid FROM up WHERE above = 'REC-1')", _TREE)),
    ("downstream_feeder", "FIND loads DOWNSTREAM OF FDR-4 SELECT COUNT(*), SUM(kw)", _sql("""SELECT count(*) AS "COUNT(*)", sum(kw) AS "SUM(kw)" FROM dev WHERE type = 'load' AND feeder = 'FDR-4'""")),
    ("downstream_substation", "FIND fuses DOWNSTREAM OF SUB-2 SELECT feeder, COUNT(*) GROUP BY feeder", _sql("""SELECT feeder, count(*) AS "COUNT(*)" FROM dev WHERE type = 'fuse' AND substation = 'SUB-2' GROUP BY feeder""")),
    ("upstream", "FIND devices UPSTREAM OF 'TX-1' SELECT mrid, hops", _sql("SELECT u.above AS mrid, CAST(u.step + 1 AS integer) AS hops FROM up u WHERE u.mrid = 'TX-1' AND above IS NOT NULL", _TREE)),
    ("connected_to", "FIND devices CONNECTED TO 'FU-3' SELECT mrid", _sql("SELECT DISTINCT d.mrid FROM dev d, dev t WHERE t.mrid = 'FU-3' AND d.mrid <> t.mrid AND (d.n1 IN (t.n1, t.n2) OR d.n2 IN (t.n1, t.n2))")),
    ("connected_to_across_tie", "FIND switches CONNECTED TO 'TIE-6' SELECT mrid, feeder", _sql(f"SELECT DISTINCT d.mrid, d.feeder FROM dev d, dev t WHERE t.mrid = 'TIE-6' AND d.mrid <> t.mrid AND d.{_SW} AND (d.n1 IN (t.n1, t.n2) OR d.n2 IN (t.n1, t.n2))")),
    ("fed_by", "FIND devices FED BY 'BRK-9' SELECT type, COUNT(*) GROUP BY type", _sql("""SELECT type, count(*) AS "COUNT(*)" FROM tree WHERE mrid = 'BRK-9' OR mrid IN (SELECT mrid FROM up WHERE above = 'BRK-9') GROUP BY type""", _TREE)),
    ("protected_by", "FIND devices PROTECTED BY 'REC-2' SELECT mrid", _sql("SELECT mrid FROM tree WHERE protected_by = 'REC-2'", _TREE)),
    ("protected_by_attribute_group", "FIND loads SELECT protected_by, COUNT(*), SUM(kw) GROUP BY protected_by", _sql("""SELECT protected_by, count(*) AS "COUNT(*)", sum(kw) AS "SUM(kw)" FROM tree WHERE type = 'load' GROUP BY protected_by""", _TREE)),
    ("hops_filter", "FIND devices DOWNSTREAM OF 'BRK-1' WHERE hops <= 2 SELECT mrid, hops", _sql("SELECT mrid, depth AS hops FROM tree WHERE depth <= 2 AND mrid IN (SELECT mrid FROM up WHERE above = 'BRK-1')", _TREE)),
    ("hops_aggregate", "FIND devices FED BY 'BRK-2' SELECT type, MAX(hops), COUNT(*) GROUP BY type", _sql("""SELECT type, max(depth) AS "MAX(hops)", count(*) AS "COUNT(*)" FROM tree WHERE mrid = 'BRK-2' OR mrid IN (SELECT mrid FROM up WHERE above = 'BRK-2') GROUP BY type""", _TREE)),
    ("depth_filter", "FIND devices WHERE depth = 3 SELECT type, COUNT(*) GROUP BY type", _sql("""SELECT type, count(*) AS "COUNT(*)" FROM tree WHERE depth = 3 GROUP BY type""", _TREE)),
    ("relations_intersect", "FIND devices DOWNSTREAM OF 'REC-1' PROTECTED BY 'REC-1' SELECT mrid, hops", _sql("SELECT mrid, depth - 1 AS hops FROM tree WHERE protected_by = 'REC-1' AND mrid IN (SELECT mrid FROM up WHERE above = 'REC-1')", _TREE)),
    ("energized_true", "FIND loads WHERE energized SELECT COUNT(*), SUM(kw)", _sql("""SELECT count(*) AS "COUNT(*)", sum(kw) AS "SUM(kw)" FROM energy WHERE type = 'load' AND energized""", _LIVE)),
    ("energized_false", "FIND loads WHERE NOT energized SELECT mrid, feeder", _sql("SELECT mrid, feeder FROM energy WHERE type = 'load' AND NOT energized", _LIVE)),
    ("energized_missing", "FIND devices WHERE energized IS MISSING SELECT type, COUNT(*) GROUP BY type", _sql("""SELECT type, count(*) AS "COUNT(*)" FROM energy WHERE energized IS NULL GROUP BY type""", _LIVE)),
    ("out_by_feeder", "FIND loads WHERE NOT energized OR energized IS MISSING SELECT feeder, energized, COUNT(*), SUM(kw) GROUP BY feeder, energized", _sql("""SELECT feeder, energized, count(*) AS "COUNT(*)", sum(kw) AS "SUM(kw)" FROM energy WHERE type = 'load' AND energized IS DISTINCT FROM true GROUP BY feeder, energized""", _LIVE)),
    ("feeder_energized", "FIND feeders SELECT mrid, energized", _sql("SELECT concat('FDR-', n_nationkey) AS mrid, n_nationkey % 8 <> 5 AS energized FROM nation")),
]


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: execute(network(spark, sf_dir), text).frame


def _script(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "PARAM feeder = 'FDR-1'; PARAM least; FIND transformers DOWNSTREAM OF $feeder WHERE kva >= $least SELECT mrid, kva ORDER BY kva DESC LIMIT 10"
    return execute_script(network(spark, sf_dir), text, {"feeder": "FDR-2", "least": "100kVA"})[0].frame


def _switched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reclosers of two feeders open: what is left without power by feeder."""
    net = network(spark, sf_dir)
    changes = net.objects.where("type = 'recloser' and feeder in ('FDR-1', 'FDR-2')").selectExpr("mrid", "'OPEN' as state")
    return execute(net.with_state(changes), "FIND loads WHERE energized SELECT feeder, COUNT(*) GROUP BY feeder").frame


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from wattframe.catalog_more import MORE

    return {name: _query(text) for name, text, _ in _QUERIES} | {"param_bound_script": _script, "state_change_recompute": _switched} | {k: f for k, (f, _) in MORE.items()}


def oracle_sql() -> dict[str, str]:
    from wattframe.catalog_more import MORE

    switched = DEVICES.replace("s_suppkey % 10 = 3", "s_suppkey % 10 = 3 OR s_nationkey IN (1, 2)")
    return {name: sql for name, _, sql in _QUERIES if sql} | {
        "param_bound_script": _sql("SELECT mrid, kva FROM dev WHERE type = 'transformer' AND feeder = 'FDR-2' AND kva >= 100 ORDER BY kva DESC, mrid LIMIT 10"),
        "state_change_recompute": f"""WITH RECURSIVE {switched}, {_LIVE} SELECT feeder, count(*) AS "COUNT(*)" FROM energy WHERE type = 'load' AND energized GROUP BY feeder""",
    } | {k: sql for k, (_, sql) in MORE.items() if sql}
