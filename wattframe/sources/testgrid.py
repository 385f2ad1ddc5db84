"""A network out of star-schema tables, by one SQL text that Spark and DuckDB run alike.

Regions are substations, nations feeders with a breaker and a tie to the next, suppliers reclosers, customers fuses,
orders transformers, their lines loads, and small parts generators.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wattframe.network import Network, normalized
from wattframe.operators.storage import stored

TABLES = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem")

#: Devices with their nodes ``n1`` and ``n2``, and the ``parent`` that the feeder's tree gives them. Used by the oracles too.
DEVICES = """
sup AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS r, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier),
per AS (SELECT s_nationkey AS k, max(n) AS n FROM sup GROUP BY s_nationkey),
cust AS (SELECT c.c_custkey, c.c_nationkey, c.c_acctbal, s.s_suppkey FROM customer c LEFT JOIN per p ON p.k = c.c_nationkey LEFT JOIN sup s ON s.s_nationkey = c.c_nationkey AND s.r = c.c_custkey % p.n),
line AS (SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS k FROM lineitem l),
total AS (SELECT count(*) AS n FROM customer),
dev AS (
SELECT concat('BRK-', n_nationkey) AS mrid, 'breaker' AS type, concat('FDR-', n_nationkey) AS feeder, concat('SUB-', n_regionkey) AS substation, 'CLOSED' AS normal_state, CASE WHEN n_nationkey % 8 = 5 THEN 'OPEN' ELSE 'CLOSED' END AS state, false AS is_tie, CAST(NULL AS double) AS kva, CAST(NULL AS double) AS kw, CAST(NULL AS varchar(20)) AS kind, concat('S-', n_nationkey) AS n1, concat('B-', n_nationkey) AS n2, CAST(NULL AS varchar(40)) AS parent, CAST(NULL AS varchar(20)) AS x_priority, CAST(NULL AS varchar(20)) AS x_status, CAST(NULL AS varchar(20)) AS x_flag FROM nation
UNION ALL SELECT concat('TIE-', n_nationkey), 'switch', concat('FDR-', n_nationkey), concat('SUB-', n_regionkey), 'OPEN', CASE WHEN n_nationkey % 6 = 0 THEN 'CLOSED' ELSE 'OPEN' END, true, NULL, NULL, NULL, concat('B-', n_nationkey), concat('B-', (n_nationkey + 1) % 25), concat('BRK-', n_nationkey), NULL, NULL, NULL FROM nation
UNION ALL SELECT concat('REC-', s_suppkey), 'recloser', concat('FDR-', s_nationkey), concat('SUB-', n_regionkey), 'CLOSED', CASE WHEN s_suppkey % 10 = 3 THEN 'OPEN' ELSE 'CLOSED' END, false, NULL, NULL, NULL, concat('B-', s_nationkey), concat('R-', s_suppkey), concat('BRK-', s_nationkey), NULL, NULL, NULL FROM supplier JOIN nation ON n_nationkey = s_nationkey
UNION ALL SELECT concat('FU-', c_custkey), 'fuse', concat('FDR-', c_nationkey), concat('SUB-', n_regionkey), 'CLOSED', CASE WHEN c_acctbal < -900 THEN 'OPEN' ELSE 'CLOSED' END, false, NULL, NULL, NULL, CASE WHEN s_suppkey IS NULL THEN concat('B-', c_nationkey) ELSE concat('R-', s_suppkey) END, concat('C-', c_custkey), CASE WHEN s_suppkey IS NULL THEN concat('BRK-', c_nationkey) ELSE concat('REC-', s_suppkey) END, NULL, NULL, NULL FROM cust JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT concat('TX-', o_orderkey), 'transformer', concat('FDR-', c_nationkey), concat('SUB-', n_regionkey), NULL, NULL, NULL, CAST(floor(o_totalprice / 1000) AS double), NULL, NULL, concat('C-', o_custkey), concat('T-', o_orderkey), concat('FU-', o_custkey), o_orderpriority, o_orderstatus, NULL FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT concat('LD-', l_orderkey, '-', k), 'load', concat('FDR-', c_nationkey), concat('SUB-', n_regionkey), NULL, NULL, NULL, NULL, CAST(floor(l_quantity) AS double), NULL, concat('T-', l_orderkey), NULL, concat('TX-', l_orderkey), NULL, NULL, l_returnflag FROM line JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT concat('PV-', p_partkey), 'generator', concat('FDR-', c_nationkey), concat('SUB-', n_regionkey), NULL, NULL, NULL, NULL, CAST(floor(p_retailprice / 10) AS double), CASE p_partkey % 3 WHEN 0 THEN 'pv' WHEN 1 THEN 'storage' ELSE 'synchronous' END, concat('C-', p_partkey % total.n), NULL, concat('FU-', p_partkey % total.n), NULL, NULL, NULL FROM part CROSS JOIN total JOIN customer ON c_custkey = p_partkey % total.n JOIN nation ON n_nationkey = c_nationkey WHERE p_size <= 5
)"""


def grid(spark: SparkSession, sf_dir: str) -> Network:
    """The network of one folder of tables."""
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    # Stored, as objects and terminals are both made of it: the driver never holds a plan that has all these joins twice.
    devices = stored(spark.sql(f"WITH {DEVICES.replace('varchar(20)', 'string').replace('varchar(40)', 'string')} SELECT * FROM dev"), "devices")
    rest = spark.sql(
        """SELECT concat('FDR-', n_nationkey) AS mrid, n_name AS name, 'feeder' AS type, concat('SUB-', n_regionkey) AS substation, concat('BRK-', n_nationkey) AS head FROM nation
        UNION ALL SELECT concat('SUB-', r_regionkey), r_name, 'substation', NULL, NULL FROM region"""
    )
    objects = normalized(devices.drop("n1", "n2", "parent").unionByName(rest, allowMissingColumns=True))
    ends = devices.select("mrid", F.posexplode(F.array("n1", "n2")).alias("seq", "node")).where("node is not null")
    return Network(objects, ends, spark.createDataFrame([], "a string, b string"), source=sf_dir)
