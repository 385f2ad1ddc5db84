"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations and two joins on the vertex, so no group is gathered in one task: a hub's minimum
is a partial aggregate, and its edges are an ordinary join that adaptive execution may split. The number of rounds
is logarithmic in practice. Every round ends in a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from wattframe.operators.storage import drop_stored, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    across = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return across.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``(vertex, component)`` for every end of an edge; the component is the smallest vertex in reach.

    Nulls at either end and self-loops are ignored (a vertex with only a self-loop does not appear); an empty
    input gives an empty result. Raises if ``max_rounds`` do not suffice.
    """
    now = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        # The edges are distinct: their number and the exclusive or of their hashes tell whether a round has changed them. Both are seen while they are written.
        seen = Observation()
        new = stored(_small_star(_large_star(now)).observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("hash")), "stars")
        said = seen.get["n"], seen.get["hash"]
        drop_stored(now)
        now = new
        if said == state:
            return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("vertex"), F.col("v").alias("component"))).distinct()
        state = said
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
