"""Switch operations as a stream: which devices are live after each batch, and how often switches act.

Events are rows ``(mrid string, state string, at timestamp)``. They may come late and in any order: per switch the state with
the latest time counts, and of events at one time the greater state (OPEN over CLOSED).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wattframe.network import Network
from wattframe.operators.storage import drop_stored


def latest(events: DataFrame) -> DataFrame:
    """``mrid, state, at``: the last event of each switch, by a partial aggregate."""
    rows = events.where("mrid is not null and at is not null and upper(state) in ('OPEN', 'CLOSED')")
    return rows.groupBy("mrid").agg(F.max(F.struct("at", F.upper("state").alias("state"))).alias("e")).select("mrid", "e.state", "e.at")


def follow(net: Network, events: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """After each batch write ``folder/energized/batch=N`` (``mrid, energized``) and ``folder/states/batch=N`` (the last state of every switch seen).

    A batch reads the states that the batch before it wrote and overwrites its own folders, so a repeated batch gives the
    same result. Restart with the same folder goes on where it ended. The feeders' trees follow normal states and stay.
    """
    spark = net.spark
    states = f"{folder}/states"

    def apply(batch: DataFrame, number: int) -> None:
        now = latest(batch)
        if number:
            old = spark.read.schema(now.schema).parquet(f"{states}/batch={number - 1}")
            now = latest(old.unionByName(now))
        now.write.mode("overwrite").parquet(f"{states}/batch={number}")
        after = net.with_state(spark.read.schema(now.schema).parquet(f"{states}/batch={number}").select("mrid", "state"))
        after.energy.write.mode("overwrite").parquet(f"{folder}/energized/batch={number}")
        drop_stored(after.energy)

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", f"{folder}/progress").trigger(**(trigger or {"availableNow": True})).start()


def operations(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``start, mrid, n, opened``: operations of each switch by window; events later than the watermark are not counted."""
    on = events.withWatermark("at", late).groupBy(F.window("at", window).alias("w"), "mrid")
    counted = on.agg(F.count("*").alias("n"), F.sum(F.when(F.upper("state") == "OPEN", 1).otherwise(0)).alias("opened"))
    return counted.select(F.col("w.start").alias("start"), "mrid", "n", "opened")
