"""Sharding by fixed virtual slots and a versioned slot-to-shard map, in DataFrame operations only.

Every record hashes into one of ``SLOTS`` virtual slots, for good. Bytes and rows are aggregated per slot (a partial
aggregate: at most ``SLOTS`` rows leave a task), and the map from slots to shards is a table of ``SLOTS`` rows that is
edited, version by version, when shards come, go or drift apart. Records never move unless their slot does. The map is
the only thing that the driver holds, and its size is fixed.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattframe.operators.storage import shared_folder

SLOTS = 8192


def record_sizes(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot`` of each row. A null text has no bytes and the checksum of none."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    ).withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def slot_loads(records: DataFrame) -> DataFrame:
    """``virtual_slot, bytes, rows``."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def first_map(loads: dict[int, int], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Slots by falling bytes, each to the shard with the least so far; empty slots are dealt round."""
    heap = [(0, s) for s in range(shards)]
    chosen = {}
    for slot in sorted((x for x in loads if loads[x]), key=lambda x: (-loads[x], x)):
        held, s = heapq.heappop(heap)
        chosen[slot] = s
        heapq.heappush(heap, (held + loads[slot], s))
    for k, slot in enumerate(x for x in range(slots) if x not in chosen):
        chosen[slot] = k % shards
    return chosen


def rebalanced(mapping: dict[int, int], loads: dict[int, int], shards: int, tolerance: float = 0.01) -> dict[int, int]:
    """The next version of a map: slots of shards that are gone are dealt out, then the fullest shard gives slots to the emptiest until all lie within ``tolerance`` of the mean, or no single move helps. Slots that need not move stay."""
    new = dict(mapping)
    held = dict.fromkeys(range(shards), 0)
    mine: dict[int, list[int]] = {s: [] for s in range(shards)}
    lost = []
    for slot in sorted(new):
        s = new[slot]
        if s in held:
            held[s] += loads.get(slot, 0)
            mine[s].append(slot)
        else:
            lost.append(slot)
    for slot in sorted(lost, key=lambda x: (-loads.get(x, 0), x)):
        s = min(held, key=lambda x: (held[x], x))
        new[slot] = s
        held[s] += loads.get(slot, 0)
        mine[s].append(slot)
    mean = sum(held.values()) / shards
    for _ in range(4 * len(new)):
        high, low = max(held, key=lambda x: (held[x], -x)), min(held, key=lambda x: (held[x], x))
        if max(held[high] - mean, mean - held[low]) <= tolerance * mean:
            break
        gap = held[high] - held[low]
        fits = [x for x in mine[high] if 0 < loads.get(x, 0) < gap]
        if not fits:
            break
        slot = min(fits, key=lambda x: (abs(2 * loads[x] - gap), x))
        mine[high].remove(slot)
        mine[low].append(slot)
        held[high] -= loads[slot]
        held[low] += loads[slot]
        new[slot] = low
    return new


def save_map(spark: SparkSession, mapping: dict[int, int], version: int, folder: str) -> DataFrame:
    """Store one version of the map as a table of its own and read it back."""
    path = f"{folder}/version={version}"
    spark.createDataFrame(sorted(mapping.items()), "virtual_slot int, shard int").coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.schema("virtual_slot int, shard int").parquet(path)


def load_map(spark: SparkSession, folder: str, version: int) -> dict[int, int]:
    return {r.virtual_slot: r.shard for r in spark.read.parquet(f"{folder}/version={version}").collect()}


def sharded(docs: DataFrame, shards: int = 40, slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot`` for each row, under the law ``bytes``.

    ``slot`` is the row's place in its shard, gapless from 0. Equal texts are spread, as the hash covers ``doc_id``;
    rows that repeat in full share a virtual slot but each has its own place. Null ids and texts are records like any
    other (16 bytes). Only ``doc_id`` and ``text`` are read. An empty table gives an empty result.
    """
    import uuid

    spark = docs.sparkSession
    records = record_sizes(docs, slots)
    loads = slot_loads(records).collect()  # at most one row per slot
    mapping = first_map({r.virtual_slot: r.bytes for r in loads}, shards, slots)
    rows = {r.virtual_slot: r.rows for r in loads}
    before, start = dict.fromkeys(range(shards), 0), {}
    for slot in range(slots):
        s = mapping[slot]
        start[slot] = before[s]
        before[s] += rows.get(slot, 0)
    save_map(spark, mapping, 1, folder or f"{shared_folder(spark)}/shard-map-{uuid.uuid4().hex}")
    table = spark.createDataFrame([(x, mapping[x], start[x]) for x in range(slots)], "virtual_slot int, shard int, start long")
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32"))
    return (
        records.withColumn("place", place)
        .join(F.broadcast(table), "virtual_slot")
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
    )
