"""Best-fit decreasing packing of token sequences.

Best-fit decreasing sees nothing of a document but its length, and a length is a whole number up to the capacity. So the
plan is made from the histogram of lengths, whose size does not depend on the input: lengths fall, and each goes into
the tightest open bin, found in logarithmic time by a segment tree over remaining capacities. Bins with one history are
kept as a run, and a whole run is filled in one step, which gives exactly the bins of the document-by-document method.
Each document then finds its bin by its rank among those of its length: ranks are made from counts per (length, bucket),
so no length, however common, is gathered in one task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattframe.llm.texts import tidy
from wattframe.llm.tokens import encoder
from wattframe.operators.storage import stored

CAPACITY, END = 4096, 1
#: Pieces per bucket in which ranks are counted.
PER_BUCKET = 10_000


class CapacityTree:
    """A segment tree over remaining capacities: which is the least that is open and at least so large?"""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = bytearray(2 * self.size)

    def set(self, capacity: int, is_open: bool) -> None:
        at = capacity + self.size
        self.open[at] = is_open
        while at > 1:
            at >>= 1
            now = self.open[2 * at] | self.open[2 * at + 1]
            if self.open[at] == now:
                break
            self.open[at] = now

    def tightest(self, least: int) -> int | None:
        at = least + self.size
        if self.open[at]:
            return least
        while at > 1:
            if not at & 1 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """``(length, first rank, per bin, first bin, offset)``: from that rank on, documents of the length fill bins in turn, so many in each from that offset."""
    tree, runs = CapacityTree(capacity), {}
    steps, bins = [], 0

    def push(capacity_left: int, first: int, n: int) -> None:
        if capacity_left:
            runs.setdefault(capacity_left, []).append((first, n))
            tree.set(capacity_left, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            r = tree.tightest(length)
            if r is None:
                r, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = runs[r].pop()
                if not runs[r]:
                    tree.set(r, False)
            per = r // length
            full = min(n, left // per)
            if full:
                steps.append((length, rank, per, first, capacity - r))
                push(r - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if full < n:
                if left and left < per:
                    steps.append((length, rank, left, first + full, capacity - r))
                    push(r - left * length, first + full, 1)
                    rank, left, full = rank + left, 0, full + 1
                if full < n:
                    push(r, first + full, n - full)
    return steps


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: the ids of each document with its end mark, cut where longer than the capacity."""

    def cut(batches):
        enc = encoder(path, spaced=False)
        for batch in batches:
            for lo, hi, ids, offs in enc.runs(batch.column(1)):
                rows = []
                for d in range(hi - lo):
                    own = np.append(ids[offs[d] : offs[d + 1]], np.uint32(end)).astype("<u4")
                    for k, at in enumerate(range(0, len(own), capacity)):
                        part = own[at : at + capacity]
                        rows.append((lo + d, k, at, len(part), zlib.crc32(part.tobytes())))
                row, k, at, n, crc = map(np.array, zip(*rows))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *(pa.array(x, t) for x, t in ((k, pa.int32()), (at, pa.int64()), (n, pa.int64()), (crc, pa.int64())))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(tidy(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def packed(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (with a ``length`` from 1 to the capacity; ``doc_id``, ``piece`` and ``start`` tell rows apart) with ``sequence_id`` and ``offset``."""
    total = parts.count()
    buckets = max(1, total // PER_BUCKET)
    dealt = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = stored(sizes.withColumn("before", before), "packing-sizes")
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most one row per length
    steps = np.array(plan(counts, capacity), np.int64).reshape(-1, 5)
    keys = (steps[:, 0] << 40) + steps[:, 1]
    order = np.argsort(keys)
    steps, keys = steps[order], keys[order]
    place = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = dealt.withColumn("place", place).join(sizes.drop("n").hint("merge"), ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("place") - 1)

    def put(batches):
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = steps[np.searchsorted(keys, (length << 40) + rank, "right") - 1] if len(keys) else steps
            j = rank - at[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(at[:, 3] + j // at[:, 2]), pa.array(at[:, 4] + j % at[:, 2] * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(tidy(put), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of all documents with their places: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is one piece of one end mark. Repeated rows are packed as often as they occur; a null ``doc_id``
    is kept. Extra columns are not read. An empty table gives an empty result.
    """
    return packed(stored(pieces(docs, path, capacity, end), "packing-pieces"), capacity)
