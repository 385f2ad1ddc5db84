"""Token ids as compressed binary: a context-mixing range coder in independent, checksummed blocks.

A chunk holds whole documents: their ids, sizes, an order-0 table (how often each id occurs in the chunk, scaled) and
blocks of ``BLOCK`` consecutive ids. Every block starts from the same reset state and can be decoded with the table alone. The
probability of the next id mixes three predictions: the order-0 table, the id that last followed the previous id, and the
id that last followed the previous two. The last two are learnt as the block goes on, and each is weighted by how often its
entry has been right; the mixture drives a range coder that counts in whole numbers held by doubles. A block ends in a
checksum of its ids.

The coder is sequential within a block, so up to ``LANES`` blocks of a chunk advance together, one id each per step, as vectors.
Chunks are rows of a Parquet table in the folder that the cluster shares: any store that Spark can write will do.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattframe.llm.texts import tidy
from wattframe.llm.tokens import encoder
from wattframe.operators.storage import shared_folder

#: Ids of a block; blocks that advance together.
BLOCK, LANES = 4096, 2048
#: The order-0 table's total; sizes of the order-1 and order-2 tables; an entry of confidence ``c`` weighs ``2 ** c - 1`` times this.
TOTAL, ONE, TWO, WEIGHT = 1 << 17, 1 << 10, 1 << 11, 3500
#: The range coder counts in whole numbers below 2 ** 49, which doubles hold exactly; so are its quotients, for totals below 2 ** 20.
_TOP, _LEAST, _DIGIT = 2.0**48, 2.0**32, 2.0**16
#: By an entry's confidence if it was right, and by 8 more if it was wrong: what it changes by, and whether (-1) the id that came replaces its own.
_CHANGE = np.array([1] * 7 + [0] + [1, 1] + [-(c + 1 >> 1) for c in range(2, 8)], np.int32)
_REPLACED = np.array([0] * 8 + [-1, -1] + [0] * 6, np.int32)


class BrokenBlock(ValueError):
    """A block's ids do not have its checksum."""


def frequency_table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(ids, frequencies)`` of the ids that occur; the frequencies are at least 1 and sum to ``TOTAL``."""
    found, count = np.unique(ids, return_counts=True)
    if len(found) > TOTAL // 2:
        raise ValueError("too many different ids")
    f = np.maximum(1, count * (TOTAL - len(found)) // max(1, len(ids)))
    if len(f):
        f[f.argmax()] += TOTAL - f.sum()
    return found.astype(np.uint32), f.astype(np.uint32)


class _Model:
    """Order-1 and order-2 predictions of ``lanes`` blocks at one step, in two rows; ids are ranks in the chunk's table. An entry is ``8 * rank + confidence``."""

    def __init__(self, lanes: int):
        self.table = np.zeros(lanes * (ONE + TWO), np.int32)
        self.base = np.stack([np.arange(lanes) * ONE, lanes * ONE + np.arange(lanes) * TWO])

    def places(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Where the entries after these ids are; the last axis counts lanes."""
        mixed = np.empty((*last.shape[:-1], 2, last.shape[-1]), np.int32)
        one, two = mixed[..., 0, :], mixed[..., 1, :]
        np.multiply(last, np.int32(4051), out=one)
        np.add(one, before * np.int32(3001), out=two)
        one >>= np.int32(4)
        one &= np.int32(ONE - 1)
        two >>= np.int32(3)
        two &= np.int32(TWO - 1)
        return mixed + self.base[:, : last.shape[-1]]

    def learn(self, at: np.ndarray, e: np.ndarray, s8: np.ndarray) -> None:
        """``s8`` is 8 times the id that came."""
        way = e & np.int32(7)
        way |= np.int32(8)
        new = e ^ s8
        way = np.minimum(way, new).astype(np.int64)  # the confidence if right, else 8 more
        new &= _REPLACED.take(way)
        new ^= e
        new += _CHANGE.take(way)
        self.table[at] = new


# Which lanes a choice falls on cannot be foreseen by a processor: ``np.where`` is several times slower on it than arithmetic or ``take``.


def _weights(e: np.ndarray) -> np.ndarray:
    """Weights of the two candidates; the second has none where it is the first."""
    w = np.left_shift(np.int32(WEIGHT), e & np.int32(7))
    w -= np.int32(WEIGHT)
    w[..., 1, :] *= (e[..., 0, :] ^ e[..., 1, :]) > 7
    return w


def _spans(e: np.ndarray, s: np.ndarray, s8: np.ndarray, f: np.ndarray, cum: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, freq, total)``: first the order-1 candidate's weight, then the order-2 candidate's, then the table."""
    w = _weights(e)
    wa, wb = w[..., 0, :], w[..., 1, :]
    both, right = wa + wb, ((e ^ s8[..., None, :]) < 8) & (w > 0)
    is_a, other = right[..., 0, :], ~right.any(axis=-2)
    s = s.astype(np.int64)
    start, freq = cum.take(s), f.take(s)
    start += wb
    start *= other
    start += wa
    start *= ~is_a
    freq *= other
    freq += wb * right[..., 1, :]
    freq += wa * is_a
    both += np.int32(TOTAL)
    return start.astype(float), freq.astype(float), both.astype(float)


def encode_blocks(ranks: np.ndarray, f: np.ndarray, block: int = BLOCK) -> list[bytes]:
    """The payload of each block of ``block`` consecutive ranks (the last may be shorter)."""
    n = len(ranks)
    lanes = -(-n // block)
    if not lanes:
        return []
    f = f.astype(np.int32)
    cum = np.cumsum(f, dtype=np.int32) - f
    ids = np.zeros(lanes * block, np.int32)
    ids[:n] = ranks
    ids = ids.reshape(lanes, block)
    steps, short = min(n, block), n - (lanes - 1) * block
    model = _Model(lanes)
    out = np.zeros(lanes * (3 * block // 2 + 8), np.int32)
    begin = np.arange(lanes) * (3 * block // 2 + 8)
    lows, places = np.zeros(lanes), begin.copy()
    low, place, width = lows, places, np.full(lanes, _TOP)
    none = np.zeros((2, lanes), np.int32)
    few = max(1, (1 << 16) // lanes)
    for t0 in range(0, steps, few):
        t1 = min(steps, t0 + few)
        s = np.ascontiguousarray(ids[:, t0:t1].T)
        past = np.concatenate([none, s])
        at = model.places(past[1 : 1 + len(s)], past[: len(s)])
        none = past[-2:]
        e, s8 = np.empty(at.shape, np.int32), s << np.int32(3)
        for t in range(len(s)):
            e[t] = model.table[at[t]]
            model.learn(at[t], e[t], s8[t])
        start, freq, total = _spans(e, s, s8, f, cum)
        for t in range(len(s)):
            if t0 + t == short:  # the last block has ended
                low, width, place = low[:-1], width[:-1], place[:-1]
            m = len(low)
            r = np.floor(width / total[t, :m])
            low += r * start[t, :m]
            np.multiply(r, freq[t, :m], out=width)
            # What a lane writes counts only if its place moves on.
            small = width < _LEAST
            digit = np.floor(low * (1 / _LEAST))
            out[place] = digit
            place += small
            digit *= small
            digit *= _LEAST
            low -= digit
            times = small * (_DIGIT - 1)
            times += 1
            low *= times
            width *= times
            again = np.flatnonzero(width < _LEAST)
            while len(again):
                digit = np.floor(low[again] * (1 / _LEAST))
                out[place[again]] = digit
                place[again] += 1
                low[again] = (low[again] - digit * _LEAST) * _DIGIT
                width[again] *= _DIGIT
                again = again[width[again] < _LEAST]
    for _ in range(4):
        digit = np.floor(lows * (1 / _LEAST))
        out[places] = digit
        places += 1
        lows = (lows - digit * _LEAST) * _DIGIT
    size = places - begin
    # A digit may carry into those before it.
    out = out.reshape(lanes, -1)[:, : size.max()].copy()
    out *= np.arange(out.shape[1]) < size[:, None]
    while len(over := np.flatnonzero(out > 0xFFFF)):
        out.ravel()[over] &= 0xFFFF
        out.ravel()[over - 1] += 1
    out = out.astype(">u2")
    return [out[k, : size[k]].tobytes() for k in range(lanes)]


def decode_blocks(payloads: list[bytes], n: int, f: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The ``n`` ranks of blocks made by :func:`encode_blocks`."""
    lanes = len(payloads)
    if not lanes:
        return np.zeros(0, np.int64)
    short = n - (lanes - 1) * block
    room = max(map(len, payloads)) // 2 + 2 * 8
    data = np.zeros((lanes, room), np.uint16)
    for k, p in enumerate(payloads):
        data[k, : len(p) // 2] = np.frombuffer(p, ">u2")
    slot = np.repeat(np.arange(len(f), dtype=np.int32), f)
    f = f.astype(float)
    cum = np.cumsum(f) - f
    model = _Model(lanes)
    width, code = np.full(lanes, _TOP), data[:, :3] @ np.array([_LEAST, _DIGIT, 1.0])
    data = data.ravel()
    at, end = np.arange(lanes) * room + 3, np.arange(1, lanes + 1) * room - 1
    steps, few = min(block, n), max(1, (1 << 16) // lanes)
    ids, run = np.zeros((lanes, block), np.int32), np.zeros((few, lanes), np.int32)
    last = before = np.zeros(lanes, np.int32)
    m = 0
    for t in range(steps):
        if t == short:  # the last block has ended
            width, code, at, end, last, before = (x[:-1] for x in (width, code, at, end, last, before))
        if m != len(width):
            # Three rows: the order-1 candidate, the order-2 candidate, the table.
            m = len(width)
            lane = np.arange(m)
            start, freq, came = np.zeros((3, m)), np.zeros((3, m)), np.zeros((3, m), np.int32)
        entry = model.places(last, before)
        e = came[:2]
        model.table.take(entry, out=e, mode="clip")
        w = freq[:2]
        w[:] = _weights(e)
        start[1] = w[0]
        both = w[0] + w[1]
        r = width / (both + TOTAL)
        np.floor(r, out=r)
        target = code / r
        np.floor(target, out=target)
        row = (target >= w[0]).view(np.int8) + (target >= both).view(np.int8)
        target -= both
        s = slot.take(target.astype(np.int64), mode="clip")  # out of range for the candidates and in broken blocks only
        wide = s.astype(np.int64)
        np.add(both, cum.take(wide), out=start[2])
        f.take(wide, out=freq[2], mode="clip")
        np.left_shift(s, np.int32(3), out=came[2])
        row = row.astype(np.int64)
        row *= m
        row += lane
        s8 = came.take(row)
        s8 &= np.int32(-8)
        code -= start.take(row) * r
        np.multiply(r, freq.take(row), out=width)
        small = width < _LEAST
        times = small * (_DIGIT - 1)
        times += 1
        code *= times
        width *= times
        code += data.take(at) * small
        at += small
        again = np.flatnonzero(width < _LEAST)
        while len(again):
            place = at[again]
            if (place >= end[again]).any():
                raise IndexError
            code[again] = code[again] * _DIGIT + data[place]
            width[again] = more = width[again] * _DIGIT
            at[again] = place + 1
            again = again[more < _LEAST]
        model.learn(entry, e, s8)
        k = t % few
        before, last = last, s8 >> np.int32(3)
        run[k, :m] = last
        if k == few - 1 or t == steps - 1:
            ids[:, t - k : t + 1] = run[: k + 1].T
    return ids.ravel()[:n]


def encode_chunk(ids: np.ndarray, block: int = BLOCK) -> tuple[bytes, list[bytes]]:
    """``(table, frames)`` of a chunk; a frame is its payload, the number of its ids and their checksum."""
    names, f = frequency_table(ids)
    rank = np.zeros(int(names[-1]) + 1 if len(names) else 0, np.int32)
    rank[names] = np.arange(len(names))
    ranks, some = rank[ids], block * LANES
    payloads = [p for k in range(0, len(ids), some) for p in encode_blocks(ranks[k : k + some], f, block)]
    raw = ids.astype("<u4")
    ends = [np.array([len(x), zlib.crc32(x.tobytes())], "<u4").tobytes() for x in (raw[k : k + block] for k in range(0, len(ids), block))]
    return zlib.compress(np.concatenate([names, f]).astype("<u4").tobytes(), 1), [p + e for p, e in zip(payloads, ends)]


def decode_chunk(table: bytes, frames: list[bytes], block: int = BLOCK) -> np.ndarray:
    """The ids of a chunk; raises :class:`BrokenBlock` if a checksum fails."""
    both = np.frombuffer(zlib.decompress(table), "<u4")
    names, f = both[: len(both) // 2], both[len(both) // 2 :]
    ends = [np.frombuffer(x[-8:], "<u4") for x in frames]
    try:
        with np.errstate(all="ignore"):
            runs = [decode_blocks([x[:-8] for x in frames[k : k + LANES]], int(sum(e[0] for e in ends[k : k + LANES])), f, block) for k in range(0, len(frames), LANES)]
    except IndexError as e:
        raise BrokenBlock("no id there") from e
    ids = names[np.concatenate(runs)].astype("<u4") if frames else np.zeros(0, "<u4")
    for k, e in enumerate(ends):
        if zlib.crc32(ids[k * block : k * block + int(e[0])].tobytes()) != e[1]:
            raise BrokenBlock(f"block {k}")
    return ids


_CHUNK = "part int, chunk int, first long, n_ids long, doc_ids array<long>, sizes array<int>, table binary, frames array<binary>"


def write(docs: DataFrame, path: str, folder: str, end: int = 0) -> None:
    """Encode all documents in ascending order of ``doc_id`` (nulls first, rows of one id by their texts' hash) into a table of chunks."""

    def encode(batches):
        enc = encoder(path, spaced=True)
        part, chunk, first = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        names: list = []
        sizes: list[int] = []
        waiting = 0

        def flush():
            nonlocal held, names, sizes, waiting, chunk, first
            ids = np.concatenate(held)
            held = []
            table, frames = encode_chunk(ids)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([table], pa.binary()), pa.array([frames], pa.list_(pa.binary()))], ["part", "chunk", "first", "n_ids", "doc_ids", "sizes", "table", "frames"])
            chunk, first = chunk + 1, first + len(ids)
            held, names, sizes, waiting = [], [], [], 0
            return row

        for batch in batches:
            own = batch.column(0).to_pylist()
            for lo, hi, ids, offs in enc.runs(batch.column(1)):
                size = np.diff(offs) + 1
                closes = np.zeros(len(ids) + hi - lo, bool)
                closes[np.cumsum(size) - 1] = True
                whole = np.full(len(closes), end, np.uint32)
                whole[~closes] = ids
                held.append(whole)
                names += own[lo:hi]
                sizes += size.tolist()
                waiting += len(whole)
                if waiting >= BLOCK * LANES:
                    yield flush()
        if names:
            yield flush()

    # The ranges are of ids alone: sampling them with the texts' hashes would read all texts twice.
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(tidy(encode), _CHUNK).write.option("compression", "none").parquet(folder)


def read(spark, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone."""
    chunks = spark.read.schema(_CHUNK).parquet(folder)
    parts = chunks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("part", before.alias("before"))  # a row for each file

    def decode(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = decode_chunk(r["table"], r["frames"])
                ends = np.cumsum(r["sizes"])
                starts = ends - r["sizes"]
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]] * len(ends), pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(starts + r["first"], pa.int64()), pa.array(r["sizes"], pa.int64()), pa.array(crc, pa.int64())], ["part", "doc_id", "local", "n_tokens", "ids_crc32"])

    docs = chunks.select("part", "first", "doc_ids", "sizes", "table", "frames").mapInArrow(tidy(decode), "part int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(offsets), "part").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Write all documents and read them back: ``doc_id, start, n_tokens, ids_crc32``.

    A null or empty text is one end mark. Repeated rows are written as often as they occur, in a run; null ids come
    first; rows of one ``doc_id`` stand in the order of their texts' hashes. Other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    write(docs, path, folder)
    return read(spark, folder)
