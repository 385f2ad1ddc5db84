"""Exact removal of repeated byte strings, by column-wise suffix sorting of many documents.

A string of ``length`` bytes that starts twice anywhere has the same smallest ``k``-gram hash in both places, at the same
offset. Those anchors are selected in one pass, and an anchor that occurs once is dropped. An anchor's context is all
the strings of ``length`` bytes that hold it. Where all contexts of an anchor are equal, everything in them repeats.
Elsewhere one copy of each distinct context enters a suffix sort:

the contexts, aligned at their anchor, form a collection of short documents. Every round inserts one symbol for each
document, from the last column to the first: the symbols in the present order are the column's segment of the collection's
Burrows-Wheeler transform, a stable sort by symbol gives the next order, and the common prefix of two neighbours grows by
one where they stay neighbours. Neighbours in a column with a common prefix of ``length`` are repeats. Partitions of
anchors stand in for the sequential external files of the construction: each holds whole groups, is read in bounded
batches and sorted independently, so nothing depends on the size of the collection. An anchor with more than ``HOT``
distinct contexts is not gathered in a batch: its strings are counted by hash in a distributed aggregate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.llm.texts import mix, slabs, tidy
from wattframe.operators.storage import drop_stored, stored

#: Bytes of an anchor at most.
GRAM = 50
#: Distinct contexts of one anchor beyond which they are compared by a distributed aggregate, and contexts in one batch of the sort.
HOT, BATCH = 20_000, 20_000
#: Bytes of a long text that are looked at together.
SEGMENT = 1 << 18
FILTER_BITS = 1 << 23

_BYTE = np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64)
_P = 0xD6E8FEB86659FD93
_Q = pow(_P, -1, 1 << 64)


class _Hashes:
    """Hashes of substrings of a slab from prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _P, np.uint64)]))
        self.back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _Q, np.uint64)]))
        self.sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[:-1], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.back[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        return mix((self.sum[k:] - self.sum[:-k]) * self.back[: len(self.sum) - k])


def _sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    """``f`` over every ``w`` neighbours."""
    size = 1
    while 2 * size <= w:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def anchors(data: np.ndarray, offs: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, context hash, document, place in it)`` of the anchors of each document of a slab."""
    n, w = len(data), length - k + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none
    hashes = _Hashes(data)
    h = np.maximum(hashes.grams(k), np.uint64(1))
    least = _sliding(h, w, np.minimum)
    starts = offs[1:-1]
    bad = np.zeros(len(least) + 1, np.int64)  # strings that cross the end of a document
    np.add.at(bad, np.maximum(starts - length + 1, 0).clip(max=len(least)), 1)
    np.add.at(bad, starts.clip(max=len(least)), -1)
    least[np.cumsum(bad)[:-1] > 0] = 0
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    at = np.flatnonzero(_sliding(padded, w, np.maximum)[: len(h)] == h)
    doc = np.searchsorted(offs, at, "right") - 1
    lo, hi = np.maximum(at - (length - k), offs[doc]), np.minimum(at + length, offs[doc + 1])
    context = mix(hashes.of(lo, hi) + (at - lo).astype(np.uint64))
    return h[at].view(np.int64), context.view(np.int64), doc, at - offs[doc]


def _anchors_of(data: np.ndarray, offs: np.ndarray, length: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """:func:`anchors`, a long text by overlapping segments; of an anchor in two of them the first counts in which its context is whole."""
    n, step = len(data), max(SEGMENT - 4 * length, 1)
    if n <= SEGMENT or len(offs) > 2:
        yield anchors(data, offs, length, k)
        return
    last = -1
    for a in range(0, max(1, n - 4 * length), step):
        b = min(n, a + step + 4 * length)
        h, context, doc, at = anchors(data[a:b], np.array([0, b - a]), length, k)
        at = at + a
        own = (at > last) & ((at - (length - k) >= a) | (a == 0)) & ((at + length <= b) | (b == n))
        if own.any():
            last = int(at[own][-1])
        yield h[own], context[own], doc[own], at[own]


def sort_columns(rows: np.ndarray, left: np.ndarray, right: np.ndarray, group: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest column at which a repeated string starts, for each context; ``length`` and ``-1`` where none does.

    ``rows`` are the contexts aligned so that the anchor starts at column ``length - k``; ``left`` and ``right`` bound
    the columns that a context has. No two anchors of different groups are within equal strings.
    """
    m, before = len(rows), length - k
    columns = np.ascontiguousarray(rows.T)
    first, last = np.full(m, length, np.int64), np.full(m, -1, np.int64)
    order, common = np.zeros(0, np.int64), np.zeros(0, np.int64)
    by_end = np.argsort(right, kind="stable")
    ends = right[by_end]
    for c in range(rows.shape[1] - 1, -1, -1):
        a, b = np.searchsorted(ends, [c + 1, c + 2])
        if b > a:  # documents whose last symbol stands here: their empty suffixes come first
            order = np.concatenate([by_end[a:b], order])
            common = np.concatenate([np.zeros(b - a, np.int64), common])
            if b - a < len(order):
                common[b - a] = 0
        if not len(order):
            continue
        if c < before:
            alive = left[order] <= c
            if not alive.all():  # a document that has begun has no further symbol; its neighbours meet
                kept = np.flatnonzero(alive)
                common = np.where(np.diff(kept, prepend=-1) == 1, common[kept], -1)
                order = order[kept]
                if not len(order):
                    continue
        symbols = columns[c][order]
        move = np.argsort(symbols, kind="stable")
        nxt, sym = order[move], symbols[move]
        same = np.zeros(len(nxt), bool)
        same[1:] = (sym[1:] == sym[:-1]) & (group[nxt[1:]] == group[nxt[:-1]])
        stay = np.zeros(len(nxt), bool)
        stay[1:] = (move[1:] == move[:-1] + 1) & (common[move[1:]] >= 0)
        # A pair of different groups holds 0; it is compared afresh once it is a pair of one group, which it never becomes while it stays.
        new = np.where(same & stay, common[move] + 1, 0)
        fresh = np.flatnonzero(same & ~stay)
        for lo in range(0, len(fresh), 1 << 14):
            f = fresh[lo : lo + (1 << 14)]
            x, y = nxt[f - 1], nxt[f]
            width = min(length, rows.shape[1] - c)
            differ = rows[x, c : c + width] != rows[y, c : c + width]
            run = np.where(differ.any(1), differ.argmax(1), width)
            new[f] = np.minimum(run, np.minimum(right[x], right[y]) - c)
        order, common = nxt, new
        if c <= before:
            hit = np.flatnonzero(common >= length)
            if len(hit):
                both = np.union1d(order[hit], order[hit - 1])
                first[both] = c
                last[both] = np.maximum(last[both], c)
    return first, last


def _bitmap(df: DataFrame, column: str) -> np.ndarray:
    """A fixed-size filter of 64-bit ids (1 MB): other ids mostly miss it."""
    bit = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)).cast("int")
    found = df.select(bit.alias("bit")).select((F.col("bit") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, bit % 64)").alias("m")).groupBy("word").agg(F.bit_or("m").alias("m"))
    table = np.zeros(FILTER_BITS // 64, np.int64)
    for r in found.toLocalIterator():
        table[r.word] = r.m
    return table.view(np.uint8)


_CONTEXT = "h long, ctx long, copies long, left int, piece binary, rid binary, pos long, slab long"
_PLACE = ("copies", "rid", "pos", "slab")
_FOUND = "copies long, rid binary, pos long, slab long, first int, last int"


def _contexts(rows: DataFrame, wanted: DataFrame, length: int, k: int) -> DataFrame:
    """Rows of ``_CONTEXT``: the bytes and the place of one copy of each wanted context."""
    table = _bitmap(wanted, "rid")

    def near(batches):
        for batch in batches:
            bit = batch.column(2).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero((table[bit >> 3] >> (bit & 7)) & 1)
            if len(hit):
                yield batch.select([0, 1]).take(pa.array(hit))

    texts = rows.select("rid", "body", F.pmod(F.xxhash64("rid"), F.lit(FILTER_BITS)).cast("int").alias("bit")).mapInArrow(tidy(near), "rid binary, body binary")
    # Rows with equal texts have one rid: any of them serves, so the places of a text are kept once and the copies dropped by the last aggregate.
    places = wanted.groupBy("rid").agg(F.collect_list(F.struct("h", "ctx", "copies", "pos", "slab")).alias("places"))

    def cut(batches):
        for batch in batches:
            for row in range(len(batch)):
                body, places = batch.column(1)[row].as_py(), batch.column(2)[row].values
                pos = places.field("pos").to_numpy()
                lo, hi = np.maximum(0, pos - (length - k)), np.minimum(len(body), pos + length)
                pieces = [body[a:b] for a, b in zip(lo.tolist(), hi.tolist())]
                yield pa.RecordBatch.from_arrays([*(places.field(x) for x in ("h", "ctx", "copies")), pa.array((length - k - (pos - lo)).astype(np.int32)), pa.array(pieces, pa.binary()), pa.array([batch.column(0)[row].as_py()] * len(pos), pa.binary()), places.field("pos"), places.field("slab")], ["h", "ctx", "copies", "left", "piece", "rid", "pos", "slab"])

    return texts.join(places, "rid").select("rid", "body", "places").mapInArrow(tidy(cut), _CONTEXT)


def _matrix(left: np.ndarray, pieces: pa.Array, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    width = 2 * length - k
    rows = np.full((len(left), width), 255, np.uint8)
    right = np.zeros(len(left), np.int64)
    flat = rows.reshape(-1)
    for lo, hi, data, offs in slabs(pieces, 1 << 18):  # places take eight times the bytes that they are of
        size = np.diff(offs)
        flat[np.arange(len(data)) + np.repeat(np.arange(lo, hi) * width + left[lo:hi] - offs[:-1], size)] = data
        right[lo:hi] = left[lo:hi] + size
    return rows, right


def _sorted_groups(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def run(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        h, left = table.column("h").to_numpy(), table.column("left").to_numpy().astype(np.int64)
        rows, right = _matrix(left, table.column("piece").combine_chunks(), length, k)
        first, last = sort_columns(rows, left, right, h, length, k)
        hit = np.flatnonzero(last >= 0)
        kept = table.select(_PLACE).take(pa.array(hit)).combine_chunks()
        return pa.RecordBatch.from_arrays([*(kept.column(x).combine_chunks() for x in _PLACE), pa.array(first[hit].astype(np.int32)), pa.array(last[hit].astype(np.int32))], [*_PLACE, "first", "last"])

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= BATCH:
            table = pa.Table.from_batches(held)
            h = table.column("h").to_numpy()
            end = int(np.searchsorted(h, h[-1]))
            if end:
                yield run(table.slice(0, end))
                held = table.slice(end).to_batches()
    if held and sum(map(len, held)):
        yield run(pa.Table.from_batches(held))


def _counted(contexts: DataFrame, length: int, k: int) -> DataFrame:
    """The same answer for anchors with very many contexts: every string's hash is counted, with partial sums, and no group is gathered."""

    def strings(batches):
        for batch in batches:
            h = batch.column("h").to_numpy()
            left = batch.column("left").to_numpy().astype(np.int64)
            for lo, hi, data, offs in slabs(batch.column("piece"), 1 << 18):
                if len(data) < length:
                    continue
                hashes = _Hashes(data)
                at = np.arange(len(data) - length + 1)
                row = np.searchsorted(offs, at, "right") - 1
                col = at - offs[row] + left[lo + row]
                ok = (at + length <= offs[row + 1]) & (col <= length - k)
                at, row, col = at[ok], row[ok], col[ok]
                yield pa.RecordBatch.from_arrays([pa.array(h[lo + row]), *(batch.column(x).take(pa.array(lo + row)) for x in _PLACE), pa.array(col.astype(np.int32)), pa.array(hashes.of(at, at + length).view(np.int64))], ["h", *_PLACE, "col", "s"])

    each = contexts.mapInArrow(tidy(strings), "h long, copies long, rid binary, pos long, slab long, col int, s long")
    twice = each.groupBy("h", "col", "s").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return each.join(twice, ["h", "col", "s"], "left_semi").groupBy(*_PLACE).agg(F.min("col").alias("first"), F.max("col").alias("last"))


def repeated_spans(rows: DataFrame, length: int = 200) -> DataFrame:
    """``(rid, spans)`` from ``(rid binary, body binary)``: the maximal runs ``(s, e)`` of bytes covered by a string of ``length`` bytes that also starts elsewhere, in order. Rows of one ``rid`` have equal bodies and count as often as they occur."""
    k = min(GRAM, max(1, length // 4))
    before = length - k

    def find(batches):
        slab = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, _, data, offs in slabs(batch.column(1), SEGMENT):
                slab += 1
                h, ctx, doc, pos = (np.concatenate(x) for x in zip(*_anchors_of(data, offs, length, k)))
                if not len(h):
                    continue
                order = np.lexsort((pos, doc, ctx, h))
                h, ctx, doc, pos = h[order], ctx[order], doc[order], pos[order]
                new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1])))
                ends = np.append(new, len(h))
                places = pa.StructArray.from_arrays([batch.column(0).take(pa.array(lo + doc)), pa.array(pos), pa.array(np.diff(offs)[doc])], ["rid", "pos", "size"])
                yield pa.RecordBatch.from_arrays([pa.array(h[new]), pa.array(ctx[new]), pa.array(np.diff(ends)), pa.array(np.full(len(new), slab)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), places)], ["h", "ctx", "n", "slab", "places"])

    # The places of one context in one slab are a row: what very many texts have is gathered before it is shuffled.
    found = stored(rows.select("rid", "body").mapInArrow(tidy(find), "h long, ctx long, n long, slab long, places array<struct<rid: binary, pos: bigint, size: bigint>>"), "suffix-found")
    # Stored, so that the join may split a partition with a frequent anchor.
    twice = stored(found.groupBy("h").agg(F.sum("n").alias("all"), (F.min("ctx") != F.max("ctx")).alias("open")).where("all > 1").select("h", "open"), "suffix-twice")
    met = stored(found.join(twice, "h").select("h", "ctx", "n", "slab", "open", "places"), "suffix-anchors")
    drop_stored(found)
    drop_stored(twice)
    one = F.struct(F.col("places")[0]["rid"].alias("rid"), F.col("places")[0]["pos"].alias("pos"), "slab")
    unsure = met.where("open").groupBy("h", "ctx").agg(F.min(one).alias("one"), F.sum("n").alias("copies")).select("h", "ctx", "copies", "one.*")
    contexts = stored(_contexts(rows, unsure, length, k).dropDuplicates(["h", "ctx"]), "suffix-contexts")
    many = contexts.groupBy("h").count().where(F.col("count") > HOT).select("h").limit(1).count() > 0
    some = contexts
    if many:
        hot = stored(contexts.groupBy("h").count().where(F.col("count") > HOT).select("h"), "suffix-hot")
        some = contexts.join(hot, "h", "left_anti")
    answers = some.repartition("h").sortWithinPartitions("h").mapInArrow(tidy(lambda b: _sorted_groups(b, length, k)), _FOUND)
    if many:
        answers = answers.unionByName(_counted(contexts.join(hot, "h", "left_semi"), length, k))
    # A context that occurs twice repeats as a whole, wherever it stands; one that occurs once has its place with it.
    whole = contexts.where("copies > 1").select("h", "ctx", F.lit(True).alias("whole"))
    span = lambda rid, lo, hi: F.struct(rid.alias("rid"), lo.cast("long").alias("s"), hi.cast("long").alias("e"))
    every = F.transform("places", lambda p: span(p["rid"], F.greatest(p["pos"] - before, F.lit(0)), F.least(p["pos"] + length, p["size"])))
    sure = met.join(whole, ["h", "ctx"], "left").where("not open or whole").select("slab", every.alias("spans"))
    part = answers.where("copies = 1").select("slab", F.array(span(F.col("rid"), F.col("pos") - before + F.col("first"), F.col("pos") - before + F.col("last") + length)).alias("spans"))
    of_slabs = sure.unionByName(part).groupBy("slab").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # no more than a slab or a long text has

    def by_text(batches):
        for batch in batches:
            for x in batch.column(0):
                rid = x.values.field("rid").dictionary_encode()
                yield pa.RecordBatch.from_arrays([rid.dictionary, _runs(rid.indices.to_numpy().astype(np.int64), *(x.values.field(k).to_numpy() for k in ("s", "e")))], ["rid", "spans"])

    # Rows of one text have equal spans in all of their slabs.
    return of_slabs.select("spans").mapInArrow(tidy(by_text), "rid binary, spans array<struct<s: bigint, e: bigint>>").groupBy("rid").agg(F.first("spans").alias("spans"))


def _runs(text: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.ListArray:
    """The spans of each text in order, joined where they touch; the texts are numbered from 0 without a gap."""
    order = np.lexsort((s, text))
    apart = text[order] * (int(e.max()) + 2)
    s, e = s[order] + apart, np.maximum.accumulate(e[order] + apart)
    new = np.flatnonzero(np.append(True, s[1:] > e[:-1]))
    last = np.append(new[1:], len(s)) - 1
    ends = np.append(0, np.cumsum(np.bincount(text[order][new])))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(s[new] - apart[new]), pa.array(e[last] - apart[new])], ["s", "e"]))


def _stored_spans(rows: DataFrame, length: int) -> DataFrame:
    """:func:`repeated_spans` as a table; the anchors and contexts that it was made from go."""
    found = repeated_spans(rows, length)
    spans = stored(found, "suffix-spans")
    drop_stored(found)
    return spans


def _pairs(spans: list[dict] | None) -> list[tuple[int, int]]:
    return [(x["s"], x["e"]) for x in spans or ()]


def _kept(body: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for s, e in spans:
        out.append(body[at:s])
        at = e
    return b"".join([*out, body[at:]])


def _bodies(docs: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.withColumn("_wf_body", body).withColumn("_wf_rid", F.unhex(F.md5("_wf_body")))


def without_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row of ``docs``.

    Removed is each byte covered by a string of ``length`` bytes that also starts at another place, in the same
    document or another; overlaps count, and every copy goes. A null text counts as empty; texts shorter than
    ``length`` stay whole; an empty table gives an empty result. Rows with equal texts, repeated rows among them, have
    equal results. Only ``doc_id`` and ``text`` are read.
    """
    rows = _bodies(docs.select("doc_id", "text")).select("doc_id", F.col("_wf_body").alias("body"), F.col("_wf_rid").alias("rid"))
    spans = _stored_spans(rows.where(F.octet_length("body") >= length), length)

    def digest(batches):
        for batch in batches:
            ids, bodies, spans = batch.column(0), batch.column(1).to_pylist(), list(map(_pairs, batch.column(2).to_pylist()))
            kept = list(map(_kept, bodies, spans))
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(b) for b in bodies], pa.int64()), pa.array([len(b) - len(x) for b, x in zip(bodies, kept)], pa.int64()), pa.array(list(map(len, spans)), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    touched, clean = _divided(rows, spans)
    out = touched.join(spans, "rid", "left").select("doc_id", "body", "spans").mapInArrow(tidy(digest), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    zero = F.lit(0).cast("long")
    return out.unionByName(clean.select("doc_id", F.octet_length("body").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("body", 256).alias("kept_sha256")))


def _divided(rows: DataFrame, spans: DataFrame, rid: str = "rid") -> tuple[DataFrame, DataFrame]:
    """Rows whose ``rid`` may have spans, and rows that surely have none; only the first are shuffled with their texts."""
    table = _bitmap(spans, rid)

    @F.arrow_udf("boolean")  # without pandas, which a worker would hold from then on
    def may(bit: pa.Array) -> pa.Array:
        b = bit.to_numpy(zero_copy_only=False)
        return pa.array(((table[b >> 3] >> (b & 7)) & 1).astype(bool))

    hit = may(F.pmod(F.xxhash64(rid), F.lit(FILTER_BITS)).cast("int"))
    return rows.where(hit), rows.where(~hit)


def cut_texts(docs: DataFrame, length: int = 200) -> DataFrame:
    """``docs`` with the repeated strings of their texts removed, in all columns as they came (``n_chars`` follows the text, if there).

    A removed run is shortened to whole characters. Rows stay even if nothing is left of their text; a null text stays null.
    """
    names = docs.columns
    rows = _bodies(docs)
    spans = _stored_spans(rows.where(F.octet_length("_wf_body") >= length).select(F.col("_wf_rid").alias("rid"), F.col("_wf_body").alias("body")), length).withColumnRenamed("rid", "_wf_rid").withColumnRenamed("spans", "_wf_spans")

    at = names.index("text")

    def rest(batches):
        for batch in batches:
            left = [t if s is None else _whole_chars(t.encode(), _pairs(s)) for t, s in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist())]
            yield batch.select(range(len(names))).set_column(at, "text", pa.array(left, pa.string()))

    touched, clean = _divided(rows, spans, "_wf_rid")
    done = touched.join(spans, "_wf_rid", "left").select(*names, "_wf_spans").mapInArrow(tidy(rest), docs.schema)
    out = done.unionByName(clean.select(*names))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in names else out


def _whole_chars(body: bytes, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for s, e in spans:
        while s < e and body[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(body) and body[e] & 0xC0 == 0x80:
            e -= 1
        out.append(body[at:s])
        at = e
    return b"".join([*out, body[at:]]).decode("utf-8", "replace")
