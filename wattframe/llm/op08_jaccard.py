"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its distinct word shingles, its tokens. All tokens have one global order: by document frequency,
rare ones first. Of two linked sets each lacks at most ``D`` tokens of the other, a bound that follows from its size. Tokens
are of three classes by frequency: of a rare one the token alone is indexed, of more frequent ones combinations of two or of
three. Tokens of a frequent class are dealt into buckets by hash and combined within a bucket, so ``c`` tokens of a bucket in
the index of ``k``-combinations can lose ``c - k`` and still leave a common combination. A prefix is extended until the sum of
``max(0, c - k + 1)`` over its buckets exceeds ``D``. The set whose prefix ends first in the global order then shares a
combination with every set that is linked to it. A token that one document alone has counts in the prefix and indexes nothing.
The number of buckets depends on a class of sizes; sizes that a link may join lie in neighbouring classes, so a document is
indexed for its own and the next.

Frequencies are only counted for documents that may have a partner at all: the tokens lowest by hash, a few more than ``D``,
are compared first, and where too few of these occur in another document there is none.

Links are found without enumerating the pairs of a group: documents with equal sets count once; each set is verified against
the set of fewest tokens of its own among those that it meets; components are formed; and for combinations that several
components meet in, every set is written as its difference ``E`` from the tokens that most of the largest component have. Two
sets differ in as many tokens as their differences do. So a triangle inequality tells which of them are linked whatever their
differences are, and all of these are linked to the one nearest to the middle; it tells which are too far away; and for the rest
how many tokens two differences must share: they are joined by prefixes of the differences, and verified.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import gcd, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.llm.texts import distinct_sets, mix, shingles, slabs, tidy, words
from wattframe.operators.components import components
from wattframe.operators.storage import drop_stored, stored

#: Bits of the filter of document ids for which sets are built a second time (1 MB, whatever the input).
FILTER_BITS = 1 << 23
#: Tokens of at most so many documents are rare, or common; the others are frequent. Combinations are of 1, 2 and 3 tokens.
RARE, COMMON = 8, 64


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for lo, hi, data, offs in slabs(column):
        _, _, doc, hashes = words(data, offs)
        d, v, _ = shingles(hashes, doc, hi - lo, n)
        yield lo, *distinct_sets(d, v, hi - lo)


def _keys(values: np.ndarray, offs: np.ndarray) -> list[bytes | None]:
    return [hashlib.md5(values[a:b]).digest() if b > a else None for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]


def _lists(values: np.ndarray, offs: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(values.view(np.int64)))


def _missing(n, num: int, den: int):
    """How many tokens of a set of ``n`` a set linked to it may lack."""
    return n - -(-num * n // den)


def _beyond(n, num: int, den: int, width: int):
    """Tokens beyond ``_missing`` that are compared first; never fewer for a larger set. Short shingles (of ``width`` words) repeat by chance, so more of them are asked for."""
    return np.minimum(_missing(n, num, den) * 3 // width + 1, n - _missing(n, num, den))


def _index(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """``doc_id, key, mark, n_shingles, needed, first``: the tokens that are lowest by hash, and how many of them other documents must have."""

    def index(batches):
        for batch in batches:
            for lo, values, offs in _sets(batch.column(1), n):
                size = np.diff(offs)
                keys = _keys(values, offs)
                take = np.where(size > 0, _missing(size, num, den) + _beyond(size, num, den, n), 0)
                ends = np.concatenate([[0], np.cumsum(take)])
                first = values[np.arange(ends[-1]) + np.repeat(offs[:-1] - ends[:-1], take)]
                marks = pa.array([k and int.from_bytes(k[:8], "little", signed=True) for k in keys], pa.int64())
                needed = _beyond(-(-num * size // den), num, den, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(size)), pa.array(keys, pa.binary()), marks, pa.array(size, pa.int64()), pa.array(needed, pa.int64()), _lists(first, ends)], ["doc_id", "key", "mark", "n_shingles", "needed", "first"])

    return docs.select("doc_id", "text").mapInArrow(tidy(index), "doc_id long, key binary, mark long, n_shingles long, needed long, first array<long>")


def _built_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``(node, tokens)`` of the ``wanted`` sets (``key, id, node``). A fixed-size filter of ids keeps most others from being built or shuffled."""
    marks = wanted.select(F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).cast("int").alias("bit"))
    words_of = marks.select((F.col("bit") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, bit % 64)").alias("m")).groupBy("word").agg(F.bit_or("m").alias("m"))
    table = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words_of.toLocalIterator():
        table[r.word] = r.m
    table = table.view(np.uint8)

    def build(batches):
        for batch in batches:
            bit = batch.column(1).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero((table[bit >> 3] >> (bit & 7)) & 1)
            if not len(hit):
                continue
            for _, values, offs in _sets(batch.column(0).take(pa.array(hit)), n):
                yield pa.RecordBatch.from_arrays([pa.array(_keys(values, offs), pa.binary()), _lists(values, offs)], ["key", "tokens"])

    rows = docs.where("doc_id is not null").select("text", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).cast("int").alias("bit"))
    built = rows.mapInArrow(tidy(build), "key binary, tokens array<long>")
    return built.join(wanted.select("key", "node"), "key").groupBy("key").agg(F.first("node").alias("node"), F.first("tokens").alias("tokens")).select("node", "tokens")


def _size_class(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Two sizes that a link may join are at most one class apart."""
    return np.floor(np.log(np.maximum(n, 1)) / log(den / num) + 1e-9).astype(np.int64)


def _runs(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(k, j)`` for every ``k`` and every ``j < of[k]``."""
    k = np.repeat(np.arange(len(of)), of)
    return k, np.arange(len(k)) - np.repeat(np.cumsum(of) - of, of)


def combinations(tokens: np.ndarray, counts: np.ndarray, offs: np.ndarray, n: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """``(document, signature)`` of the combinations to index.

    ``tokens[offs[d]:offs[d + 1]]`` are the tokens of document ``d`` that others have too, in the global order, ``counts`` their
    document frequencies; the ``n[d]`` tokens of the document include those that no other has.
    """
    own = np.diff(offs)
    doc = np.repeat(np.arange(len(own)), own)
    alone, spare = n - own, _missing(n, num, den)
    kind = 1 + (counts > RARE) + (counts > COMMON)
    deal, content = mix(tokens ^ np.uint64(0xC2B2AE3D27D4EB4F)), mix(tokens + np.uint64(0x165667B19E3779F9))
    size_class = _size_class(n, num, den)
    found = []
    for ahead in (0, 1):
        scheme = size_class + ahead
        # Of c tokens in m buckets at least c - (k - 1) m count: with both classes, this many buckets always leave enough.
        least = np.maximum(1, np.floor((den / num) ** (scheme - 1.0) * (1 - 1e-6)).astype(np.int64))
        m = (-(-num * least // den) - 1) // 3
        k = np.where(m[doc] > 0, kind, 1)
        at = np.where(k > 1, (np.cumsum(2 * m) - 2 * m)[doc] + (k - 2) * m[doc] + (deal % np.maximum(m, 1)[doc].astype(np.uint64)).astype(np.int64), -1)
        order = np.argsort(at, kind="stable")
        sorted_at = at[order]
        rank = np.empty(len(at), np.int64)
        rank[order] = np.arange(len(at)) - np.searchsorted(sorted_at, sorted_at)
        counted = (k == 1) | (rank >= k - 1)
        before = np.concatenate([[0], np.cumsum(counted)])
        inside = before[:-1] - before[offs[:-1]][doc] + alone[doc] <= spare[doc]
        salt = mix(scheme.astype(np.uint64) + np.uint64(0x27D4EB2F165667C5))
        single = np.flatnonzero(inside & (k == 1))
        found.append((doc[single], mix(content[single])))
        place = np.empty(len(at), np.int64)
        place[order] = np.arange(len(at))
        for size in (2, 3):
            last = np.flatnonzero(inside & (k == size))
            i, j = _runs(rank[last])
            last = last[i]
            total, then = content[last], order[place[last] - 1 - j]
            total = total + content[then]
            if size == 3:
                i, j = _runs(rank[then])
                last, then, total = last[i], order[place[then[i]] - 1 - j], total[i]
                total = total + content[then]
            found.append((doc[last], mix(mix(total + np.uint64(size)) + salt[doc[last]])))
    of, signature = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((signature, of))
    of, signature = of[order], signature[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (signature[1:] != signature[:-1])
    return of[new], signature[new]


def _indexed(sets: DataFrame, num: int, den: int) -> DataFrame:
    """``node, n, alone, tokens, sigs``: the tokens that other sets have too, in the global order, the number of the others, and the combinations."""
    token = sets.select("node", F.size("tokens").cast("long").alias("n"), F.explode("tokens").alias("token"))
    often = token.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    owned = token.join(often, "token").groupBy("node", "n").agg(F.collect_list(F.struct("c", "token")).alias("own"))

    def index(batches):
        for batch in batches:
            lists = batch.column(2)
            offs = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values
            counts, tokens = flat.field(0).to_numpy()[offs[0] : offs[-1]], flat.field(1).to_numpy()[offs[0] : offs[-1]].view(np.uint64)
            offs = offs - offs[0]
            doc = np.repeat(np.arange(len(lists)), np.diff(offs))
            order = np.lexsort((tokens, counts, doc))
            counts, tokens = counts[order], tokens[order]
            n = batch.column(1).to_numpy()
            of, sigs = combinations(tokens, counts, offs, n, num, den)
            ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(lists)))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n - np.diff(offs), pa.int64()), _lists(tokens, offs), _lists(sigs, ends)], ["node", "n", "alone", "tokens", "sigs"])

    return owned.mapInArrow(tidy(index), "node long, n long, alone long, tokens array<long>, sigs array<long>").where("size(sigs) > 0")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``(a, b)`` whose sets reach the similarity."""
    side = lambda k: sets.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("tokens").alias(f"t{k}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
    both = both.withColumn("shared", F.size(F.array_intersect("ta", "tb")).cast("long"))
    return both.where(F.col("shared") * den >= (F.col("na") + F.col("nb") - F.col("shared")) * num).select("a", "b")


def _toward(shared: DataFrame) -> DataFrame:
    """One pair ``(a, b)`` for each node ``b``: with the set ``a`` of fewest tokens of its own in most of its combinations."""
    middle = shared.groupBy("sig").agg(F.min_by("node", F.struct("alone", "node")).alias("a"))
    votes = shared.join(middle, "sig").where("a <> node").groupBy("node", "a").count()
    return votes.groupBy("node").agg(F.max_by("a", F.struct("count", -F.col("a"))).alias("a")).select("a", F.col("node").alias("b"))


def _around(shared: DataFrame, label: DataFrame) -> DataFrame:
    """``chief, node, c``: where several components ``c`` meet in a combination, all its nodes, under the largest of the components."""
    member = shared.join(label, F.col("node") == F.col("vertex"), "left").select("sig", "node", F.coalesce("component", "node").alias("c"))
    sizes = member.groupBy("sig", "c").agg(F.count("*").alias("k"))
    split = sizes.groupBy("sig").agg(F.max_by("c", F.struct("k", -F.col("c"))).alias("chief"), F.count("*").alias("parts")).where("parts > 1").select("sig", "chief")
    return member.join(split, "sig").select("chief", "node", "c").distinct()


def _differences(around: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """``chief, node, c, n, alone, k, slack, reach, e``: each set's difference from the tokens that most sets of the chief component have.

    ``k`` is its size, ``e`` its tokens without the set's own ones (those come first in the order): added ones, rare first, then
    lacking ones, those that most sets have first. Two sets whose slacks sum to 0 or more are linked.
    """
    main = around.where("c = chief")
    size = main.groupBy("chief").agg(F.count("*").alias("members"))
    token = main.join(sets.select("node", "tokens"), "node").select("chief", F.explode("tokens").alias("token")).groupBy("chief", "token").agg(F.count("*").alias("times"))
    core = token.join(size, "chief").where("2 * times > members").groupBy("chief").agg(F.transform(F.sort_array(F.collect_list(F.struct("times", "token")), asc=False), lambda x: x["token"]).alias("core"))
    both = around.join(sets.select("node", "n", "alone", "tokens"), "node").join(core, "chief", "left").withColumn("core", F.coalesce("core", F.expr("cast(array() as array<long>)")))
    both = both.withColumn("e", F.concat(F.array_except("tokens", "core"), F.array_except("core", "tokens"))).withColumn("k", F.size("e") + F.col("alone"))
    return both.select("chief", "node", "c", "n", "alone", "k", F.expr(f"{den - num} * n - {den + num} * k").alias("slack"), F.expr(f"{den - num} * n + {den + num} * k").alias("reach"), "e")


def _apart(around: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """``(linked, pairs)`` for the rows of ``_differences``: links that follow from the slacks, and pairs ``(a, b)`` that may be linked.

    A set of slack ``s`` is linked to one of slack ``t`` only if their differences have at least ``(-s - t) / 2 (den + num)``
    tokens in common. If that is not positive they are linked, and both to the set of the largest slack. Others have a common
    token within the first ``k - o + 1`` of both, where ``o`` is the least such number that the set can need.
    """
    twice = 2 * (den + num)
    top = around.groupBy("chief").agg(F.max("slack").alias("top"), F.max_by("node", F.struct("slack", -F.col("node"))).alias("star"), F.max_by("c", F.struct("slack", -F.col("node"))).alias("star_c"), F.max_by("node", F.struct("reach", "node")).alias("far"))
    rows = around.join(top, "chief")
    farther = rows.groupBy("chief").agg(F.max(F.when(F.col("node") == F.col("far"), F.col("reach"))).alias("reach_1"), F.max(F.when(F.col("node") != F.col("far"), F.col("reach"))).alias("reach_2"))
    linked = rows.where("slack + top >= 0 and c <> star_c").select(F.least("star", "node").alias("a"), F.greatest("star", "node").alias("b"))
    rows = rows.join(farther, "chief").where("-slack <= if(node = far, reach_2, reach_1)").withColumn("out", F.expr("slack + top < 0"))
    rows = rows.withColumn("common", F.expr(f"if(out, (-slack - top + {twice - 1}) div {twice}, (top + 1 - slack + {twice - 1}) div {twice})"))
    first = F.least(F.col("k") - F.col("common") + 1 - F.col("alone"), F.size("e"))
    rows = rows.where(first > 0)
    marks = rows.select("chief", "node", "c", "out", "k", "slack", F.posexplode(F.slice("e", F.lit(1), first.cast("int"))).alias("at", "token"), "alone").withColumn("at", F.col("at") + F.col("alone"))
    side = lambda p: [F.col(x).alias(f"{p}_{x}") for x in ("node", "c", "out", "k", "slack", "at")]
    x, y = marks.where("out").select("chief", "token", *side("x")), marks.select("chief", "token", *side("y"))
    need = f"(-x_slack - y_slack + {twice - 1}) div {twice}"
    near = x.join(y, ["chief", "token"]).where(f"x_c <> y_c and (not y_out or x_node < y_node) and x_at + {need} <= x_k and y_at + {need} <= y_k")
    return linked, near.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"))


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``.

    Documents are linked when ``den * |intersection| >= num * |union|`` of their sets of distinct ``n``-word shingles,
    exactly and with no cap on partners; ``component_id`` is the smallest ``doc_id`` in reach. Only ``doc_id`` and
    ``text`` are read, so other columns may have any name. A null, empty or blank text has an empty set and is linked
    with nothing. A row whose ``doc_id`` is null keeps a null ``component_id`` and links nothing. Rows that repeat a
    ``doc_id`` are one document for the links, with the sets of all their texts. An empty table gives an empty result.
    """
    g = gcd(num, den)
    num, den = num // g, den // g
    if not 0 < num < den:
        raise ValueError("the similarity must lie between 0 and 1")
    index = stored(_index(docs, n, num, den), "jaccard-first")
    slim = stored(index.select("doc_id", "n_shingles", "key"), "jaccard-rows")
    named = index.where("key is not null and doc_id is not null")
    equal = named.groupBy("key").agg(F.min("doc_id").alias("id"), F.first("mark").alias("mark"), F.first("needed").alias("needed"), F.first(F.size("first")).alias("first"))
    equal = stored(equal.withColumn("node", F.monotonically_increasing_id()), "jaccard-equal")
    single = named.select("mark", F.explode("first").alias("token")).groupBy("token").agg(F.min("mark").alias("mark"), F.max("mark").alias("most")).where("mark = most").groupBy("mark").agg(F.count("*").alias("single"))
    wanted = stored(equal.join(single, "mark", "left").where("first - coalesce(single, 0) >= needed").select("key", "id", "node"), "jaccard-wanted")
    drop_stored(index)
    built = stored(_built_sets(docs, wanted, n), "jaccard-built")
    sets = stored(_indexed(built, num, den), "jaccard-sets")
    drop_stored(built)
    drop_stored(wanted)
    sig = sets.select("node", "alone", F.explode("sigs").alias("sig"))
    met = sig.groupBy("sig").agg(F.count("*").alias("k")).where("k > 1").select("sig")
    shared = stored(sig.join(met, "sig"), "jaccard-shared")
    links = [stored(_verified(_toward(shared), sets, num, den), "jaccard-links")]
    twice = slim.where("key is not null and doc_id is not null").groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("key")).where("low < key").select("doc_id")
    twice = slim.join(twice, "doc_id", "left_semi").where("key is not null").select("doc_id", "key").distinct().join(equal.select("key", "node"), "key")
    same = twice.groupBy("doc_id").agg(F.min("node").alias("a")).join(twice, "doc_id").where("a < node").select("a", F.col("node").alias("b"))
    links.append(stored(same, "jaccard-same"))
    label = stored(components(links[0].unionByName(links[1]), "a", "b"), "jaccard-label")
    around = stored(_around(shared, label), "jaccard-around")
    drop_stored(shared)
    apart = stored(_differences(around, sets, num, den), "jaccard-differences")
    drop_stored(around)
    linked, near = _apart(apart, num, den)
    links += [stored(linked.distinct(), "jaccard-certain"), stored(_verified(near.distinct(), sets, num, den), "jaccard-more")]
    if not (links[2].isEmpty() and links[3].isEmpty()):
        drop_stored(label)
        label = stored(components(links[0].unionByName(links[1]).unionByName(links[2]).unionByName(links[3]), "a", "b"), "jaccard-label")
    for x in (apart, sets, *links):
        drop_stored(x)
    of = equal.join(label, F.col("node") == F.col("vertex")).select("key", "id", "component")
    least = of.groupBy("component").agg(F.min("id").alias("found"))
    final = of.join(least, "component").select("key", "found").unionByName(equal.join(label, F.col("node") == F.col("vertex"), "left_anti").select("key", F.col("id").alias("found")))
    return slim.join(final, "key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of ``docs``, with all their columns, without those that a smaller ``doc_id`` stands for; of rows that repeat a ``doc_id`` one stays. Rows with a null ``doc_id`` stay."""
    found = near_duplicates(docs, n, num, den).where("doc_id is not null")
    gone = stored(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_wf_id")).distinct(), "jaccard-gone")
    drop_stored(found)
    kept = docs.join(gone, F.col("doc_id") == F.col("_wf_id"), "left_anti")
    twice = stored(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("_wf_id")).agg(F.count("*").alias("n")).where("n > 1").select("_wf_id"), "jaccard-twice")
    if twice.isEmpty():
        return kept
    on = F.col("doc_id") == F.col("_wf_id")
    return kept.join(twice, on, "left_anti").unionByName(kept.join(twice, on, "left_semi").dropDuplicates(["doc_id"]))
