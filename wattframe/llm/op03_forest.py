"""Approximate nearest neighbours by a forest of hash prefixes.

Each tree gives every vector a string of 64 bits, the signs of random projections; a tree is the sorted array of its
strings, cut into parts by leading bits. A query descends each tree to its longest matching prefixes; then all trees
ascend together, one bit at a time, until the vectors below their prefixes are numerous enough, counted from a histogram
of leading bits (trees x parts numbers, whatever the input). What lies below is scored exactly, part by part, and the
best of all parts are merged.

How many vectors to gather is set by a recall wanted: a forest over at most ``FIT_ROWS`` vectors is searched with at most
``FIT_QUERIES`` of them and compared with brute force, and the least share of vectors that reaches the recall is used.
Lengths of vectors that differ are evened by one more coordinate, so that the largest inner product is the nearest angle.

Equal vectors are one entry with its smallest ids, as many as any answer can hold. A part with very many vectors or
queries is dealt into blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattframe.llm.texts import tidy

from wattframe.operators.storage import stored

TREES, BITS = 16, 64
#: The bounds of the sample on which the number of candidates is fitted, and the recall to reach there.
FIT_ROWS, FIT_QUERIES, RECALL = 20_000, 128, 0.96
#: Vectors in a part, and vectors and queries in one block of it.
PART, ITEMS, ASKED = 4096, 16_384, 4096


def projections(dim: int, trees: int = TREES) -> np.ndarray:
    return np.random.default_rng(11).standard_normal((trees, dim + 1, BITS))


def strings(v: np.ndarray, planes: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """The hash strings of each vector, a column for each tree, as unsigned numbers: the first bit is the highest."""
    norm2 = (v**2).sum(1)
    # A query's length does not change its order of answers; a candidate's does.
    rest = np.zeros(len(v)) if query else np.sqrt(np.maximum(longest**2 - norm2, 0))
    x = np.column_stack([v, rest])
    powers = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
    return np.column_stack([((x @ p > 0) * powers).sum(1, dtype=np.uint64) for p in planes])


def ascended(keys: np.ndarray, counts: np.ndarray, bits: int, enough: float) -> np.ndarray:
    """The level at which the ascending trees stop for each query: the longest prefix, up to ``bits``, below which all trees together have ``enough`` vectors."""
    level = np.zeros(len(keys), np.int64)
    open_ = np.ones(len(keys), bool)
    for b in range(bits, -1, -1):
        total = np.zeros(len(keys), np.int64)
        width = 1 << (bits - b)
        for t in range(keys.shape[1]):
            part = counts[t].reshape(-1, width).sum(1)
            total += part[(keys[:, t] >> np.uint64(BITS - b)).astype(np.int64)] if b else part[0]
        done = open_ & (total >= enough)
        level[done] = b
        open_ &= ~done
    return level


def _fitted_share(v: np.ndarray, planes: np.ndarray, longest: float, k: int) -> float:
    """The least share of all vectors, over the trees together, with which the sample's recall is reached."""
    n = len(v)
    q = np.linspace(0, n - 1, min(n, FIT_QUERIES)).astype(int)
    scores = v[q] @ v.T
    scores[np.arange(len(q)), q] = -np.inf
    true = np.argpartition(-scores, min(k, n - 1), axis=1)[:, :k]
    own, asked = strings(v, planes, longest, False), strings(v[q], planes, longest, True)
    bits = 12
    counts = np.stack([np.bincount((own[:, t] >> np.uint64(BITS - bits)).astype(np.int64), minlength=1 << bits) for t in range(len(planes))])
    for share in 2.0 ** np.arange(-6, 4.5, 0.5):
        level = ascended(asked, counts, bits, share * n)
        found = np.zeros(true.shape, bool)
        for t in range(len(planes)):
            far = (asked[:, t, None] ^ own[true, t]) >> (np.uint64(BITS) - np.maximum(level, 1).astype(np.uint64))[:, None]
            found |= (far == 0) | (level == 0)[:, None]
        if found.mean() >= RECALL:
            return float(share)
    return float(len(planes))


def _clean(vectors: DataFrame) -> DataFrame:
    """Vectors that take part, as doubles: of the most common dimension, all components finite, not zero."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    dims = v.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return v.where(F.size("v") == (dims.dim if dims else 0)).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, trees: int = TREES) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each vector whose ``vec_id`` is divisible by ``every``, the ``k`` nearest found among all others, by inner product in double precision, ties to the smaller ``vec_id``.

    A vector that is null, zero, of another dimension than most, or with a null or non-finite component takes no part; nor does
    a null ``vec_id``. Rows that repeat a ``vec_id`` with one vector count once. With at most ``k`` others all are
    returned; an empty table gives an empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    clean = stored(_clean(vectors), "forest-vectors")
    stats = clean.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("longest"), F.first(F.size("v")).alias("dim")).first()
    if not stats.n:
        return spark.createDataFrame([], schema)
    planes = projections(stats.dim, trees)
    # No answer needs more than the k + 1 smallest ids of equal vectors.
    ids = F.slice(F.sort_array(F.collect_set("vec_id")), 1, k + 1)
    slim = clean.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64))).groupBy("v", "salt").agg(ids.alias("ids"))
    items = slim.groupBy("v").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    items = stored(items, "forest-items")
    n = items.count()
    sample = np.array([r.v for r in items.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(min(1.0, FIT_ROWS / n) * (1 << 30))).select("v").toLocalIterator()])
    share = _fitted_share(sample, planes, stats.longest, k) if n > PART and len(sample) > k else float(trees)
    bits = max(0, int(np.ceil(np.log2(n / PART))))
    longest = stats.longest

    def hashed(batches):
        for batch in batches:
            v = batch.column(0).flatten().to_numpy().reshape(len(batch), -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(strings(v, planes, longest, False).view(np.int64)), pa.list_(pa.int64()))], ["v", "ids", "keys"])

    items = stored(items.mapInArrow(tidy(hashed), "v array<double>, ids array<long>, keys array<long>"), "forest-strings")
    part_of = (F.shiftrightunsigned("key", BITS - bits) if bits else F.lit(0).cast("long")).alias("part")
    laid = items.select("v", "ids", F.posexplode("keys").alias("tree", "key")).select("v", "ids", "tree", "key", part_of)
    sizes = laid.groupBy("tree", "part").agg(F.count("*").alias("n")).collect()  # trees x parts numbers
    counts = np.zeros((trees, 1 << bits), np.int64)
    for r in sizes:
        counts[r.tree, r.part] = r.n

    def asked(batches):
        for batch in batches:
            v = batch.column(1).flatten().to_numpy().reshape(len(batch), -1)
            keys = strings(v, planes, longest, True)
            level = ascended(keys, counts, bits, share * n)
            q, tree, part = [], [], []
            for t in range(trees if share < trees else 1):
                low = np.where(level > 0, (keys[:, t] >> (np.uint64(BITS) - np.maximum(level, 1).astype(np.uint64))).astype(np.int64), 0) << (bits - level)
                width = 1 << (bits - level)
                q.append(np.repeat(np.arange(len(v)), width))
                tree.append(np.full(int(width.sum()), t))
                part.append(np.repeat(low - (np.cumsum(width) - width), width) + np.arange(int(width.sum())))
            q, tree, part = map(np.concatenate, (q, tree, part))
            key = keys[q, tree]
            narrow = np.where(level[q] == bits, 1, 0)
            some = counts[tree, part] > 0
            q, tree, part, key, narrow = q[some], tree[some], part[some], key[some], narrow[some]
            for lo in range(0, len(q), 20_000):
                s = slice(lo, lo + 20_000)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(q[s])), batch.column(1).take(pa.array(q[s])), pa.array(tree[s].astype(np.int32)), pa.array(key[s].view(np.int64)), pa.array(part[s]), pa.array(narrow[s].astype(np.int32))], ["query_id", "v", "tree", "key", "part", "narrow"])

    queries = clean.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"]).mapInArrow(tidy(asked), "query_id long, v array<double>, tree int, key long, part long, narrow int")
    queries = stored(queries, "forest-queries")
    many = queries.groupBy("tree", "part").agg(F.count("*").alias("m"))
    blocks = laid.groupBy("tree", "part").agg(F.count("*").alias("n")).join(many, ["tree", "part"]).select("tree", "part", F.ceil(F.col("n") / ITEMS).cast("int").alias("bi"), F.ceil(F.col("m") / ASKED).cast("int").alias("bq"))
    blocks = F.broadcast(spark.createDataFrame(blocks.collect(), "tree int, part long, bi int, bq int"))  # at most trees x parts rows
    own = laid.join(blocks, ["tree", "part"]).withColumn("i", F.pmod(F.xxhash64("v"), "bi")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("bq") - 1)))
    ask = queries.join(blocks, ["tree", "part"]).withColumn("j", F.pmod(F.xxhash64("query_id", "v"), "bq")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("bi") - 1)))
    group = ["tree", "part", "i", "j"]
    cast = lambda df: df.withColumn("i", F.col("i").cast("long")).withColumn("j", F.col("j").cast("long"))
    want = max(k + 1, int(share * n / trees))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [[], [], []]
        if len(left) and len(right):
            v = left.column("v").combine_chunks().flatten().to_numpy().reshape(len(left), -1)
            ids = left.column("ids").to_pylist()
            key = left.column("key").to_numpy().view(np.uint64)
            order = np.argsort(key)
            v, key = v[order], key[order]
            q = right.column("v").combine_chunks().flatten().to_numpy().reshape(len(right), -1)
            qid, qkey = right.column("query_id").to_numpy(), right.column("key").to_numpy().view(np.uint64)
            narrow = right.column("narrow").to_numpy()
            for lo in range(0, len(q), 512):
                scores = q[lo : lo + 512] @ v.T
                for r in range(len(scores)):
                    s, at = scores[r], order
                    if narrow[lo + r] and len(v) > 2 * want:
                        a, b = _below(key, qkey[lo + r], want)
                        s, at = s[a:b], order[a:b]
                    if len(s) > k + 1:
                        bound = np.partition(s, len(s) - k - 1)[len(s) - k - 1]
                        pick = np.flatnonzero(s >= bound)
                    else:
                        pick = np.arange(len(s))
                    rows = sorted(((-s[x], i) for x in pick for i in ids[at[x]] if i != qid[lo + r]))[:k]
                    found[0] += [qid[lo + r]] * len(rows)
                    found[1] += [i for _, i in rows]
                    found[2] += [-x for x, _ in rows]
        return pa.Table.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], ["query_id", "vec_id", "score"])

    own, ask = cast(own).select(*group, "v", "ids", "key"), cast(ask).select(*group, "query_id", "v", "key", "narrow")
    best = own.groupBy(*group).cogroup(ask.groupBy(*group)).applyInArrow(search, "query_id long, vec_id long, score double")
    best = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return best.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)


def _below(keys: np.ndarray, key: np.uint64, want: int) -> tuple[int, int]:
    """The range of a sorted array below the longest prefix of ``key`` that has ``want`` entries."""
    for up in range(BITS):
        low = (key >> np.uint64(up)) << np.uint64(up)
        a, b = np.searchsorted(keys, low), np.searchsorted(keys, low + (np.uint64(1) << np.uint64(up)) - np.uint64(1), "right")
        if b - a >= want:
            return int(a), int(b)
    return 0, len(keys)
