"""A quality classifier: a generalised additive model with pairwise interactions.

Features are counts and shares taken from the whole text, in one vectorised pass. Cyclic boosting visits the features in
turn, fits a shallow tree of one feature to the present residuals and adds it to that feature's lookup table; then pairs
with the largest remaining gain get tables of two features in the same way. A score is a sum of table entries, added for
all documents at once.

The model is fitted on at most ``TRAIN_ROWS`` labelled rows, those with the smallest hash of ``doc_id``; it is a few
kilobytes, and scoring is a map over the features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.llm.texts import WHITE, mix, slabs, tidy, words
from wattframe.operators.storage import stored

#: The bound of the sample of labelled rows on which the model is fitted.
TRAIN_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE = 120, 40, 0.15

FEATURES = ["length", "upper", "digit", "white", "lines", "mark", "symbol", "foreign", "word_length", "word_spread", "short_words", "distinct_words", "distinct_lines", "symbol_ends", "bare_symbols", "longest_word", "repeated_neighbours", "capitals"]

_CODE = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 3 digit, 4 white, 5 sentence marks, 6 other symbols, 7 beyond ASCII
_CODE[ord("a") : ord("z") + 1] = 1
_CODE[ord("A") : ord("Z") + 1] = 2
_CODE[ord("0") : ord("9") + 1] = 3
_CODE[WHITE] = 4
_CODE[128:] = 7
_CODE[(_CODE == 0)] = 6
_CODE[[ord(c) for c in ".,;:!?'\"-()"]] = 5


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of ``FEATURES`` for each document of a slab; an empty document has zeros."""
    n_docs = len(offs) - 1
    size = np.diff(offs)
    code = _CODE[data]
    doc = np.repeat(np.arange(n_docs), size)
    counts = np.bincount(doc * 8 + code, minlength=n_docs * 8).reshape(n_docs, 8)
    start, end, of, h = words(data, offs)
    n_words = np.bincount(of, minlength=n_docs)
    length = end - start
    per = lambda x, of=of: np.bincount(of, x, n_docs)
    ends = code[end - 1] if len(end) else np.zeros(0, np.uint8)
    starts = code[start] if len(start) else np.zeros(0, np.uint8)
    letters = np.concatenate([[0], np.cumsum((code <= 2) & (code > 0) | (code == 3) | (code == 7))])
    bare = letters[end] == letters[start]
    order = np.lexsort((h, of))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
    breaks = np.flatnonzero(data == 10)
    bounds = np.union1d(offs[:-1][size > 0], breaks + 1)
    bounds = bounds[bounds < len(data)]
    lines = np.searchsorted(offs, bounds, "right") - 1
    if len(bounds):
        total = np.add.reduceat(mix(data.astype(np.uint64) + (np.arange(len(data)) - np.repeat(bounds, np.diff(np.append(bounds, len(data))))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), bounds)
        n_lines = np.bincount(lines, minlength=n_docs)
        by = np.lexsort((total, lines))
        fresh = np.ones(len(by), bool)
        fresh[1:] = (total[by][1:] != total[by][:-1]) | (lines[by][1:] != lines[by][:-1])
        n_fresh = np.bincount(lines[by], fresh, n_docs)
    else:
        n_lines = n_fresh = np.zeros(n_docs)
    twice = np.zeros(len(h), bool)
    twice[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    longest = np.zeros(n_docs)
    np.maximum.at(longest, of, length)
    b, w = np.maximum(size, 1), np.maximum(n_words, 1)
    mean = per(length) / w
    spread = np.sqrt(np.maximum(per(length.astype(float) ** 2) / w - mean**2, 0))
    return np.column_stack([np.log1p(size), counts[:, 2] / b, counts[:, 3] / b, counts[:, 4] / b, n_lines / w, counts[:, 5] / w, counts[:, 6] / w, counts[:, 7] / b, mean, spread, per(length <= 3) / w, np.bincount(of[order], new, n_docs) / w, n_fresh / np.maximum(n_lines, 1), per(ends == 6) / w, per(bare) / w, np.log1p(longest), per(twice) / w, per(starts == 2) / w])


@dataclass
class Model:
    cuts: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_cuts: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cuts, x[:, j], "right")]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[np.searchsorted(self.pair_cuts[i], x[:, i], "right"), np.searchsorted(self.pair_cuts[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins)) if len(x) else np.zeros(0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int, reg: float = 1.0, least: float = 1.0) -> np.ndarray:
    """The leaf value of each bin, of a tree over bins in order: best splits by gain of gradient sums ``g`` and curvatures ``h``."""
    out = np.full(len(g), g.sum() / (h.sum() + reg))
    if depth and len(g) > 1:
        cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = cg**2 / (ch + reg) + (g.sum() - cg) ** 2 / (h.sum() - ch + reg) - g.sum() ** 2 / (h.sum() + reg)
        gain[(ch < least) | (h.sum() - ch < least)] = 0
        k = int(gain.argmax())
        if gain[k] > 1e-9:
            out[: k + 1] = _tree(g[: k + 1], h[: k + 1], depth - 1, reg, least)
            out[k + 1 :] = _tree(g[k + 1 :], h[k + 1 :], depth - 1, reg, least)
    return out


def _tree2(g: np.ndarray, h: np.ndarray, depth: int) -> tuple[np.ndarray, float]:
    """The same over a grid: each split is along the better axis. Also the gain of the whole tree."""
    whole = g.sum() ** 2 / (h.sum() + 1)
    best = (1e-9, None)
    if depth:
        for axis in (0, 1):
            cg, ch = np.cumsum(g.sum(1 - axis))[:-1], np.cumsum(h.sum(1 - axis))[:-1]
            if not len(cg):
                continue
            gain = cg**2 / (ch + 1) + (g.sum() - cg) ** 2 / (h.sum() - ch + 1) - whole
            gain[(ch < 1) | (h.sum() - ch < 1)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (axis, k + 1))
    if best[1] is None:
        return np.full(g.shape, g.sum() / (h.sum() + 1)), 0.0
    axis, k = best[1]
    left, a = _tree2(*(np.split(x, [k], axis)[0] for x in (g, h)), depth - 1)
    right, b = _tree2(*(np.split(x, [k], axis)[1] for x in (g, h)), depth - 1)
    return np.concatenate([left, right], axis), best[0] + a + b


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Without rows, or with one class only, the score is the smoothed share of label 1."""
    n, m = x.shape
    share = (y.sum() + 1) / (n + 2)
    model = Model([_cuts(x[:, j], BINS) for j in range(m)], float(np.log(share / (1 - share))), [], [], [_cuts(x[:, j], PAIR_BINS) for j in range(m)], [])
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    if not 0 < y.sum() < n:
        return model
    bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(model.cuts)]
    coarse = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(model.pair_cuts)]
    total = np.full(n, model.base)
    slope = lambda: (y - (p := 1 / (1 + np.exp(-total))), p * (1 - p))
    for _ in range(ROUNDS):
        for j in range(m):
            g, h = slope()
            k = len(model.tables[j])
            step = RATE * _tree(np.bincount(bins[j], g, k), np.bincount(bins[j], h, k), 2)
            model.tables[j] += step
            total += step[bins[j]]
    grid = lambda i, j, v: np.bincount(coarse[i] * (len(model.pair_cuts[j]) + 1) + coarse[j], v, (len(model.pair_cuts[i]) + 1) * (len(model.pair_cuts[j]) + 1)).reshape(len(model.pair_cuts[i]) + 1, -1)
    g, h = slope()
    gains = sorted(((_tree2(grid(i, j, g), grid(i, j, h), 3)[1], i, j) for i in range(m) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in gains[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((len(model.pair_cuts[i]) + 1, len(model.pair_cuts[j]) + 1)) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            g, h = slope()
            step = RATE * _tree2(grid(i, j, g), grid(i, j, h), 3)[0]
            table += step
            total += step[coarse[i], coarse[j]]
    return model


def with_features(docs: DataFrame) -> DataFrame:
    """``doc_id, features`` of each row."""

    def measure(batches):
        for batch in batches:
            for lo, hi, data, offs in slabs(batch.column(1)):
                x = features(data, offs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["doc_id", "features"])

    return docs.select("doc_id", "text").mapInArrow(tidy(measure), "doc_id long, features array<double>")


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _wanted(labels: DataFrame):
    """Labelled rows outside the held-out fold, one for each ``doc_id`` (the greater label, where there are two), and the hash below which about 1.2 ``TRAIN_ROWS`` of them lie."""
    known = labels.where("quality in (0, 1) and doc_id is not null").where(~_held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = known.count()
    return known, F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, 1.2 * TRAIN_ROWS / max(n, 1)) * (1 << 30))


def train(measured: DataFrame, known: DataFrame, below) -> Model:
    """Fitted on at most ``TRAIN_ROWS`` labelled rows, those with the smallest hash. No more than about 1.2 times as many are sorted, however many there are."""
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    rows = measured.where(below).join(known.where(below), "doc_id").orderBy(hashed, "doc_id", "features").limit(TRAIN_ROWS).select("features", "quality").collect()
    return fit(np.array([r.features for r in rows]).reshape(-1, len(FEATURES)), np.array([r.quality for r in rows], float))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    ``score`` (0 to 1) tells how likely label 1 is and depends on the text alone; ``predicted`` is 1 from 0.5 on. A null
    text counts as empty, and an empty text has a score like any other. Repeated rows have equal scores, and train as often
    as they occur; of two labels of a document the greater counts. A row with a
    null ``doc_id`` is scored and not held out. Without labels every score is 0.5. Other columns are not read.
    """
    measured = stored(with_features(docs), "quality-features")
    model = train(measured, *_wanted(labels))

    def score(batches):
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().reshape(-1, len(FEATURES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return measured.select("doc_id", _held_out().alias("held_out"), "features").mapInArrow(tidy(score), "doc_id long, held_out boolean, score double, predicted int")


def of_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a score of at least 0.5, with all their columns, by the model that :func:`scored` has. Rows are not shuffled: each is scored where it is read."""
    known, below = _wanted(labels)
    model = train(with_features(docs.where(below).join(known.select("doc_id"), "doc_id", "left_semi")), known, below)
    at = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            ok = np.zeros(len(batch), bool)
            for lo, hi, data, offs in slabs(batch.column(at)):
                ok[lo:hi] = model.score(features(data, offs)) >= 0.5
            yield batch.filter(pa.array(ok))

    return docs.mapInArrow(tidy(keep), docs.schema)
