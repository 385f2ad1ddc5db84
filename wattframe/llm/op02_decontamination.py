"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, compared without case, as Unicode folds it. Every run of ``SEED`` words of a test item is a
seed, however common. A pass finds the seeds of each passage and cuts a window around every chain of one item's seeds.
A window goes if even its words that the item has, all matched, would not score enough; the others are aligned with the
item word by word, equal ones once. Nothing is shuffled: the items go to the workers in blocks of bounded size, and each
block is one pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wattframe.llm.texts import MARKS, shingles, slabs, tidy, words

SEED = 3
#: Words of the items that go out together (8 bytes each).
BLOCK_WORDS = 1 << 19
MATCH, MISMATCH, GAP = 2, -1, -1
_TABLE = 1 << 20
#: Words of windows that are looked at together, and alignments that a task remembers.
_WINDOWS, _SEEN = 1 << 20, 1 << 16


def folded(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A slab's bytes and offsets with the case of all letters folded; :func:`words` does so for A-Z."""
    if not len(data) or data.max() < 128:
        return data, offs
    raw = data.tobytes()
    texts = [raw[a:b].decode(errors="surrogateescape").casefold().encode(errors="surrogateescape") for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


@dataclass
class Items:
    """A block of test items: their words, their seeds in order of hash, the distinct words of all, and ``item * len(vocab) + word`` of each item's own."""

    ids: list
    words: list[np.ndarray]
    seed: np.ndarray
    item: np.ndarray
    filter: np.ndarray
    vocab: np.ndarray
    own: np.ndarray

    @staticmethod
    def of(ids: list, texts: list[str]) -> Items:
        kept, hashes, seeds, owner = [], [], [], []
        for i, t in zip(ids, texts):
            data = np.frombuffer((t or "").encode(), np.uint8)
            _, _, doc, h = words(*folded(data, np.array([0, len(data)])), MARKS)
            if len(h):
                _, s, _ = shingles(h, doc, 1, SEED)
                seeds.append(np.unique(s))
                owner.append(np.full(len(seeds[-1]), len(kept)))
                kept.append(i)
                hashes.append(h)
        seed = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        item = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        order = np.argsort(seed, kind="stable")
        table = np.zeros(_TABLE, bool)
        table[(seed % np.uint64(_TABLE)).astype(np.int64)] = True
        vocab, word = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]), return_inverse=True)
        own = np.unique(np.repeat(np.arange(len(kept)), [len(x) for x in hashes]) * len(vocab) + word)
        return Items(kept, hashes, seed[order], item[order], table, vocab, own)

    def hits(self, h: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(document, word, seed)``, where ``seed`` is the first of equal seeds."""
        sizes = sorted({SEED, *(len(x) for x in self.words if len(x) < SEED)})
        d, s, at = (np.concatenate(x) for x in zip(*(shingles(h, doc, n_docs, n, False) for n in sizes)))
        near = np.flatnonzero(self.filter[(s % np.uint64(_TABLE)).astype(np.int64)]) if len(self.seed) else np.zeros(0, np.int64)
        k = np.searchsorted(self.seed, s[near])
        ok = self.seed[np.minimum(k, len(self.seed) - 1)] == s[near] if len(near) else np.zeros(0, bool)
        return d[near][ok], at[near][ok], k[ok]


def _blocks(items: DataFrame) -> Iterator[Items]:
    ids, texts, size = [], [], 0
    for r in items.select("item_id", "text").where("text is not null").orderBy("item_id").toLocalIterator():
        ids.append(r.item_id)
        texts.append(r.text)
        size += len(r.text) // 4 + 1
        if size >= BLOCK_WORDS:
            yield Items.of(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Items.of(ids, texts)


def _possible(block: Items, h: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, size: np.ndarray, least: float) -> np.ndarray:
    """Which windows ``h[lo:hi]`` can reach ``least``: a word of the item's scores ``MATCH`` at most, each other one between two matches costs a gap or a mismatch."""
    k = np.minimum(np.searchsorted(block.vocab, h), len(block.vocab) - 1)
    word = np.where(block.vocab[k] == h, k, -1)
    order = np.argsort(hi - lo, kind="stable")
    length = (hi - lo)[order]
    out = np.zeros(len(item), bool)
    a = 0
    while a < len(order):
        fit = np.arange(1, min(len(order) - a, _WINDOWS) + 1) * length[a : a + _WINDOWS] <= _WINDOWS
        b = a + max(1, int(np.count_nonzero(fit)))
        part = order[a:b]
        at = lo[part][:, None] + np.arange(length[b - 1])
        w = np.where(at < hi[part][:, None], word[np.minimum(at, len(h) - 1)], -1)
        row, col = np.nonzero(w >= 0)
        key = item[part][row] * len(block.vocab) + w[row, col]
        found = block.own[np.minimum(np.searchsorted(block.own, key), len(block.own) - 1)] == key
        gain = np.full(w.shape, max(MISMATCH, GAP), np.int32)
        gain[row[found], col[found]] = MATCH
        total = np.cumsum(gain, axis=1, dtype=np.int32)
        lowest = np.minimum.accumulate(np.minimum(total - gain, 0), axis=1)
        out[part] = (total - lowest).max(1) / (MATCH * size[item[part]]) >= least
        a = b
    return out


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``(score, end)`` of the best local alignment of each item with its window: all pairs advance together, one item word at a time."""
    p, rows, cols = len(items), max(map(len, items)), max(map(len, windows))
    size = np.array([len(x) for x in items])
    win = np.zeros((p, cols), np.uint64)
    text = np.ones((p, rows), np.uint64)
    for k, (a, b) in enumerate(zip(items, windows)):
        text[k, : len(a)], win[k, : len(b)] = a, b
    slope = np.arange(cols, dtype=np.int32) * -GAP
    score, best, end = np.zeros((p, cols + 1), np.int32), np.zeros(p, np.int32), np.zeros(p, np.int64)
    for i in range(rows):
        step = np.where(win == text[:, i : i + 1], MATCH, MISMATCH)
        new = np.maximum(np.maximum(score[:, :-1] + step, score[:, 1:] + GAP), 0)
        score[:, 1:] = np.maximum.accumulate(new + slope, axis=1) - slope
        at = score.argmax(1)
        top = score[np.arange(p), at]
        more = (top > best) & (i < size)
        best[more], end[more] = top[more], at[more]
    return best, end


def _matches(block: Items, h: np.ndarray, doc: np.ndarray, n_docs: int, least: float, seen: dict) -> list[tuple[int, int, float, int, int]]:
    """``(document, item, score, first word, end word)`` of each document's best alignment with each item it may hold.

    ``seen`` remembers alignments by item and window, for copies.
    """
    d, at, k = block.hits(h, doc, n_docs)
    if not len(d):
        return []
    last = np.searchsorted(block.seed, block.seed, "right")[k]
    spread = np.repeat(np.arange(len(k)), last - k)
    item = block.item[k[spread] + np.arange(len(spread)) - np.repeat(np.cumsum(last - k) - (last - k), last - k)]
    d, at = d[spread], at[spread]
    order = np.lexsort((at, item, d))
    d, at, item = d[order], at[order], item[order]
    size = np.array([len(x) for x in block.words])
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (at[1:] - at[:-1] > size[item[1:]])
    first = np.flatnonzero(new)
    end = np.append(first[1:], len(d)) - 1
    bounds = np.searchsorted(doc, np.arange(n_docs + 1))
    d, item = d[first], item[first]
    start = np.maximum(bounds[d], at[first] - size[item])
    stop = np.minimum(bounds[d + 1], at[end] + SEED + size[item])
    ok = _possible(block, h, item, start, stop, size, least)
    if len(seen) > _SEEN:
        seen.clear()
    places, new = [], {}
    for x, i, lo, hi in zip(d[ok].tolist(), item[ok].tolist(), start[ok].tolist(), stop[ok].tolist()):
        key = i, blake2b(h[lo:hi], digest_size=16).digest()
        places.append((x, i, lo, key))
        if key not in seen:
            new[key] = h[lo:hi]
    chains = sorted(new.items(), key=lambda c: (len(c[1]), size[c[0][0]]))
    lo = 0
    while lo < len(chains):
        hi = lo + 1
        while hi < len(chains) and (hi - lo + 1) * len(chains[hi][1]) <= 1 << 17:
            hi += 1
        keys, windows = zip(*chains[lo:hi])
        lo = hi
        words_ = [block.words[i] for i, _ in keys]
        score, ends = align(words_, list(windows))
        share = score / np.array([MATCH * len(x) for x in words_])
        seen.update(dict.fromkeys(keys))
        good = np.flatnonzero(share >= least)
        if len(good):
            _, back = align([words_[k][::-1] for k in good], [windows[k][: ends[k]][::-1] for k in good])
            seen.update((keys[k], (float(share[k]), int(ends[k] - r), int(ends[k]))) for k, r in zip(good, back))
    found: dict[tuple[int, int], tuple[float, int, int]] = {}
    for x, i, begin, key in places:
        if seen[key]:
            share, a, b = seen[key]
            row = (share, int(begin + a - bounds[x]), int(begin + b - bounds[x]))
            if row > found.get((x, i), (0.0, 0, 0)):
                found[x, i] = row
    return [(*key, *row) for key, row in found.items()]


def leaks(docs: DataFrame, items: DataFrame, least: float = 0.5) -> DataFrame:
    """``doc_id, item_id, score, first_word, end_word`` of each pair of a document and a test item that it holds.

    ``score`` is that of the best local alignment, as a share of a full match of the item; pairs from ``least`` on are
    returned, one row per row of ``docs`` and item. A null or empty text, of a document or an item, matches nothing;
    an item of fewer than three words is its own seed and is found wherever its words follow each other. Repeated rows
    each have their matches; null ids are carried. Other columns are not read. Empty tables give an empty result.
    """
    schema = "doc_id long, item_id long, score double, first_word long, end_word long"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(items):

        def find(batches, block=block):
            seen = {}
            for batch in batches:
                for lo, hi, data, offs in slabs(batch.column(1)):
                    _, _, doc, h = words(*folded(data, offs), MARKS)
                    rows = _matches(block, h, doc, hi - lo, least, seen)
                    if rows:
                        d, i, score, a, b = zip(*rows)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.array(d) + lo)), pa.array([block.ids[x] for x in i], pa.int64()), pa.array(score), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["doc_id", "item_id", "score", "first_word", "end_word"])

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(tidy(find), schema))
    return out


def without_leaks(docs: DataFrame, items: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no test item in the sense of :func:`leaks`. Rows pass through one worker and are not shuffled."""
    at = docs.columns.index("text")
    for block in _blocks(items):

        def keep(batches, block=block):
            seen = {}
            for batch in batches:
                clean = np.ones(len(batch), bool)
                for lo, hi, data, offs in slabs(batch.column(at)):
                    _, _, doc, h = words(*folded(data, offs), MARKS)
                    clean[[lo + m[0] for m in _matches(block, h, doc, hi - lo, least, seen)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(tidy(keep), docs.schema)
    return docs
