"""Token ids of whole texts, with the ids of their parts remembered by each worker.

A byte-level or word-level BPE never merges across the boundary between a word and the white space after it, so a text's
ids are the ids of its parts in order; nor across the one between a letter and a full stop or comma (with byte-level ones, a run of one mark). Parts are found and hashed as arrays over the bytes of many texts, looked up in an
open-addressing table of 64-bit hashes (beside the length, first and last byte of the part), and only new parts go to the
tokenizers library, hundreds joined in one call. The table is bounded: when it is full, only parts stay that have come back since they were learnt or it was last full. With byte-level
vocabularies a text that holds white space beyond ASCII is encoded whole, because there a run of mixed white space is not
cut where ASCII white space begins.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from wattframe.llm.texts import LOWER, WHITE, kept_between_tasks, marked, mix, slabs, words

#: Parts that a worker remembers (about 50 bytes each), and how many are joined for one call of the library.
REMEMBERED, JOINED = 1 << 20, 256
_END = "</w>"
_MARK, _LETTER, _RUN = (np.isin(np.arange(256), list(x)) for x in (b".,;:!?", bytes(range(65, 91)) + bytes(range(97, 123)), b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_loaded: dict[tuple[str, bool], Encoder] = {}
kept_between_tasks(_loaded.clear)


def _odd(data: np.ndarray) -> np.ndarray:
    """Where white space or a separator beyond the six ASCII ones may begin; some other characters count too."""
    found = [np.flatnonzero((data >= 0x1C) & (data <= 0x1F))]
    for first, *then in ((0xC2, 0x85, 0xA0), (0xE1, 0x9A), (0xE2, 0x80, 0x81), (0xE3, 0x80)):
        at = np.flatnonzero(data[:-1] == first)
        found.append(at[np.isin(data[at + 1], then)])
    return np.concatenate(found)


def _tails(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where one mark that no rule joins to others stands between an ASCII letter and white space or the end of a text: a part of its own."""
    at = np.flatnonzero(marked(data, _MARK))
    ends = np.zeros(len(data) + 1, bool)
    ends[offs] = True
    at = at[(at > 0) & (ends[at + 1] | WHITE[data[np.minimum(at + 1, len(data) - 1)]])]
    return at[_LETTER[data[at - 1]] & ~ends[at]]


def _closing_runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(start, end)`` of runs of one ASCII mark, repeated, between a Latin letter and white space or the end of a text: parts of their own in byte-level vocabularies.

    These cut between letters and other characters, but for the apostrophe, and nowhere in a run of marks; runs of different marks stay with their word.
    """
    at = np.flatnonzero(marked(data, _RUN))
    if not len(at):
        return at, at
    ends = np.zeros(len(data) + 1, bool)
    ends[offs] = True
    same = (at[1:] == at[:-1] + 1) & (data[at[1:]] == data[at[:-1]]) & ~ends[at[1:]]
    cut = np.flatnonzero(~same) + 1
    start, end = at[np.append(0, cut)], at[np.append(cut, len(at)) - 1] + 1
    before = data[np.maximum(start - 1, 0)]
    letter = _LETTER[before] | ((data[np.maximum(start - 2, 0)] == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7))
    keep = letter & ~ends[start] & (ends[end] | WHITE[data[np.minimum(end, len(data) - 1)]])
    return start[keep], end[keep]


class Encoder:
    """``spaced``: the white space before a word belongs to its part (byte-level vocabularies); else it is dropped."""

    def __init__(self, path: str, spaced: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.spaced = spaced
        # A letter of the vocabulary stands for a byte.
        named = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of, self.closes = np.zeros(max(named.values()) + 1, np.int64), np.zeros(max(named.values()) + 1, bool)
        for name, k in named.items():
            self.closes[k] = name.endswith(_END)
            self.bytes_of[k] = len(name.removesuffix(_END))
        self.forget()

    def forget(self) -> None:
        self.count = self.used = 0
        self.flat, self.start, self.again = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, bool)
        self._table(1 << 13)

    def shrink(self) -> None:
        """Forget parts that have not come back; all of them, if half of the room would still be taken."""
        held = np.flatnonzero(self.keys)
        held = held[self.again[self.number[held]]]
        key, check, (ids, sizes) = self.keys[held], self.checks[held], self._of(self.number[held])
        self.forget()
        if len(key) <= REMEMBERED // 2:
            self._put(key, check, ids, sizes)

    def _table(self, slots: int) -> None:
        self.keys, self.checks, self.number = np.zeros(slots, np.uint64), np.zeros(slots, np.uint32), np.zeros(slots, np.int32)

    def _find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The number of each part, or -1."""
        mask = np.uint64(len(self.keys) - 1)
        slot, found = (key & mask).view(np.int64), None
        while found is None or len(slot):
            there = self.keys.take(slot)
            same = (there == key) & (self.checks.take(slot) == check)
            number = np.where(same, self.number.take(slot), np.int32(-1))
            if found is None:  # most are in their first place
                found, todo = number, np.arange(len(key))
            else:
                found[todo] = number
            on = np.flatnonzero(~same & (there != 0))
            key, check, slot, todo = key[on], check[on], (slot[on] + 1) & np.int64(mask), todo[on]
        return found

    def _place(self, key: np.ndarray, check: np.ndarray, number: np.ndarray) -> None:
        mask = np.int64(len(self.keys) - 1)
        slot = (key & np.uint64(mask)).view(np.int64)
        while len(key):
            free = self.keys[slot] == 0
            self.number[slot[free]] = number[free]
            won = free & (self.number[slot] == number)
            self.keys[slot[won]], self.checks[slot[won]] = key[won], check[won]
            key, check, number, slot = key[~won], check[~won], number[~won], (slot[~won] + ~free[~won]) & mask

    def _put(self, key: np.ndarray, check: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Remember new parts; ``start`` has one entry more than there are parts."""
        n = self.count + len(key)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + 1 > len(self.start):
            self.start, self.again = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.again))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[self.count + 1 : n + 1] = self.used + np.cumsum(sizes)
        if 2 * n > len(self.keys):
            held = np.flatnonzero(self.keys)
            old = self.keys[held], self.checks[held], self.number[held]
            self._table(1 << (4 * n - 1).bit_length())
            self._place(*old)
        self._place(key, check, np.arange(self.count, n, dtype=np.int32))
        self.used, self.count = self.used + len(ids), n

    def _one_by_one(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in parts], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _joined(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Parts encoded as one text: ids of such vocabularies tell their bytes, and so where each part ends."""
        between = b"" if self.spaced else b" "
        runs = [parts[k : k + JOINED] for k in range(0, len(parts), JOINED)]
        texts = [between.join(r).decode("utf-8", "replace") for r in runs]
        ids, sizes = [], []
        for run, e in zip(runs, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            own = np.array(e.ids, np.uint32)
            ends, reached = np.cumsum(list(map(len, run))), np.cumsum(self.bytes_of[own])
            last = np.minimum(np.searchsorted(reached, ends), len(own) - 1)
            if (reached[last] == ends).all() and last[-1] == len(own) - 1 and (self.spaced or self.closes[own[last]].all()):
                size = np.diff(last + 1, prepend=0)
            else:
                own, size = self._one_by_one(run)
            ids.append(own)
            sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray, check: np.ndarray, plain: np.ndarray) -> None:
        raw = data.tobytes()
        for k, encode in ((np.flatnonzero(plain), self._joined), (np.flatnonzero(~plain), self._one_by_one)):
            if len(k):
                self._put(key[k], check[k], *encode([raw[a:b] for a, b in zip(start[k].tolist(), end[k].tolist())]))

    def _of(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = n.astype(np.int64)
        first = self.start.take(n)
        n += 1
        size = self.start.take(n) - first
        ends = np.cumsum(size)
        at = np.repeat(first - ends + size, size)
        at += np.arange(len(at))
        return self.flat.take(at), size

    def _parts(self, data: np.ndarray, offs: np.ndarray):
        """``start, end, document, key, check, plain`` of each part; ``plain`` parts may be joined."""
        if self.spaced:
            tail, close = _closing_runs(data, offs)
        else:
            tail = _tails(data, offs)
            close = tail + 1
        bare, long = data.copy(), close - tail
        bare[np.arange(long.sum()) + np.repeat(tail - np.cumsum(long) + long, long)] = 0x20
        start, end, doc, key = words(bare, offs, folded=not self.spaced)
        if len(tail):
            order = np.argsort(np.concatenate([start, tail]), kind="stable")
            start, end = np.concatenate([start, tail])[order], np.concatenate([end, close])[order]
            doc = np.concatenate([doc, np.searchsorted(offs, tail, "right") - 1])[order]
            key = np.concatenate([key, mix(data[tail] + (long.astype(np.uint64) << np.uint64(8)) + np.uint64(1 << 40))])[order]
        first = data[start].astype(np.uint32)
        last = data[end - 1].astype(np.uint32)
        if not self.spaced:
            first, last = LOWER[first].astype(np.uint32), LOWER[last].astype(np.uint32)
            plain = None
        else:
            begin = offs[:-1][doc]
            begin[1:] = np.where(doc[1:] == doc[:-1], end[:-1], begin[1:])
            reached = offs[:-1].copy()
            reached[doc] = end  # the last word of each document is written last
            tail = np.flatnonzero(reached < offs[1:])
            if len(tail):
                order = np.argsort(np.concatenate([2 * start, 2 * offs[1:][tail] - 1]), kind="stable")
                start, end, begin = (np.concatenate([x, y])[order] for x, y in ((start, offs[1:][tail]), (end, offs[1:][tail]), (begin, reached[tail])))
                doc = np.concatenate([doc, tail])[order]
                key = np.concatenate([key, np.full(len(tail), 77, np.uint64)])[order]
                first, last = (np.concatenate([x, np.zeros(len(tail), np.uint32)])[order] for x in (first, last))
            gap = start - begin
            white = np.zeros(len(gap), np.uint64)
            some = np.flatnonzero(gap)
            white[some] = data[begin[some]].astype(np.uint64) + np.uint64(1)
            plain = (gap == 1) & ((white == 0x21) | (white == 0x0B)) & (end > start)  # after one space or one line feed
            for k in np.flatnonzero(gap > 1):
                white[k] = np.frombuffer(hashlib.blake2b(data[begin[k] : start[k]].tobytes(), digest_size=8).digest(), np.uint64)[0]
            key = mix(key + white * _STEP)
            start = begin
        if plain is None:
            high = np.concatenate([[0], np.cumsum(data >= 128)])
            plain = high[end] == high[start]
        key[key == 0] = 1
        return start, end, doc, key, (end - start).astype(np.uint32) << np.uint32(16) | first << np.uint32(8) | last, plain

    def _slab(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, end, doc, key, check, plain = self._parts(data, offs)
        n = self._find(key, check)
        miss = np.flatnonzero(n < 0)
        self.again[n if not len(miss) else n[n >= 0]] = True
        while len(miss):
            new = miss[np.unique(key[miss], return_index=True)[1]]
            if self.count and self.count + len(new) > REMEMBERED:
                self.shrink()  # marks nothing, so that a second one in this loop would keep nothing
                n = self._find(key, check)
                miss = np.flatnonzero(n < 0)
                continue
            self._learn(data, start[new], end[new], key[new], check[new], plain[new])
            n[miss] = self._find(key[miss], check[miss])
            miss = miss[n[miss] < 0]  # two parts of one hash: the second is learnt in the next turn
        ids, size = self._of(n)
        return ids, np.concatenate([[0], np.cumsum(np.bincount(doc, size, len(offs) - 1))]).astype(np.int64)

    def runs(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``(first row, end row, ids, offsets)`` over runs of whole rows; a null counts as empty."""
        for lo, hi, data, offs in slabs(column):
            odd = np.unique(np.searchsorted(offs, _odd(data), "right") - 1) if self.spaced and len(data) else []
            if not len(odd):
                yield lo, hi, *self._slab(data, offs)
                continue
            ids, sizes, at = [], [], 0
            for k in [*odd.tolist(), hi - lo]:
                own, o = self._slab(data[offs[at] : offs[k]], offs[at : k + 1] - offs[at])
                ids.append(own)
                sizes.append(np.diff(o))
                if k < hi - lo:
                    whole = self.tokenizer.encode(data[offs[k] : offs[k + 1]].tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids
                    ids.append(np.array(whole, np.uint32))
                    sizes.append([len(whole)])
                at = k + 1
            yield lo, hi, np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, offsets)`` of all texts in order; a null counts as empty."""
        found = list(self.runs(pa.array(texts, pa.large_string())))
        sizes = [np.diff(o) for *_, o in found]
        return np.concatenate([np.zeros(0, np.uint32), *(x for _, _, x, _ in found)]), np.concatenate([[0], *sizes]).cumsum().astype(np.int64)


def encoder(path: str, spaced: bool) -> Encoder:
    """This worker's encoder for a vocabulary file, made once."""
    if (path, spaced) not in _loaded:
        _loaded[path, spaced] = Encoder(path, spaced)
    return _loaded[path, spaced]
