"""Vectorised views of text columns: byte slabs, words and shingles of many documents at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are looked at together; temporary arrays are a small multiple of it.
SLAB = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: All of ASCII but letters and digits.
MARKS = np.array([not (c >= 128 or chr(c).isalnum()) for c in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 64, 256, np.uint64)
_LOWERED = _BYTE[LOWER]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_P = 0xD6E8FEB86659FD93
_powers: list[np.ndarray] = [np.zeros(0, np.uint64)] * 2


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number and of its inverse, modulo 2 ** 64; kept for slabs of usual size."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    size = max(n, SLAB + 1)
    found = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (_P, pow(_P, -1, 1 << 64))]
    if size <= 2 * SLAB:
        _powers[:] = found
    return found[0][:n], found[1][:n]


#: Rows that go to a Python worker together; texts may be long.
ROWS = 1000


def small_batches(df):
    """``df``, in a session that sends at most ``ROWS`` rows to a Python worker at once."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)
    return df


def _forget_powers() -> None:
    _powers[:] = [np.zeros(0, np.uint64)] * 2


#: What empties the tables that a worker keeps between tasks, and the module whose tasks they are kept for.
_kept: list[Callable[[], object]] = [_forget_powers]
_kept_for: list[str] = [""]


def kept_between_tasks(empty: Callable[[], object]) -> None:
    """Have ``empty`` called where a task of another operator begins in this process."""
    _kept.append(empty)


def begin(owner: str) -> None:
    """A task of the module ``owner`` begins: tables that tasks of another one have left go."""
    if _kept_for[0] not in ("", owner):
        for empty in _kept:
            empty()
    _kept_for[0] = owner


def tidy(f):
    """The map ``f`` over Arrow batches, giving freed memory back when a task ends, and what another operator has left when it begins: idle workers stay small."""
    owner = f.__module__

    def run(batches):
        import ctypes

        begin(owner)
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def slabs(column: pa.Array, limit: int = SLAB) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` over runs of whole rows of about ``limit`` bytes; a null counts as empty.

    A row longer than the limit is a run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def marked(data: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Whether each byte is one of ``which``, a table of 256 truth values: faster than ``which[data]``."""
    return np.frombuffer(data.tobytes().translate(which.tobytes()), bool)


def words(data: np.ndarray, offs: np.ndarray, white: np.ndarray = WHITE, folded: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, document, hash)`` of every run of bytes outside ``white`` (ASCII white space, unless told otherwise); if ``folded``, A-Z count as a-z in the hash."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    black = ~white[data]
    first, last = black.copy(), black.copy()
    first[1:] &= ~black[:-1]
    last[:-1] &= ~black[1:]
    full = offs[1:] > offs[:-1]
    at = offs[:-1][full]
    first[at] |= black[at]
    at = offs[1:][full] - 1
    last[at] |= black[at]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    doc = np.searchsorted(offs, start, "right") - 1
    forward, back = powers(n + 1)
    value = (_LOWERED if folded else _BYTE)[data]
    value *= forward[:n]
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(value, out=total[1:])
    return start, end, doc, mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64) * _STEP)


def shingles(hashes: np.ndarray, doc: np.ndarray, n_docs: int, n: int, short_whole: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(document, hash, first word)`` of the runs of ``n`` words; with ``short_whole`` a document of fewer words has its whole sequence as one."""
    count = np.bincount(doc, minlength=n_docs) if len(doc) else np.zeros(n_docs, np.int64)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]

    def fold(at: np.ndarray, k: int) -> np.ndarray:
        acc = np.full(len(at), k, np.uint64)
        for j in range(k):
            acc = mix(acc * _STEP + hashes[at + j])
        return acc

    m = len(hashes)
    at = np.flatnonzero(doc[: m - n + 1] == doc[n - 1 :]) if m >= n else np.zeros(0, np.int64)
    docs, values, places = [doc[at]], [fold(at, n)], [at]
    if short_whole:
        for k in range(1, n):
            d = np.flatnonzero(count == k)
            docs.append(d)
            values.append(fold(first[d], k))
            places.append(first[d])
    return np.concatenate(docs), np.concatenate(values), np.concatenate(places)


def distinct_sets(doc: np.ndarray, value: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each document, ascending within it, and the offsets of the documents among them."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    doc, value = doc[keep], value[keep]
    return value, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n_docs))]).astype(np.int64)
