import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from wattframe.llm import op07_suffix as op
from wattframe.llm import texts as texts_
from wattframe.llm import tokens


def brute(texts, length):
    seen = {}
    bodies = [(t or "").encode() for t in texts]
    for b in bodies:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in bodies:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def corpus(seed, n=120):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé漢") for _ in range(rnd.randint(1, 8)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [prose(rnd.randint(30, 120)) for _ in range(6)]
    texts = [None, "", "x", "a" * 900, "ab" * 300, prose(40) + "q" * 250]
    for _ in range(n):
        p = rnd.choice(passages)
        a, b = sorted(rnd.randrange(len(p)) for _ in range(2))
        texts.append(rnd.choice([prose(60), prose(20) + p + prose(20), p[a:b] + prose(30), prose(9) + p[a:], p, p + p[::-1] + p[:b]]))
    return texts + texts[10:20]


@pytest.mark.parametrize("length,hot", [(200, False), (60, False), (60, True), (200, True)])
def test_same_as_brute_force(spark, monkeypatch, length, hot):
    if hot:
        monkeypatch.setattr(op, "HOT", 2)
    monkeypatch.setattr(op, "BATCH", 50)
    texts = corpus(length + hot)
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, h string"), length).collect()}
    want = brute(texts, length)
    assert len(got) == len(rows)
    assert [i for i in got if got[i] != want[i]] == []


def test_long_texts_by_segments(spark, monkeypatch):
    """Texts of many segments, spans over their borders, and rows of one id or of none."""
    monkeypatch.setattr(op, "SEGMENT", 700)
    rnd = random.Random(3)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(9000))
    texts = [long, "z" + long[2000:5200], long[8700:] + "y" * 90, "q" * 4000, long[100:260], "".join(rnd.choice("abcdefgh ") for _ in range(5000))]
    rows = [(7, t, "x") for t in texts[:2]] + [(None, t, "x") for t in texts[2:]]
    out = op.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, body string"), 150).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == sorted(brute(texts, 150))
    assert sorted(r.doc_id or 0 for r in out) == [0, 0, 0, 0, 7, 7]


def test_a_text_of_megabytes(spark):
    rnd = np.random.default_rng(5)
    long = bytes(rnd.integers(97, 123, 10_000_000, np.uint8)).decode()
    rows = [(1, long), (2, long[3_000_000:3_000_500]), (3, "short")]
    out = {r.doc_id: r for r in op.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(out[k].n_removed, out[k].n_spans) for k in (1, 2, 3)] == [(500, 1), (500, 1), (0, 0)]
    assert out[1].kept_sha256 == hashlib.sha256((long[:3_000_000] + long[3_000_500:]).encode()).hexdigest()


def test_empty_table(spark):
    assert op.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cut_texts_keeps_columns_and_characters(spark):
    passage = "漢字" * 60
    rows = [(1, "début " + passage + " fin", "a", 5), (2, passage + "!", "b", 5), (3, None, "c", 5), (4, "short", "d", 5)]
    out = {r.doc_id: r for r in op.cut_texts(spark.createDataFrame(rows, "doc_id long, text string, rid string, n_chars long")).collect()}
    assert out[1].text == "début  fin" and out[2].text == "!" and out[3].text is None and out[4].text == "short"
    assert out[1].n_chars == 10 and out[3].n_chars == 5 and out[1].rid == "a"


def test_memory_of_one_batch_of_contexts():
    """Temporary arrays of a sort of a full batch are a small multiple of its bytes."""
    rnd, n, k = np.random.default_rng(2), op.BATCH, op.GRAM
    width = 400 - k
    pieces = pa.array([x.tobytes() for x in rnd.integers(97, 123, (n, width), np.uint8)], pa.binary())
    number = pa.array(np.arange(n))
    columns = {"h": number, "ctx": number, "copies": number, "left": pa.array(np.zeros(n, np.int32)), "piece": pieces, "rid": pa.array([b"x" * 16] * n, pa.binary()), "pos": number, "slab": number}
    batch = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    tracemalloc.start()
    try:
        assert sum(map(len, op._sorted_groups(iter([batch]), 200, k))) == 0
        assert tracemalloc.get_traced_memory()[1] < 6 * n * width
    finally:
        tracemalloc.stop()


def test_matrix_by_slabs():
    rnd = np.random.default_rng(4)
    left = rnd.integers(0, 150, 3000)
    pieces = [rnd.integers(0, 256, rnd.integers(0, 351 - a), np.uint8).tobytes() for a in left]
    rows, right = op._matrix(left, pa.array(pieces, pa.binary()), 200, 50)
    want = np.full((3000, 350), 255, np.uint8)
    for row, a, p in zip(want, left, pieces):
        row[a : a + len(p)] = np.frombuffer(p, np.uint8)
    assert (rows == want).all() and (right == left + [len(p) for p in pieces]).all()


def test_workers_drop_what_another_operator_left(monkeypatch):
    def task(batches):
        yield len(tokens._loaded), len(texts_._powers[0])

    def of(module):
        monkeypatch.setattr(task, "__module__", module)
        return next(texts_.tidy(task)(iter(())))

    of("packing")
    monkeypatch.setitem(tokens._loaded, ("vocabulary", False), None)
    texts_.powers(10)
    assert of("packing")[0] == 1 and of("packing")[1] > 0
    assert of("suffix") == (0, 0)


def test_rows_with_and_without_spans(spark):
    rows = spark.range(100).select(op.F.col("id").alias("doc_id"), op.F.lit(b"x").alias("body"), op.F.col("id").cast("string").cast("binary").alias("rid"))

    hit, rest = op._divided(rows, rows.where("doc_id < 7").select("rid"))
    assert hit.count() == 7 and rest.count() == 93
