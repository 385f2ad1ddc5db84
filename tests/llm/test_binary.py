import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wattframe.llm import op10_binary as op
from wattframe.llm import tokens
from wattframe.llm.texts import marked
from wattframe.llm.texts import slabs as tokens_slabs

PATH = public_tokenizers.path("byte_bpe_50k.json")
ENCODER = tokens.Encoder(PATH, spaced=True)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 3000), st.integers(1, 60000), st.integers(0, 10**6), st.sampled_from([1, 7, 64, 4096]), st.booleans())
def test_round_trip_of_ids(n, top, seed, block, repeat):
    rng = np.random.default_rng(seed)
    ids = (rng.zipf(1.3, n) % top).astype(np.uint32)
    if repeat and n > 20:
        ids[n // 2 :] = ids[: n - n // 2]
    table, frames = op.encode_chunk(ids, block)
    assert (op.decode_chunk(table, frames, block) == ids).all()


def test_predictions_pay():
    ids = np.tile(np.random.default_rng(0).integers(0, 50000, 500).astype(np.uint32), 40)
    assert sum(map(len, op.encode_chunk(ids)[1])) < 0.3 * 2 * len(ids)


def test_a_broken_block_is_noticed():
    ids = np.random.default_rng(0).integers(0, 50000, 5000).astype(np.uint32)
    table, frames = op.encode_chunk(ids)
    frames[1] = frames[1][:10] + bytes([frames[1][10] ^ 1]) + frames[1][11:]
    with pytest.raises(op.BrokenBlock):
        op.decode_chunk(table, frames)


def test_rows_of_one_id_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(op, "LANES", 3)  # many chunks, of several runs of lanes
    monkeypatch.setattr(op, "BLOCK", 64)
    rows = [(5, f"text {k} " * (k + 1)) for k in range(40)] + [(4, "x"), (6, "y " * 5000)]
    both = [op.round_trip(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), PATH).collect() for n in (3, 5)]
    one, two = (sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in x) for x in both)
    assert one == two and [r[1] for r in one] == [4] + [5] * 40 + [6]
    assert [r[0] for r in one] == np.cumsum([0] + [r[2] for r in one[:-1]]).tolist()


def test_skewed_tables():
    """Ids far below one in a hundred thousand, and one that is nearly all."""
    ids = np.zeros(300_000, np.uint32)
    ids[::997] = np.arange(len(ids[::997])) + 1
    table, frames = op.encode_chunk(ids, 4096)
    assert (op.decode_chunk(table, frames, 4096) == ids).all() and sum(map(len, frames)) < len(ids) / 16
    every = np.random.default_rng(1).permutation(50257).astype(np.uint32)
    table, frames = op.encode_chunk(every, 512)
    assert (op.decode_chunk(table, frames, 512) == every).all()


def test_documents(spark):
    lib = Tokenizer.from_file(PATH)
    lib.encode_special_tokens = True
    rows = [(k * 7 % 501, f"Text {k} of some words,  \n and {k * k}. " * (k % 13), "x") for k in range(1, 400)] + [(1000, None, "x"), (1001, "", "x"), (1002, "long text " * 30000, "x")]
    got = {r.doc_id: r for r in op.round_trip(spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(7), PATH).collect()}
    at = 0
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes())), i
        at += len(ids)
    twice = op.round_trip(spark.createDataFrame([(None, "a"), (3, "b"), (3, "b")], "doc_id long, text string"), PATH).collect()
    assert sorted(r.start for r in twice) == [0, 2, 4]
    assert op.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_frequent_parts_outlive_a_full_table(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 60)
    enc, learnt, learn = tokens.Encoder(PATH, spaced=True), [], tokens.Encoder._learn
    monkeypatch.setattr(tokens.Encoder, "_learn", lambda self, data, start, end, *rest: learnt.extend(data[a:b].tobytes() for a, b in zip(start, end)) or learn(self, data, start, end, *rest))
    texts = [f"the same words and number{k} {k * 7919} again" for k in range(300)]
    found = [enc.encode([t])[0].tolist() for t in texts]
    plain = Tokenizer.from_file(PATH)
    assert found == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert learnt.count(b" words") == 1 and enc.count <= 60
    many = [" ".join(f"{w}{k}" for k in range(100)) for w in "ab"]  # more at once than there is room for
    assert [enc.encode([t])[0].tolist() for t in many * 2] == [plain.encode(t, add_special_tokens=False).ids for t in many * 2]


def plain_blocks(payloads, n, f, block):
    """The ranks of the blocks, one by one and in whole numbers."""
    cum, out = np.cumsum(f) - f, []
    slot = np.repeat(np.arange(len(f)), f).tolist()
    for k, p in enumerate(payloads):
        digits = iter([*np.frombuffer(p, ">u2").tolist(), *[0] * 9])
        one, two, last, before, width = {}, {}, 0, 0, 1 << 48
        code = (next(digits) << 32) + (next(digits) << 16) + next(digits)
        for _ in range(min(block, n - k * block)):
            spots = (one, (last * 4051 >> 4) % op.ONE), (two, (last * 4051 + before * 3001 >> 3) % op.TWO)
            (a, ca), (b, cb) = (t.get(at, (0, 0)) for t, at in spots)
            wa, wb = (2**ca - 1) * op.WEIGHT, (2**cb - 1) * op.WEIGHT * (a != b)
            r = width // (wa + wb + op.TOTAL)
            target = code // r
            if target < wa:
                s, start, freq = a, 0, wa
            elif target < wa + wb:
                s, start, freq = b, wa, wb
            else:
                s = slot[target - wa - wb]
                start, freq = wa + wb + int(cum[s]), int(f[s])
            code, width = code - r * start, r * freq
            while width < 1 << 32:
                code, width = (code << 16) + next(digits), width << 16
            for (t, at), (x, c) in zip(spots, ((a, ca), (b, cb))):
                t[at] = (x, min(c + 1, 7)) if x == s else (x, c - (c + 1) // 2) if c > 1 else (s, 1)
            before, last = last, s
            out.append(s)
    return out


@pytest.mark.parametrize("n, top, block", [(5000, 40, 512), (3001, 60000, 700), (300, 3, 4096), (4096, 2000, 4096)])
def test_a_plain_coder_reads_the_same(n, top, block):
    ranks = np.random.default_rng(n).zipf(1.3, n) % top
    ranks[n // 3 : n // 2] = ranks[: n // 2 - n // 3]
    names, f = op.frequency_table(ranks)
    ranks = np.searchsorted(names, ranks)
    payloads = op.encode_blocks(ranks, f, block)
    assert plain_blocks(payloads, n, f, block) == ranks.tolist() == op.decode_blocks(payloads, n, f, block).tolist()


def test_no_step_branches_by_lane(monkeypatch):
    """``np.where`` on choices that differ from lane to lane had a large part of the coder's time."""
    monkeypatch.setattr(op.np, "where", None)
    ids = (np.random.default_rng(3).zipf(1.3, 9000) % 5000).astype(np.uint32)
    assert (op.decode_chunk(*op.encode_chunk(ids, 512), 512) == ids).all()


def test_marks_at_every_end(monkeypatch):
    """Parts that end in marks, at ends of texts and of slabs, with a table that moves parts on to later places."""
    lib = Tokenizer.from_file(PATH)
    monkeypatch.setattr(tokens, "mix", lambda x: x & np.uint64(~0xFFF & (1 << 64) - 1))  # all start from few places
    texts = ["end.", ".", "", "a.", "b,c. d;", "é. x!", "x.\n", "no end", "!? !", "word word. word," * 3]
    for size in (1, 5, 1 << 20):
        monkeypatch.setattr(tokens, "slabs", lambda column, size=size: tokens_slabs(column, size))
        enc = tokens.Encoder(PATH, spaced=True)
        for _ in range(2):
            ids, offs = enc.encode(texts)
            assert [ids[a:b].tolist() for a, b in zip(offs, offs[1:])] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    enc = tokens.Encoder(PATH, spaced=True)
    monkeypatch.setattr(enc, "_one_by_one", None)
    assert enc.encode([" word\nnext word"])[0].tolist() == lib.encode(" word\nnext word", add_special_tokens=False).ids
    data = np.arange(256, dtype=np.uint8)[::-1]
    assert (marked(data, tokens.WHITE) == tokens.WHITE[data]).all() and len(marked(data[:0], tokens.WHITE)) == 0


def test_runs_of_marks_are_parts(monkeypatch):
    enc, learnt, learn = tokens.Encoder(PATH, spaced=True), [], tokens.Encoder._learn
    monkeypatch.setattr(tokens.Encoder, "_learn", lambda self, data, start, end, *rest: learnt.extend(data[a:b].tobytes() for a, b in zip(start, end)) or learn(self, data, start, end, *rest))
    enc.encode([" word word*** word&&& café café### word.*** 3×!!"])
    assert sorted(learnt) == sorted([b" word", b"***", b"&&&", " café".encode(), b"###", b" word.***", " 3×!!".encode()])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "Be", "é", "Ét", "×", "÷", "Ł", "中", "7", "'", "'s", "'re", "!", "!!", "***", "###", ".", ",", "_", "<|endoftext|>", "&&&", " ", " ", " ", "  ", "\n", "\n", "\t", "\r\n", "\x0b", "\u00a0", "\x1f", "\x00", "the", "word"]), max_size=25).map("".join), max_size=6))
def test_ids_are_the_librarys(texts):
    lib = ENCODER.tokenizer
    ids, offs = ENCODER.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offs, offs[1:])] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
