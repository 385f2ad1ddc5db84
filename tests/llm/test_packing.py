import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wattframe.llm import op06_packing as op
from wattframe.llm.tokens import Encoder

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["  a  b \n\n c\t\td 's it's  ", "\x1cabc !\x1d x", " x  y", "abc 　 def", "é ́x", "İI Σ ΑΣ", "a\x85b <|endoftext|> c<|startoftext|>d", " " * 5, "\n", "​ x", "", None, "Don't, won't! x.y.", "漢字 かな, été... 12 345"]


def test_ids_are_the_librarys():
    for path, spaced in ((WORDS, False), (BYTES, True)):
        lib, own = Tokenizer.from_file(path), Encoder(path, spaced)
        lib.encode_special_tokens = True
        for _ in range(2):
            ids, offs = own.encode(ODD)
            for k, t in enumerate(ODD):
                assert ids[offs[k] : offs[k + 1]].tolist() == lib.encode(t or "", add_special_tokens=False).ids, t


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\t\x0b\x1c\x85 aébc'.,!#|1é́漢"), max_size=40))
def test_ids_of_any_text(text):
    for path, spaced in ((WORDS, False), (BYTES, True)):
        lib, own = LIB[path], OWN[path]
        assert own.encode([text])[0].tolist() == lib.encode(text, add_special_tokens=False).ids


LIB = {p: Tokenizer.from_file(p) for p in (WORDS, BYTES)}
OWN = {WORDS: Encoder(WORDS, False), BYTES: Encoder(BYTES, True)}
for _t in LIB.values():
    _t.encode_special_tokens = True


def best_fit_decreasing(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, k) for k, r in enumerate(free) if r >= n]
        if fits:
            free[min(fits)[1]] -= n
        else:
            free.append(capacity - n)
    return sorted(free)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200))
def test_plan_is_best_fit_decreasing(lengths):
    counts = {n: lengths.count(n) for n in lengths}
    steps = sorted(op.plan(counts, 50))
    filled = {}
    for n, c in counts.items():
        own = [s for s in steps if s[0] == n]
        for rank in range(c):
            _, first, per, b, offset = max(s for s in own if s[1] <= rank)
            j = rank - first
            filled.setdefault(b + j // per, []).append((offset + j % per * n, n))
    for spans in filled.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 50
    assert sorted(50 - sum(n for _, n in s) for s in filled.values()) == best_fit_decreasing(lengths, 50)


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(op, "PER_BUCKET", 10)
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice(["the", "of", "thtion"]) for _ in range(rnd.choice([3, 3, 3, 50, 700]))), "z") for i in range(150)] + [(900, None, "z"), (901, "", "z"), (902, "word " * 9000, "z"), (None, "a b", "z"), (0, "same", "z"), (0, "same", "z")]
    out = op.packed_documents(spark.createDataFrame(rows, "doc_id long, text string, rank string"), WORDS).collect()
    byseq, bydoc = {}, {}
    for r in out:
        byseq.setdefault(r.sequence_id, []).append(r)
        bydoc.setdefault(r.doc_id, []).append(r)
    for rs in byseq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    for i, t, _ in rows[1:-2]:
        ids = np.array(LIB[WORDS].encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        rs = sorted(bydoc[i], key=lambda r: r.piece)
        assert [(r.start, r.length, r.ids_crc32) for r in rs] == [(a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for a in range(0, len(ids), 4096)]
    assert len(byseq) == len(best_fit_decreasing([r.length for r in out], 4096))
    assert op.packed_documents(spark.createDataFrame([], "doc_id long, text string"), WORDS).count() == 0
