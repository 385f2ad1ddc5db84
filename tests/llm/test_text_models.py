import random
import zlib

import numpy as np
import pyarrow as pa

from wattframe.llm import op01_language, op02_decontamination, op04_html, op09_quality

SYLLABLES = {"aa": "the ing and ion er th".split(), "bb": "der ung ein ö sch ß".split(), "cc": "que é eau ç ou ai".split()}


def say(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def test_language(spark):
    rnd = random.Random(0)
    rows = [(i, say(rnd, lang, rnd.randint(3, 60)), lang, "s") for i in range(600) for lang in [rnd.choice(sorted(SYLLABLES))]]
    odd = [(1000, None, "aa", "s"), (1001, "", "bb", "s"), (1002, "12 !? \n", "aa", "s"), (1003, "ungein sch " * 20000, None, "s"), (None, "queou", "cc", "s")]
    out = {r.doc_id: r for r in op01_language.identified(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")).collect()}
    assert len(out) == 605
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(out[r[0]].held_out == (r in held) for r in rows)
    assert np.mean([out[r[0]].lang_pred == r[2] for r in held]) > 0.98
    assert [out[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and out[1003].lang_pred == "bb" and out[None].lang_pred == "cc"
    assert all(0 <= r.score <= 1 for r in out.values())
    assert op01_language.identified(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).first().lang_pred == "und"
    assert op01_language.identified(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def plain_alignment(a, b):
    best, prev = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(max(0, prev[j - 1] + (2 if x == y else -1), prev[j] - 1, row[j - 1] - 1))
        best, prev = max(best, *row), row
    return best


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(0)
    pairs = [(rng.integers(1, 6, rng.integers(1, 20)).astype(np.uint64), rng.integers(1, 6, rng.integers(1, 40)).astype(np.uint64)) for _ in range(200)]
    score, _ = op02_decontamination.align([a for a, _ in pairs], [b for _, b in pairs])
    assert score.tolist() == [plain_alignment(a.tolist(), b.tolist()) for a, b in pairs]


def test_leaks(spark, monkeypatch):
    rnd = random.Random(1)
    prose = lambda n: " ".join(rnd.choice("abcdefghijklmnopqrst") + str(rnd.randrange(300)) for _ in range(n))
    items = [(k, prose(rnd.randint(12, 40))) for k in range(30)] + [(90, None), (91, ""), (92, "!!")]
    docs, want = [], set()
    for i in range(200):
        text = prose(rnd.randint(5, 200))
        if i % 4 == 0:
            k, item = rnd.choice(items[:30])
            w = item.upper().split() if i % 8 else item.split()
            for _ in range(len(w) // 8 if i % 3 else 0):
                w[rnd.randrange(len(w))] = "zz"
            text = f"{text} {'; '.join(w)}. {prose(20)}"
            want.add((i, k))
        docs.append((i, text, 0.5))
    docs += [(500, None, 0.1), (501, "", 0.1), (502, items[0][1] + " x" * 100000, 0.1), (502, items[0][1], 0.1), (None, items[1][1], 0.1)]
    want |= {(502, 0), (None, 1)}
    df, bench = spark.createDataFrame(docs, "doc_id long, text string, score double"), spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 19, 60):
        monkeypatch.setattr(op02_decontamination, "BLOCK_WORDS", block)
        out = op02_decontamination.leaks(df, bench).collect()
        assert {(r.doc_id, r.item_id) for r in out} == want and len(out) == len(want) + 1
    left = op02_decontamination.without_leaks(df, bench)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == sorted(d[0] for d in docs if d[0] is not None and d[0] not in {i for i, _ in want})
    assert op02_decontamination.leaks(df, bench.limit(0)).count() == 0
    exact = {(d[0], k) for d in docs[:200] for k, t in items[:30] if plain_alignment(t.lower().split(), (d[1] or "").lower().replace(";", "").replace(".", "").split()) >= len(t.split())}
    assert exact == {w for w in want if w[0] is not None and w[0] < 200}


def test_pages_held_out():
    field = op04_html.trained()
    wrong = total = 0
    for seed in range(5000, 5150):
        html, truth = op04_html.labelled_page(seed)
        found = op04_html.blocks(html)
        got = field.decode([b.features for b in found])
        wrong += sum(a != b for a, b in zip(got, truth))
        total += len(truth)
    assert wrong < 0.005 * total


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(0)
    n = len(op04_html.FEATURES)
    for _ in range(30):
        f = op04_html.Field(rng.normal(size=(2, n)), rng.normal(size=(2, 2)), rng.normal(size=2))
        x = [list(rng.choice(n, 3, False)) for _ in range(rng.integers(1, 8))]

        def score(y):
            return f.begin[y[0]] + sum(f.state[l][v].sum() for l, v in zip(y, x)) + sum(f.step[a, b] for a, b in zip(y, y[1:]))

        best = max(np.ndindex(*[2] * len(x)), key=score)
        assert abs(score(best) - score([int(v) for v in f.decode(x)])) < 1e-9


def test_main_text(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
      <nav><ul><li><a href="/">Home</a></li><li><a href="/x">News</a></li></ul></nav><!-- <p>not this</p> --><div class="cookie-notice">We use cookies.</div>
      <article><h1>A &amp; B &#169; caf&eacute;</h1><p><b>First words\n of it.<br>Next<p>Second para with <a href="#">a link</a> inside it, long enough.</p><ul><li>One thing to know</ul></article>
      <section id="comments"><h3>Comments</h3><p>Great post, thanks for it!</p></section><aside class="sidebar"><p>Related things to read</p></aside><form><label>Your mail</label></form><footer>&copy; 2020 Us</footer></body></html>"""
    rows = [(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<p>Just some plain words in a paragraph that is long enough.", "x"), (5, "u", "<article><p>" + "very long words " * 50000 + "</p></article>", "x"), (6, "u", "<article><p>cut off &am", "x"), (6, "u", "<script>", "x")]
    out = {(r.page_id, r.n_chars): r.text for r in op04_html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    texts = {k[0]: v for k, v in out.items() if v} | {k[0]: v for k, v in out.items() if not v and k[0] != 6}
    assert texts[1] == "A & B © café\nFirst words of it. Next\nSecond para with a link inside it, long enough.\nOne thing to know"
    assert texts[2] == texts[3] == "" and len(texts[5]) == 50000 * 16 - 1 and texts[6] == "cut off &am"
    assert all(k[1] == len(v) for k, v in out.items())


def test_quality(spark):
    rnd = random.Random(2)
    docs, labels = [], []
    for i in range(900):
        good = rnd.random() < 0.7
        w = say(rnd, "aa", rnd.randint(8, 80)).split()
        docs.append((i, ". ".join(w) if good else " | ".join(w) if i % 2 else "### ".join(w), "s", 0.0))
        if i % 5:
            labels.append((i, int(good), 0))
    docs += [(2000, None, "s", 0.0), (2001, "", "s", 0.0), (2002, "word. " * 60000, "s", 0.0), (None, "some words. of it.", "s", 0.0)]
    df, known = spark.createDataFrame(docs, "doc_id long, text string, source string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in op09_quality.scored(df, known).collect()}
    held = [(i, q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([out[i].predicted == q for i, q in held]) > 0.97 and all(out[i].held_out for i, _ in held)
    assert out[2000].score == out[2001].score and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    kept = op09_quality.of_quality(df, known)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.predicted}
    assert {r.score for r in op09_quality.scored(df, known.limit(0)).collect()} == {0.5}
    assert op09_quality.scored(df.limit(0), known).count() == 0


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(0)
    x = rng.random((500, len(op09_quality.FEATURES)))
    y = (x[:, 0] * x[:, 1] > 0.25).astype(float)
    m = op09_quality.fit(x, y)
    total = m.base + sum(m.tables[j][np.searchsorted(m.cuts[j], x[7, j], "right")] for j in range(x.shape[1]))
    total += sum(t[np.searchsorted(m.pair_cuts[i], x[7, i], "right"), np.searchsorted(m.pair_cuts[j], x[7, j], "right")] for (i, j), t in zip(m.pairs, m.pair_tables))
    assert abs(m.score(x[7:8])[0] - 1 / (1 + np.exp(-total))) < 1e-12 and ((m.score(x) > 0.5) == y).mean() > 0.95


def test_features_do_not_depend_on_neighbours():
    texts = ["", "A b. C\nA b. C\n", "漢字 x", "| |", "a" * 5000, "Z"]
    from wattframe.llm.texts import slabs

    for _, _, data, offs in slabs(pa.array(texts)):
        whole = op09_quality.features(data, offs)
    for t, row in zip(texts, whole):
        data = np.frombuffer(t.encode(), np.uint8)
        assert np.allclose(op09_quality.features(data, np.array([0, len(data)]))[0], row)
