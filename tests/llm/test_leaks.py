import random

from test_text_models import plain_alignment

from wattframe.llm import op02_decontamination

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def test_seeds_of_many_edited_copies(spark):
    rnd = random.Random(3)
    item = [f"w{k}" for k in range(18)]
    edited = ["zz" if k in (4, 9, 14) else w for k, w in enumerate(item)]
    docs = [(i, " ".join([f"a{rnd.randrange(10**6)}", *edited, f"b{rnd.randrange(10**6)}"])) for i in range(1500)]
    docs += [(2000 + i, f"w0 w1 w2 c{i}") for i in range(200)]
    out = op02_decontamination.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(7, " ".join(item))], ITEMS)).collect()
    assert sorted((r.doc_id, r.item_id, r.score, r.first_word, r.end_word) for r in out) == [(i, 7, 27 / 36, 1, 19) for i in range(1500)]
    assert plain_alignment(item, edited) == 27


def test_windows_of_common_words(spark):
    rnd = random.Random(4)
    prose = lambda n: [rnd.choice("abcd") for _ in range(n)]
    items = [(k, prose(rnd.randint(8, 14))) for k in range(6)]
    docs = [(i, prose(rnd.randint(3, 40)) + items[i % 6][1][: -2 if i % 2 else None] + prose(9)) for i in range(60)] + [(i, prose(30)) for i in range(60, 150)]
    frames = [spark.createDataFrame([(i, " ".join(w)) for i, w in x], schema) for x, schema in ((docs, DOCS), (items, ITEMS))]
    out = {(r.doc_id, r.item_id): r.score for r in op02_decontamination.leaks(*frames, 0.6).collect()}
    best = {(i, k): plain_alignment(t, d) / (2 * len(t)) for i, d in docs for k, t in items}
    assert out.items() >= {p: x for p, x in best.items() if x >= 0.8}.items()
    assert all(0.6 <= x <= best[p] for p, x in out.items()) and {(i, i % 6) for i in range(60)} <= out.keys()


def test_case_of_all_letters(spark):
    items = ["La société a été créée à l'été où naît l'île", "Über größere Straßen führt der schöne Weg nach Süden", "Señor Ñandú añade cigüeñas ácidas él sólo", "Ο λόγος ένας όμορφος άνθρωπος ήταν ωραίος"]
    docs = [(k, f"123 {t.upper()} xyz") for k, t in enumerate(items)] + [(10 + k, t.lower()) for k, t in enumerate(items)] + [(20, "LA ÊTÉ"), (21, None)]
    frames = spark.createDataFrame(docs, DOCS), spark.createDataFrame(list(enumerate(items)), ITEMS)
    out = op02_decontamination.leaks(*frames).collect()
    assert sorted((r.doc_id, r.item_id, r.score) for r in out) == [(k + d, k, 1.0) for d in (0, 10) for k in range(4)]
    assert sorted(r.doc_id for r in op02_decontamination.without_leaks(*frames).collect()) == [20, 21]


def test_items_of_one_and_two_words(spark):
    items = [(1, "Xylophone"), (2, "grey Öre"), (3, "a b c d")]
    docs = [(1, "the xylophone rang"), (2, "some GREY ÖRE and a xylophone"), (3, "grey"), (4, "grey öre"), (5, "öre grey"), (6, "xylophone"), (7, "z a b c d z"), (8, None)]
    out = op02_decontamination.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted((r.doc_id, r.item_id, r.score, r.first_word, r.end_word) for r in out) == [(1, 1, 1.0, 1, 2), (2, 1, 1.0, 5, 6), (2, 2, 1.0, 1, 3), (4, 2, 1.0, 0, 2), (6, 1, 1.0, 0, 1), (7, 3, 1.0, 1, 5)]
