import random
import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from wattframe.llm import op08_jaccard as op

SCHEMA = "doc_id long, text string, sig string"


def brute(rows, n, num, den):
    sets = {}
    for i, text, *_ in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def got(spark, rows, n, num, den):
    out = op.near_duplicates(spark.createDataFrame(rows, SCHEMA), n, num, den).collect()
    assert len(out) == len(rows)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in out}


def corpus(seed, groups=8, size=30):
    rnd, rows = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{rnd.randrange(200)}" for _ in range(rnd.choice([6, 12, 40, 90, 300]))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4, 9])):
                copy[rnd.randrange(len(copy))] = f"x{rnd.randrange(50)}"
            rows.append((len(rows) + 5, " ".join(copy), "s"))
    rows += [(1, None, None), (2, "", ""), (3, " \n\t", "x"), (4, "One two", "x")]
    return rows


@pytest.mark.parametrize("n,num,den", [(3, 9, 10), (5, 4, 5)])
def test_same_components_as_brute_force(spark, n, num, den):
    rows = corpus(n * den)
    assert got(spark, rows, n, num, den) == brute(rows, n, num, den)


@pytest.mark.parametrize("n,num,den,edits", [(3, 9, 10, 16), (5, 4, 5, 24)])
def test_one_large_group_near_the_threshold(spark, n, num, den, edits):
    """Independent edits of one text: many are linked to it, many only to each other or to nothing."""
    rnd = random.Random(n)
    base, rows = [f"w{rnd.randrange(5000)}" for _ in range(300)], []
    for k in range(160):
        copy = list(base if k % 4 or not rows else rnd.choice(rows)[1].split())
        for _ in range(rnd.randrange(edits)):
            at = rnd.randrange(len(copy))
            copy[at : at + rnd.randrange(2)] = [f"x{rnd.randrange(5000)}"] * rnd.randrange(2)
        rows.append((k + 3, " ".join(copy), "s"))
    want = brute(rows, n, num, den)
    assert 3 < len({c for _, c in want.values()}) < 140
    assert got(spark, rows, n, num, den) == want


def test_empty_table(spark):
    assert got(spark, [], 3, 9, 10) == {}


def test_null_ids_and_repeated_rows(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(None, text, ""), (7, text, ""), (7, text, ""), (3, text.upper(), "")], SCHEMA)
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in op.near_duplicates(df).collect()) == [(0, 0), (3, 3), (7, 3), (7, 3)]


def test_texts_of_one_id_are_one_document(spark):
    one, two = "a b c d e f g h", "k l m n o p q r"
    df = spark.createDataFrame([(9, one, ""), (9, two, ""), (4, one + " i", ""), (7, two, ""), (8, None, "")], SCHEMA)
    assert sorted((r.doc_id, r.component_id) for r in op.near_duplicates(df, 3, 4, 5).collect()) == [(4, 4), (7, 4), (8, 8), (9, 4), (9, 4)]


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(1, 400), st.integers(0, 10**6), st.sampled_from([(9, 10), (4, 5), (1, 2)]))
def test_linked_sets_share_a_combination(n, seed, sim):
    num, den = sim
    rng = np.random.default_rng(seed)
    pool = rng.permutation(np.unique(rng.integers(0, 1 << 63, 2 * n + 4, dtype=np.uint64)))
    count = rng.choice([2, 5, 8, 9, 30, 64, 65, 500], len(pool), p=rng.dirichlet(np.ones(8)))
    most = n * (den - num) // num + 1
    drop, add = rng.integers(0, n), rng.integers(0, most + 1)
    for drop in {int(drop), 0, n * (den - num) // den}:
        a, b = np.arange(n), np.arange(drop, n + add)
        if den * (n - drop) >= num * (n + add):
            # Those that only one of the two has may have no other owner; such tokens are not listed.
            lists = [x[np.isin(x, y) | (rng.random(len(x)) < rng.random())] for x, y in ((a, b), (b, a))]
            lists = [x[np.lexsort((pool[x], count[x]))] for x in lists]
            both, offs = np.concatenate(lists), np.array([0, len(lists[0]), len(lists[0]) + len(lists[1])])
            doc, sig = op.combinations(pool[both], count[both], offs, np.array([len(a), len(b)]), num, den)
            assert len(np.intersect1d(sig[doc == 0], sig[doc == 1]))


@pytest.mark.parametrize("num,den,width", [(9, 10, 3), (4, 5, 5), (1, 2, 1), (1, 10, 7)])
def test_first_tokens(num, den, width):
    """Of linked sets each has enough of its lowest tokens among the lowest of the other."""
    rng = np.random.default_rng(num)
    for _ in range(3000):
        n = int(rng.integers(1, 120))
        drop = int(rng.integers(0, n))
        add = int(rng.integers(0, n * (den - num) // num + 2))
        if den * (n - drop) >= num * (n + add):
            pool = rng.permutation(n + add)
            a, b = np.sort(pool[:n]), np.sort(pool[drop:])
            first = [x[: op._missing(len(x), num, den) + op._beyond(len(x), num, den, width)] for x in (a, b)]
            for x in (a, b):
                assert len(np.intersect1d(*first)) >= op._beyond(-(-num * len(x) // den), num, den, width)
