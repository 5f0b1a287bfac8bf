import random
from itertools import combinations

import numpy as np

from dayglass.llm import near_dedup
from dayglass.llm.components import components
from dayglass.llm.near_dedup import Matching, probability_jaccard, shingles, signatures


def slow_jaccard(a, b):
    x, y = (dict(zip(k.tolist(), v / v.sum())) for k, v in (a, b))
    every = x.keys() | y.keys()
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in every) for i in x.keys() & y.keys())


def test_probability_jaccard_by_definition():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = ((np.sort(rng.choice(30, 12, replace=False)).astype("u8"), rng.integers(1, 5, 12)) for _ in range(2))
        assert abs(probability_jaccard(a, b) - slow_jaccard(a, b)) < 1e-12


def test_registers_agree_as_often_as_texts_are_alike():
    rng = np.random.default_rng(2)
    elements = rng.integers(1, 2**60, 300).astype("u8")
    a = (elements[:200], rng.integers(1, 4, 200))
    b = (elements[60:260], np.r_[a[1][60:], rng.integers(1, 4, 60)])
    owner = np.repeat([0, 1], 200)
    held = signatures(owner, np.r_[a[0], b[0]], np.r_[a[1], b[1]].astype("f8"), 2, 4096)
    want = slow_jaccard((np.sort(a[0]), a[1][np.argsort(a[0])]), (np.sort(b[0]), b[1][np.argsort(b[0])]))
    assert abs((held[0] == held[1]).mean() - want) < 0.04


def test_components_by_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 560)]
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: root(n) for e in edges if e[0] != e[1] for n in e}


def variants(rng, base, n, edits):
    for _ in range(n):
        words = list(base)
        for _ in range(edits):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        yield " ".join(words)


def test_classes_by_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for group in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 300))]
        texts += list(variants(rng, base, 8, rng.randint(0, 3)))
    texts += [f"short {k % 3}" for k in range(9)] + ["", None, "x " * 40]
    rng.shuffle(texts)
    m = Matching()
    known = [shingles(t or "", m.words) for t in texts]
    parent = list(range(len(texts)))

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in combinations(range(len(texts)), 2):
        if (texts[a] or "") == (texts[b] or "") or probability_jaccard(known[a], known[b]) >= m.similarity:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {k: root(k) for k in range(len(texts))}
    assert {r.doc_id for r in near_dedup.keep_one(docs).collect()} == {root(k) for k in range(len(texts))}


def test_edge_rows(edge, empty):
    rows = near_dedup.near_duplicates(edge).collect()
    assert len(rows) == edge.count()
    assert {r.class_id for r in rows if r.doc_id in (1, 6)} == {1}
    assert {r.class_id for r in rows if r.doc_id in (2, 3)} == {2}
    kept = near_dedup.keep_one(edge)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 1, 2, 4, 5, 7, 7]
    assert near_dedup.near_duplicates(empty).count() == near_dedup.keep_one(empty).count() == 0


def test_unlike_texts_of_one_id(spark):
    rng = random.Random(7)
    bases = [" ".join(f"w{rng.randrange(3000)}" for _ in range(200)) for _ in range(3)]
    rows = [(7, t, "x") for t in bases] + [(8, bases[1] + " more", "x"), (3, bases[2] + " more", "x"), (7, bases[0], "a"), (7, "é", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    classes = {}
    for r in near_dedup.near_duplicates(docs).collect():
        classes.setdefault((r.class_id, r.class_key), []).append(r.doc_id)
    assert sorted((k[0], sorted(ids)) for k, ids in classes.items()) == [(3, [3, 7]), (7, [7]), (7, [7, 7]), (7, [7, 8])]
    want = sorted([(3, bases[2] + " more", "x"), (7, bases[0], "a"), (7, bases[1], "x"), (7, "é", "x")])
    for some in (docs, docs.orderBy("source"), docs.repartition(3)):
        assert sorted(map(tuple, near_dedup.keep_one(some).collect())) == want
