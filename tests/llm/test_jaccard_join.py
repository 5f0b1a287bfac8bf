import random
import re
from itertools import combinations

import numpy as np
import pytest

from dayglass.llm import jaccard_join as J

SPLIT = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = SPLIT.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()


def expected(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(k)] = min(least.get(root(k), doc_id), doc_id)
    return sorted(((d, len(sets[k]), least.get(root(k))) for k, (d, _) in enumerate(rows)), key=repr)


def edited(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("j", [J.Join(), J.Join(leaders=0, longest=1), J.Join(leaders=2, longest=30)])
def test_by_brute_force(spark, j):
    rng = random.Random(6)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randrange(2000)}" for _ in range(rng.choice((40, 70, 120, 300)))]
        texts += [edited(rng, base, rng.choice((0, 1, 1, 2, 3))) for _ in range(25)]
        texts += [" ".join(base[: rng.randrange(len(base) // 2, len(base))]) for _ in range(5)]
    long = [f"L{rng.randrange(10**5)}" for _ in range(9000)]
    texts += [edited(rng, long, k) for k in (0, 50, 130, 300, 900)] + [" ".join(long[4000:]), "A b", "a  B", "one", "", None, " \n", "x y z", "x y z", "X Y Z x"]
    rng.shuffle(texts)
    rows = [(k if k % 17 else None, t) for k, t in enumerate(texts)] + [(3, "another text of id three"), (3, "another text of id three")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS n", "2 AS node", "3 AS token", "4 AS k1", "5 AS component")
    got = sorted(map(tuple, J.jaccard_components(df.repartition(4), j).collect()), key=repr)
    assert got == expected(rows)


def test_edge_rows(edge, empty):
    assert sorted(map(tuple, J.jaccard_components(edge).collect()), key=repr) == expected([(r.doc_id, r.text) for r in edge.collect()])
    assert J.jaccard_components(empty).count() == 0


def test_bounds_never_exceed_the_difference():
    rng = np.random.default_rng(8)
    for n, m, shared in ((300, 280, 250), (5000, 4600, 4500), (9000, 9000, 100)):
        pool = rng.integers(0, 2**63, n + m, "u8")
        x, y = np.sort(pool[:n]), np.sort(np.r_[pool[:shared], pool[n : n + m - shared]])
        odd = sum(bin((a ^ b) & (2**64 - 1)).count("1") for a, b in zip(J.parities(x), J.parities(y)))
        assert odd <= n + m - 2 * shared
        if min(n, m) > J.LONG:
            assert J.apart(J.bin_counts(x), J.bin_counts(y)) <= n + m - 2 * shared


def test_prefixes_grow_with_estimated_candidates():
    tokens = np.sort(np.random.default_rng(9).integers(0, 2**64, 200, "u8"))
    j = J.Join()
    rare, common = np.zeros(J.PLACES), np.zeros(J.PLACES)
    common[J.place(tokens)] = 1000
    assert J.lengthening(J.in_order(tokens, rare), rare, 0.0, j) == 1
    assert J.lengthening(J.in_order(tokens, common), common, 0.0, j) > 4
