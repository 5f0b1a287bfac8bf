import numpy as np
import pytest

from dayglass.llm import ann
from dayglass.llm.fingerprints import Sampling, edited_fingerprints, fingerprints, likeness, signatures

GRAPH = ann.Graph(shard_rows=300, block_queries=20)


def exact(ids, vectors, every, k):
    out = {}
    for own in np.flatnonzero(ids % every == 0):
        score = np.cumsum(vectors * vectors[own], axis=1)[:, -1]
        order = [int(j) for j in np.lexsort((ids, -score)) if ids[j] != ids[own]][:k]
        out[int(ids[own])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


@pytest.mark.parametrize("kind", ["float", "double"])
def test_recall_and_scores(spark, kind):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(900, 12)) * rng.uniform(0.5, 2, (900, 1))
    vectors[:150] = vectors[0]  # one very common vector
    vectors = vectors.astype("f4" if kind == "float" else "f8")
    ids = rng.permutation(900)
    rows = [(int(i), v.tolist(), 1) for i, v in zip(ids, vectors)]
    table = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, shard int")
    got: dict = {}
    for r in ann.nearest_neighbours(table, every=20, k=20, graph=GRAPH).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = exact(ids, vectors.astype("f8"), 20, 20)
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        assert len({f[1] for f in found}) == 20
        for _, vec, score in found:
            a, b = (vectors[np.flatnonzero(ids == i)[0]].astype("f8") for i in (q, vec))
            assert score == np.cumsum(a * b)[-1]
        hits += len({f[1] for f in found} & {w[0] for w in want[q]})
    assert hits >= 0.95 * 20 * len(want)


def test_unusable_vectors_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]),
        (6, [inf, 1.0]), (20, [0.5, 0.5]), (None, [1.0, 1.0]), (40, []), (60, [1.0, 0.0, 0.0]),
    ]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted(map(tuple, ann.nearest_neighbours(table, graph=GRAPH).collect()))
    assert got == [(0, 1, 1, 0.5), (0, 2, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 1, 0.5)]
    assert ann.nearest_neighbours(table.where("false"), graph=GRAPH).count() == 0


def bags(text):
    words = ["", *text.split(), ""]
    out: dict = {}
    for pair in zip(words, words[1:]):
        out[pair] = out.get(pair, 0) + 1
    return out


def test_collision_rate_is_generalised_jaccard():
    rng = np.random.default_rng(6)
    base = [f"w{k}" for k in rng.integers(0, 60, 400)]
    a, b = " ".join(base), " ".join(base[:250] + [f"v{k}" for k in rng.integers(0, 60, 120)])
    x, y = bags(a), bags(b)
    want = sum(min(x.get(k, 0), y.get(k, 0)) for k in x | y) / sum(max(x.get(k, 0), y.get(k, 0)) for k in x | y)
    found = signatures([a, b], Sampling(samples=1024, bits=15))
    assert abs(likeness(found[:1], found[1:])[0] - want) < 0.05


def test_edits_of_edge_rows(edge, empty):
    import hashlib

    rows = [(r.doc_id, r.text or "") for r in edge.collect()]
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -1), r[1]))
    want = []
    for k, (doc, text) in enumerate(order):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + order[(k + 1) % len(order)][1][:cut]
        want.append((doc or -1, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    got = edited_fingerprints(edge).collect()
    assert sorted((r.doc_id or -1, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.doc_id in (1, 6)}) == 1
    assert edited_fingerprints(empty).count() == fingerprints(empty).count() == 0
    single = edge.where("doc_id = 1")
    assert edited_fingerprints(single).count() == fingerprints(single).count() == 1


def test_long_unrelated_texts_are_unlike():
    a, b = (" ".join(f"{side}{k}" for k in range(100_000)) for side in "ab")
    found = signatures([a, b])
    assert likeness(found[:1], found[1:])[0] <= 0.02


def test_collision_rate_of_long_weighted_texts():
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in rng.zipf(1.3, 30_000) % 5000]
    a, b = " ".join(base), " ".join(base[:20_000] + [f"v{k}" for k in range(15_000)])
    x, y = bags(a), bags(b)
    want = sum(min(x.get(k, 0), y.get(k, 0)) for k in x | y) / sum(max(x.get(k, 0), y.get(k, 0)) for k in x | y)
    found = signatures([a, b], Sampling(samples=2048))
    assert abs(likeness(found[:1], found[1:])[0] - want) < 0.04
