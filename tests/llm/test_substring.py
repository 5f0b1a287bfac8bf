import hashlib
import random

import numpy as np
import pytest

from dayglass.llm import substring
from dayglass.llm.fm_index import Bits, FMIndex, WaveletMatrix, suffix_order
from dayglass.llm.substring import Passages, removal_digest, split_words, without_repeats


def test_rank_and_suffix_order():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, 1000).astype("u1")
    at = rng.integers(0, 1001, 300)
    assert (Bits(bits).rank(at) == [bits[:k].sum() for k in at]).all()
    symbols = rng.integers(0, 21, 500)
    matrix = WaveletMatrix(symbols, 21)
    asked, at = rng.integers(0, 21, 300), rng.integers(0, 501, 300)
    assert (matrix.rank(asked, at) == [(symbols[:k] == c).sum() for c, k in zip(asked, at)]).all()
    order = suffix_order(symbols % 3, 20)
    heads = [tuple((symbols % 3)[k : k + 20]) for k in order]
    assert heads == sorted(heads)


def test_matching_statistics():
    rng = np.random.default_rng(2)
    text = np.r_[rng.integers(1, 4, 300), 0]
    index = FMIndex(text, 4, 8)
    ends = np.arange(1, 300)
    length, low, high = index.matching(text, ends, 8)

    def places(pattern):
        return [k for k in range(300 - len(pattern) + 1) if (text[k : k + len(pattern)] == pattern).all()]

    for end, n, lo, hi in zip(ends, length, low, high):
        want = max(k for k in range(0, min(8, end) + 1) if k == 0 or len(places(text[end - k : end])) > 1)
        assert n == want
        if n:
            assert sorted(index.suffixes[lo:hi]) == places(text[end - n : end])
    full = length == 8
    assert (index.earliest(low[full], high[full]) == [min(places(text[e - 8 : e])) for e in ends[full]]).all()


def brute_force(rows, window):
    """(doc_id, n_words, kept words) of each row, windows judged in order of doc_id."""
    split = [(d, split_words(t or "")) for d, t in rows]
    first: dict = {}
    for d, words in sorted(split, key=lambda r: r[0]):
        for k in range(len(words) - window + 1):
            first.setdefault(tuple(words[k : k + window]), (d, k))
    out = []
    for d, words in split:
        gone = set()
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < (d, k):
                gone.update(range(k, k + window))
        out.append((d, len(words), [w for k, w in enumerate(words) if k not in gone]))
    return out


def digests(found):
    return sorted((d, n, n - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()) for d, n, kept in found)


@pytest.mark.parametrize("shard_anchors", [20_000, 6, 1])
def test_removal_by_brute_force(spark, shard_anchors):
    """Also where routes part by anchor and by window, as they do for very frequent passages."""
    rng = random.Random(7)
    passages = [[f"p{k}w{rng.randrange(9)}" for _ in range(rng.randint(15, 60))] for k in range(5)]
    rows = []
    for d in range(60):
        words: list[str] = []
        for _ in range(rng.randint(0, 5)):
            words += [f"own{rng.randrange(10**6)}" for _ in range(rng.randint(0, 15))]
            words += rng.choice(passages)[rng.randrange(8) :]
        rows.append((d, " \n".join(words)))
    rows += [(100, "be " * 70), (101, "to be or " * 30), (102, rows[3][1]), (103, rows[3][1] + " more"), (104, ""), (105, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = removal_digest(docs, Passages(shard_anchors=shard_anchors))
    want = brute_force(rows, 20)
    assert sorted(map(tuple, got.collect())) == digests(want)
    cut = {r.doc_id: r.text for r in without_repeats(docs, Passages(shard_anchors=shard_anchors)).collect()}
    for d, n, kept in want:
        assert split_words(cut[d] or "") == kept
        if n == len(kept):
            assert cut[d] == dict(rows)[d]


def test_edge_rows(edge, empty):
    rows = removal_digest(edge).collect()
    assert len(rows) == edge.count()
    assert {r.n_removed for r in rows if r.doc_id != 5} == {0}
    kept = without_repeats(edge)
    assert kept.columns == edge.columns and kept.count() == edge.count()
    assert removal_digest(empty).count() == without_repeats(empty).count() == 0


def test_equal_texts_and_missing_ids(spark):
    text = " ".join(f"w{k}" for k in range(25))
    docs = spark.createDataFrame([(5, text), (None, text), (2, text), (2, text)], "doc_id bigint, text string")
    got = sorted((r.doc_id or 99, r.n_removed) for r in removal_digest(docs).collect())
    assert got == [(2, 0), (2, 0), (5, 25), (99, 25)]


def test_sliding_values():
    x = np.random.default_rng(3).integers(0, 50, 200)
    for width in (1, 2, 5, 8, 13):
        assert (substring._sliding(x, width, np.minimum) == [x[k : k + width].min() for k in range(200 - width + 1)]).all()
