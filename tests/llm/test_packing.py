import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from dayglass.llm import packing
from dayglass.llm.word_ids import encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [(64, None, None), (64, 3, None), (64, 5, 1500)])
def test_plan_keeps_every_capacity(rule, limits):
    capacity = packing.Capacity(*limits, rule=rule)
    rng = np.random.default_rng(3)
    longest = int(min(limits[0], (limits[2] or limits[0] ** 2) ** 0.5))
    counts = {int(n): int(rng.integers(1, 400)) for n in range(1, longest + 1)}
    bins: dict = {}
    for n, runs in packing.plan(counts, capacity).items():
        for rank in range(counts[n]):
            k = np.searchsorted(runs.first, rank, side="right") - 1
            over = rank - runs.first[k]
            bins.setdefault(int(runs.bin[k] + over // runs.each[k]), []).append((int(runs.offset[k] + over % runs.each[k] * n), n))
    most = capacity.limits()
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= most[0] and len(pieces) <= most[1] and sum(n * n for _, n in pieces) <= most[2]
    assert sum(map(len, bins.values())) == sum(counts.values())
    if rule == "norm" and limits[1:] == (None, None):
        # no packing is below this; best-fit decreasing is within 11/9 of the best
        least = max(-(-sum(n * c for n, c in counts.items()) // 64), sum(c for n, c in counts.items() if n > 32))
        assert least <= len(bins) <= 11 / 9 * least + 1


def test_same_as_one_by_one_best_fit():
    """Runs of bins in one state give what placing piece by piece gives."""
    rng = np.random.default_rng(5)
    for _ in range(20):
        counts = {int(n): int(rng.integers(1, 6)) for n in rng.integers(1, 51, 12)}
        left: list[int] = []
        for n in sorted(counts, reverse=True):
            for _ in range(counts[n]):
                fits = [k for k, free in enumerate(left) if free >= n]
                if not fits:
                    left.append(50)
                    fits = [len(left) - 1]
                best = min(fits, key=lambda k: left[k])
                left[best] -= n
        runs = packing.plan(counts, packing.Capacity(50, weights=(1, 0, 0)))
        assert len(left) == 1 + max(int((r.bin + (np.append(r.first[1:], counts[n]) - r.first - 1) // r.each).max()) for n, r in runs.items())


def test_ids_match_the_tokenizer():
    texts = ["", "Hello  WORLD\n\tdon't", "ΑΣ ΣΑΣ", "a<|endoftext|>b <|startoftext|>", "é é  x", "123 a1b2!?", "日本 \U0001f600"]
    tokenizer = Tokenizer.from_file(PATH)
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder(PATH).ids(texts) == want


def test_segments_are_encoded_once(monkeypatch):
    own = encoder(PATH)
    own.segments.forget()
    asked = []
    words = own._words
    monkeypatch.setattr(own, "_words", lambda some: asked.extend(some) or words(some))
    texts = ["Zebrafink zebrafink. (zebrafink)\nzebrafink, ZEBRAFINK'S", "zebrafink;zebrafink İ. İ!, 'İ×÷a²b", "<|zebrafink\u2019s <| |>"]
    tokenizer = Tokenizer.from_file(PATH)
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert own.ids(texts) == want
    assert own.ids(texts) == want
    assert asked.count("zebrafink") == 1 and len(asked) == len(set(asked))


def test_edge_rows(edge, empty):
    rows = packing.pack(edge, PATH, packing.Capacity(512)).collect()
    tokenizer = Tokenizer.from_file(PATH)
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    found = sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = []
    for row in edge.collect():
        ids = [*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 512)):
            cut = np.array(ids[start : start + 512], "<u4")
            want.append((row.doc_id or -1, piece, start, len(cut), zlib.crc32(cut.tobytes())))
    assert found == sorted(want)
    assert packing.pack(empty, PATH).count() == 0
