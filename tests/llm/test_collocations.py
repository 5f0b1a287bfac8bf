import random
import re
from collections import Counter

import numpy as np
import pytest

from dayglass.llm import collocations as K
from dayglass.llm.byte_words import by_bytes, byte_classes, words

SCHEMA = "doc_id bigint, lang string, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, m):
    f, n = Counter(), Counter()
    for _, lang, text in rows:
        lang = lang or "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, m.longest + 1) for i in range(len(w) - k + 1))
    phrases = {p: a for p, a in f.items() if len(p) > 2 and a >= m.least}
    found = {}
    for (lang, *w), a in phrases.items():
        cuts = [(2_000_000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        inside = [b for (other, *x), b in phrases.items() if other == lang and len(x) > len(w) and any(x[i : i + len(w)] == w for i in range(len(x)))]
        if not any(100 * b >= m.contained * a for b in inside):
            found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return {
        (lang, r, p.decode(), -a, x, y, n[lang], -s) for lang, best in found.items() for r, (s, a, p, x, y) in enumerate(sorted(best)[: m.top], 1)
    }


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    vocabulary = ["the", "of", "The", "Élan", "über", "x", "a-b", "naïve", *[f"w{k}" for k in range(25)]]
    out = []
    for k in range(400):
        text = "".join(rng.choices(vocabulary, range(40, 40 - len(vocabulary), -1))[0] + rng.choice((" ", " ", "\t", "  ", ". ", ",", "\n")) for _ in range(60))
        out.append((k, rng.choice(("en", "en", None, "und", "é")), text))
    return out + [(None, "en", "new york city hall " * 40), (7, "en", None), (8, None, ""), (9, "fr", "the the the")] + [out[0]] * 20


@pytest.mark.parametrize("m", [K.Mining(least=6, top=50), K.Mining(least=4, top=2000, ranked=9), K.Mining(least=3, top=30, contained=50, longest=3)])
def test_by_brute_force(spark, rows, m):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS rank", "'x' AS phrase", "2 AS n", "3 AS tile", "4 AS symbol")
    got = {tuple(r) for r in K.collocations(df.repartition(3), m).collect()}
    assert got == expected(rows, m)
    assert len({r[0] for r in got}) > 2


def test_empty(spark):
    assert K.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert K.collocations(spark.createDataFrame([(1, "en", None)], SCHEMA)).count() == 0


def test_tiles_and_back():
    rng = np.random.default_rng(2)
    for ids in (5, 9000, 300_000):
        left, right = rng.integers(0, ids, 5000), rng.integers(0, ids, 5000)
        keys = K.tiled(left, right, ids)
        tile, code = keys >> K.CODE_BITS, keys & ((1 << K.CODE_BITS) - 1)
        for t in np.unique(tile).tolist():
            a, b = K.untiled(t, code[tile == t], ids)
            assert (a == left[tile == t]).all() and (b == right[tile == t]).all()
        counts = Counter(zip(tile.tolist(), code.tolist()))
        assert {(t, c): n for t, cs, ns in K.counted(keys) for c, n in zip(cs.tolist(), ns.tolist())} == counts
    code, count = np.unique(rng.integers(0, 1 << 40, 999), return_counts=True)
    assert all((x == y).all() for x, y in zip(K.unpacked(*K.packed(code, count)), (code, count)))


def test_ranks_with_shared_slots():
    symbols = np.random.default_rng(3).integers(0, 2**64, 5000, "u8")
    table = K.Ranks(symbols[:4000])
    assert (table.of(symbols[:4000]) == np.arange(4000)).all() and (table.of(symbols[4000:]) == -1).all()


def test_words_of_bytes():
    import pyarrow as pa

    texts = ["One  two\tÜ three", None, "", " \n", "x" * 5000 + " y", "two", "a.b, c"]
    column = pa.array(["cut off", *texts]).slice(1)
    for classes, pattern in ((byte_classes(b" \t\n\x0b\x0c\r"), "[^\x20\x09-\x0d]+"), (byte_classes(b" \t", b".,;:!?\n\x0b\x0c\r"), "[^\x20\x09.,;:!?\x0a-\x0d]+")):
        found = words(column, classes)
        want = [(k, w.translate(LOWER).encode()) for k, t in enumerate(texts) for w in re.findall(pattern, t or "")]
        got = [(int(r), found.raw[a:b].tobytes()) for r, a, b in zip(found.rows, found.starts, found.ends)]
        assert got == want
        names = {}
        assert all(names.setdefault(w, h) == h for (_, w), h in zip(want, found.hashes.tolist())) and len(set(names.values())) == len(names)
    batch = pa.RecordBatch.from_arrays([column], ["text"])
    assert [b.num_rows for b in by_bytes([batch], "text", 20)] == [4, 1, 2]
