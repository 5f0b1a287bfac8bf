"""64-bit hashes of words and of runs of words, the same on every machine."""

from __future__ import annotations

import numpy as np
import xxhash

from dayglass.llm.common import MEMOS, use_memo

#: Words whose hash a worker remembers.
WORDS = 500_000

_known: dict[str, int] = {}
MEMOS["words"] = _known.clear


def word_hashes(words: list[str]) -> np.ndarray:
    use_memo("words")
    try:
        return np.fromiter(map(_known.__getitem__, words), "u8", len(words))
    except KeyError:
        digest = xxhash.xxh3_64_intdigest
        for w in set(words).difference(_known):
            if len(_known) >= WORDS:
                return np.fromiter((_known.get(w) or digest(w.encode("utf-8", "surrogatepass")) for w in words), "u8", len(words))
            _known[w] = digest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(_known.__getitem__, words), "u8", len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of `length` consecutive words; none if there are fewer."""
    n = len(hashes) - length + 1
    if n <= 0:
        return hashes[:0]
    out = np.zeros(n, "u8")
    for k in range(length):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    return mix(out)
