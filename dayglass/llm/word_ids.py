"""Token ids of whole texts under a lower-casing BPE with word ends, by memoised words.

In such a vocabulary no token and no normalisation rule crosses an ASCII space, so a
text's ids are the ids of its space-separated chunks, one after another; nor does one
cross the end of a run of letters. Texts are divided in bulk, and each Python worker keeps
the ids of the segments that it has met (a bounded number); the rest goes to the tokenizer.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from dayglass.llm.common import MEMOS, use_memo
from dayglass.llm.segments import Remembered

#: Fixed value: how such a tokenizer file splits text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What ends the last token of a word, and what every special string holds.
WORD_END, SPECIAL = "</w>", "<|"

_SPLIT = regex.compile(PATTERN).findall
_PLAIN = regex.compile(r"[\x00-ɏ]*").fullmatch
_encoders: dict[str, "WordEncoder"] = {}


def _forget() -> None:
    for known in _encoders.values():
        known.segments.forget()


MEMOS["chunks"] = _forget


def encoder(path: str) -> "WordEncoder":
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class WordEncoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        splits = [p.get("pattern", {}).get("Regex") for p in (rules["pre_tokenizer"] or {}).get("pretokenizers", [])]
        odd = [t["content"] for t in rules["added_tokens"] if SPECIAL not in t["content"]]
        if rules["model"].get("end_of_word_suffix") != WORD_END or splits[:1] != [PATTERN] or odd:
            raise ValueError(f"{path} does not split text into words as this encoder does")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.segments = Remembered(self._encode)

    def ids(self, batch: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each text, without added tokens."""
        return self.column_ids(pa.array(batch, pa.string()))

    def column_ids(self, column: pa.Array) -> list[bytes]:
        """`ids` of a column of texts; null is empty."""
        use_memo("chunks")
        ids, ends = self.segments.ids(column)
        raw = memoryview(ids).cast("B")
        return [bytes(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def _encode(self, segments: list[str]) -> list[bytes]:
        # Up to U+024F every text is in composed form and lower-casing has no context;
        # other segments, and those that may hold a special string, are encoded as they are.
        parts = [_parts(s.strip(" ")) for s in segments]
        words = set(chain.from_iterable(p for p in parts if p is not None))
        known = self._words(list(words)).__getitem__
        whole = [s for s, p in zip(segments, parts) if p is None]
        found = iter(self.tokenizer.encode_batch_fast(whole, add_special_tokens=False) if whole else [])
        return [np.array(next(found).ids, "<u4").tobytes() if p is None else b"".join(map(known, p)) for p in parts]

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of split words: many are encoded as one text, which is cut behind the tokens that end a word."""
        out: dict[str, bytes] = {}
        for start in range(0, len(words), 2000):
            some = words[start : start + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            if len(cuts) != len(some) + 1 or cuts[-1] != 4 * len(ids):
                found = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
                out.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(some, found))
                continue
            raw = ids.tobytes()
            out.update((w, raw[a:b]) for w, a, b in zip(some, cuts, cuts[1:]))
        return out


def _parts(chunk: str) -> list[str] | None:
    """The words of a chunk; None for one that is encoded as it is."""
    if not chunk:
        return []
    if not _PLAIN(chunk) or SPECIAL in chunk:
        return None
    low = chunk.lower()
    if low.isalpha():
        return [low]
    if low[-1] in ".,;:!?" and low[:-1].isalpha():
        return [low[:-1], low[-1]]
    return _SPLIT(low)
