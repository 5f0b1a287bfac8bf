"""Segments of many texts at once, from the bytes of an Arrow column, and what is remembered of them.

A segment is a run of letters or of other characters, with the spaces before it; a letter
behind an apostrophe does not start one. Words that hold anything but ASCII and the letters
from U+00C0 to U+023F (without U+0130), or the start of a special string, are not divided.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from dayglass.llm.byte_words import text_bytes

#: Bytes of text that are divided at a time; one longer text is divided alone.
BATCH_BYTES = 1 << 22
#: Segments in each of the two generations that a worker remembers.
REMEMBERED = 300_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xC9)]] = True
_ODD = np.zeros(256, bool)
_ODD[[0xC2, *range(0xC9, 256)]] = True
_GLUE = np.zeros(256, bool)
_GLUE[[0x20, 0x27]] = True  # space and apostrophe


@dataclass(frozen=True)
class Segments:
    """Distinct segments, the place of each segment among them, and each text's first segment."""

    distinct: list[str]
    places: np.ndarray
    first: np.ndarray


def segments(column: pa.Array, divide: bool = True) -> Segments:
    """The segments of a column of texts; null is empty. Without `divide`, they end at spaces only."""
    raw, offsets = text_bytes(column)
    n = len(raw)
    if not n:
        return Segments([], np.zeros(0, "i8"), np.zeros(len(offsets), "i8"))
    letter, space = _LETTER[raw], raw == 0x20
    cut = np.zeros(n + 1, bool)
    if divide:
        cut[1:n] = (letter[:-1] > letter[1:]) | ((letter[1:] > letter[:-1]) & ~_GLUE[raw[:-1]])
    chunk = np.zeros(n + 1, bool)  # a space after something else, or a text, starts here
    chunk[1:n] = space[1:] > space[:-1]
    chunk[offsets] = True
    cut |= chunk
    odd = _ODD[raw]
    odd[1:] |= (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))  # the signs × and ÷
    odd[1:] |= (raw[:-1] == 0xC4) & (raw[1:] == 0xB0)  # İ: its lower case ends in a mark
    odd[1:] |= (raw[:-1] == 0x3C) & (raw[1:] == 0x7C)  # <|
    odd_at = np.flatnonzero(odd)
    bounds = np.flatnonzero(cut)
    if len(odd_at):
        chunks = np.flatnonzero(chunk)
        whole = np.zeros(len(chunks), bool)
        whole[np.searchsorted(chunks, odd_at, side="right") - 1] = True
        bounds = bounds[chunk[bounds] | ~whole[np.searchsorted(chunks, bounds, side="right") - 1]]
    # the last bound is the end of the bytes
    cuts = pa.py_buffer(bounds.astype("i4" if n < 2**31 else "i8"))
    kind = pa.string() if n < 2**31 else pa.large_string()
    coded = pa.Array.from_buffers(kind, len(bounds) - 1, [None, cuts, pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
    return Segments(
        coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), np.searchsorted(bounds, offsets)
    )


class Remembered:
    """The ids (little-endian uint32) of segments; those not met for long are forgotten first."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], divide: bool = True):
        self.encode, self.divide = encode, divide
        self.forget()

    def forget(self) -> None:
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def look_up(self, distinct: list[str]) -> list[bytes]:
        found = list(map(self.recent.get, distinct))
        at = [i for i, ids in enumerate(found) if ids is None]
        for i in at:
            found[i] = self.older.get(distinct[i])
        new = [i for i in at if found[i] is None]
        if new:
            for i, ids in zip(new, self.encode([distinct[i] for i in new])):
                found[i] = ids
        self.recent.update((distinct[i], found[i]) for i in at)
        if len(self.recent) >= REMEMBERED:
            self.recent, self.older = {}, self.recent
        return found

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, one after another, and where each text's begin and end."""
        cut = segments(column, self.divide)
        found = self.look_up(cut.distinct)
        flat = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), "i8", len(found)) // 4
        start = np.cumsum(size) - size
        sizes = size[cut.places]
        ends = np.zeros(len(sizes) + 1, "i8")
        np.cumsum(sizes, out=ends[1:])
        out = flat[np.repeat(start[cut.places] - ends[:-1], sizes) + np.arange(ends[-1])]
        return out, ends[cut.first]
