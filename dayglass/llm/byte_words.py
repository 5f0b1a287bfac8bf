"""Words of many texts at once: places and 64-bit hashes from the bytes of an Arrow column.

No text becomes a Python object: a table of byte classes finds where words start and end,
and a polynomial over the bytes, taken from prefix sums, hashes each word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from dayglass.llm.words import mix

#: Bytes of text that are worked on at a time; one longer text is worked on alone.
SLICE_BYTES = 1 << 19

WORD, SPACE, BREAK = 0, 1, 2
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)
_LOWER = np.arange(256, dtype="u1")
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


@dataclass(frozen=True)
class Words:
    """Hash, row, piece and place of each word, in the order of the texts; `raw` is their bytes in lower case."""

    hashes: np.ndarray
    rows: np.ndarray
    pieces: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    raw: np.ndarray


def byte_classes(spaces: bytes, breaks: bytes = b"") -> np.ndarray:
    table = np.zeros(256, "u1")
    table[list(spaces)] = SPACE
    table[list(breaks)] = BREAK
    return table


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows of about `size` bytes of text."""
    for batch in batches:
        ends = np.cumsum(sizes(batch.column(column)))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each text; null is empty."""
    _, ends = text_bytes(column)
    return np.diff(ends)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins and ends; null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, "i8")[column.offset : column.offset + len(column) + 1]
    # an empty column may have no buffer at all
    raw = np.frombuffer(data, "u1")[ends[0] : ends[-1]] if data is not None and len(ends) else np.zeros(0, "u1")
    ends = ends - ends[0] if len(ends) else np.zeros(1, "i8")
    return raw, ends


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64, at least n of them."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, 2 * SLICE_BYTES), base, "u8")
        steps[0] = 1
        known = np.cumprod(steps)
        if len(known) <= 2 * SLICE_BYTES:
            _powers[base] = known
    return known


def words(column: pa.Array, classes: np.ndarray) -> Words:
    """The words of a column of texts, A-Z in lower case."""
    raw, offsets = text_bytes(column)
    if not len(raw):
        none = np.zeros(0, "i8")
        return Words(np.zeros(0, "u8"), none, none, none, none, raw)
    low = _LOWER[raw]
    kind = classes[low]
    inside = kind == WORD
    first = np.zeros(len(low) + 1, bool)  # a text starts here
    first[offsets] = True
    after = np.r_[False, inside[:-1]] & ~first[:-1]
    starts = np.flatnonzero(inside & ~after)
    before = np.r_[inside[1:], False] & ~first[1:]
    ends = np.flatnonzero(inside & ~before) + 1
    sums = np.zeros(len(low) + 1, "u8")
    np.cumsum((low.astype("u8") + np.uint64(1)) * _power(_BASE, len(low))[: len(low)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _power(_BACK, len(low))[starts])
    rows = np.searchsorted(offsets, starts, side="right") - 1
    # equal row and piece: no break lies between two words
    pieces = np.cumsum(kind == BREAK)[starts]
    return Words(hashes, rows, pieces, starts, ends, low)
