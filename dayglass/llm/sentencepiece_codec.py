"""SentencePiece BPE encoding and decoding as a streaming Viterbi search.

The lattice has a node at every character boundary and an arc for every piece; an arc
survives if its piece is stable after the piece that reaches its start (prefix_bpe), so
each node has one backpointer. Only nodes that a longer piece can still leave from are
live: a window of `longest` pieces. Ids are committed as soon as the backpointer paths
of all live nodes meet in one boundary. A model whose pieces hold the space mark only at
their start has such a boundary before every word, and where none of its pieces goes on from
letters to other characters or back, also there: texts are divided in bulk, and segments are
searched once and remembered.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayglass.llm.byte_words import by_bytes
from dayglass.llm.common import slices, texts
from dayglass.llm.prefix_bpe import PrefixBPE
from dayglass.llm.segments import BATCH_BYTES, Remembered, segments

#: Fixed value: the letter that stands for a space in pieces.
SPACE = "▁"

_codecs: dict[str, "Codec"] = {}


def codec(path: str) -> "Codec":
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


class Codec:
    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        score = {self.pieces[i]: model.get_score(i) for i in plain}
        self.bytes = {i: int(self.pieces[i][3:-1], 16) for i in range(size) if model.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        self.unknown = model.unk_id()
        self.shown = ["" if model.is_control(i) else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)]

        def priority(a: str, b: str) -> float | None:
            found = score.get(a + b)
            return None if found is None else -found

        self.bpe = PrefixBPE(set(self.ids), priority)
        self.by_words = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        spaced = pa.array([p.replace(SPACE, " ") for p in self.ids], pa.string())
        self.segments = Remembered(self._segments, divide=len(segments(spaced).places) == len(spaced))

    def _ids(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        if found is not None:
            return [found]
        return [self.byte_ids.get(b, self.unknown) for b in piece.encode("utf-8")] if self.byte_ids else [self.unknown]

    def stream(self, text: Iterator[str]) -> Iterator[int]:
        """Ids of a stream of characters (spaces already marked), committed as paths meet."""
        bpe, longest = self.bpe, self.bpe.longest
        window, base = "", 0  # characters after the last committed boundary
        back, last = [0], [""]  # of each boundary in the window
        before = ""  # the piece that ends at the boundary the window starts from
        for character in text:
            window += character
            end = len(window)
            for start in range(max(0, end - longest), end):
                piece = window[start:end]
                if piece not in bpe.tokens and end - start > 1:
                    continue
                left = last[start] if start else before
                if left:
                    good = bpe.stable.get((left, piece))
                    good = bpe._learn((left, piece)) if good is None else good
                else:
                    good = bpe.merged(piece) == [piece]
                if good:
                    back.append(start)
                    last.append(piece)
                    break
            if end % longest == 0:
                live = set(range(max(0, end - longest + 1), end + 1))
                while len(live) > 1:  # move the farthest path back until one boundary is left
                    live.add(back[far := max(live)])
                    live.discard(far)
                meet = live.pop()
                if meet:
                    for piece in self._path(window, back, meet):
                        yield from self._ids(piece)
                    before = last[meet]
                    window, base = window[meet:], base + meet
                    back = [0, *(max(0, b - meet) for b in back[meet + 1 :])]
                    last = ["", *last[meet + 1 :]]
        for piece in self._path(window, back, len(window)):
            yield from self._ids(piece)

    @staticmethod
    def _path(window: str, back: list[int], end: int) -> list[str]:
        out = []
        while end:
            out.append(window[back[end] : end])
            end = back[end]
        return out[::-1]

    def _segments(self, some: list[str]) -> list[bytes]:
        out = []
        for word in some:
            word = word.replace(" ", SPACE)
            # a short word ends before paths can be committed: take the search of its whole window
            path = self.bpe.encode(word) if len(word) <= 4 * self.bpe.longest else None
            ids = [i for p in path for i in self._ids(p)] if path is not None else list(self.stream(iter(word)))
            out.append(np.array(ids, "<u4").tobytes())
        return out

    def encode(self, text: str) -> bytes:
        """Little-endian uint32 ids; the empty text has none."""
        return self.encode_column(pa.array([text], pa.string()))[0]

    def encode_column(self, column: pa.Array) -> list[bytes]:
        """`encode` of a column of texts; null is empty."""
        if not self.by_words:
            marked = (SPACE + t.replace(" ", SPACE) if t else "" for t in texts(column))
            return [np.array(list(self.stream(iter(m))), "<u4").tobytes() for m in marked]
        spaced = pc.replace_substring(column.cast(pa.large_string()).fill_null(""), SPACE, " ")
        first = pc.if_else(pc.equal(pc.binary_length(spaced), 0), "", " ").cast(pa.large_string())
        ids, ends = self.segments.ids(pc.binary_join_element_wise(first, spaced, pa.scalar("", pa.large_string())))
        raw = memoryview(ids).cast("B")
        return [bytes(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def decode(self, ids: bytes) -> str:
        """The text of ids; runs of byte pieces are UTF-8, malformed bytes become U+FFFD."""
        values = np.frombuffer(ids, "<u4").tolist()
        if not values:
            return ""
        if self.bytes.keys().isdisjoint(values):
            text = "".join(map(self.shown.__getitem__, values))
        else:
            out: list[str] = []
            raw = bytearray()
            for i in values:
                if i in self.bytes:
                    raw.append(self.bytes[i])
                    continue
                if raw:
                    out.append(raw.decode("utf-8", "replace"))
                    raw.clear()
                out.append(self.shown[i])
            text = "".join(out) + raw.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids array<int> of every whole text; a null text has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for part in by_bytes(batches, "text", BATCH_BYTES):
            ids = [np.frombuffer(i, "<u4").astype("i4") for i in own.encode_column(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text of (doc_id, ids); null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for part in slices(batches):
            found = [own.decode(np.array(i or [], "<u4").tobytes()) for i in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def encoding_digest(docs: DataFrame, model: str) -> DataFrame:
    """One row a document: doc_id, n_ids, ids_crc32 (of the little-endian unsigned 32-bit
    ids), round_trip (decoding the ids gives the text back).

    Null and empty texts have no ids and round-trip; a text that itself holds the space
    mark does not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for part in by_bytes(batches, "text", BATCH_BYTES):
            rows = []
            for text, ids in zip(texts(part.column(1)), own.encode_column(part.column(1))):
                rows.append((len(ids) // 4, zlib.crc32(ids), own.decode(ids) == text))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *columns], ["doc_id", "n_ids", "ids_crc32", "round_trip"]
            )
        pa.default_memory_pool().release_unused()  # workers are used again

    schema = "doc_id bigint, n_ids bigint, ids_crc32 bigint, round_trip boolean"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)
