"""Best-fit packing of token sequences under several capacities at once.

A piece of n tokens asks for the vector (n tokens, 1 document, n*n attention cost), so
pieces of one length are alike and the plan needs only their number by length: at most
`tokens` rows, whatever the corpus. The plan is vector best-fit, longest first: of the
open bins that can take a piece under every capacity, the one with the least weighted
residual norm after it (or the greatest weighted dot product of demand and residual)
takes it; bins in the same state are handled as one class. Pieces then find their place
by their rank among the pieces of their length.

Plan: tokenise (no shuffle, ids stay in the task), narrow piece table to the shared
folder, counts by length to the driver, ranks by a window over (length, bucket) whose
groups are bounded by splitting each length into buckets.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayglass.llm.byte_words import by_bytes
from dayglass.llm.common import shuffle_tasks, stored
from dayglass.llm.segments import BATCH_BYTES
from dayglass.llm.word_ids import encoder

#: Pieces that one (length, bucket) group holds on average at most.
GROUP_ROWS = 20_000


@dataclass(frozen=True)
class Capacity:
    """Capacities of a bin and the weight of each residual, as shares of the capacity.

    With `documents=None` and `attention=None` only tokens bind.
    """

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001)
    rule: str = "norm"  # or "dot"

    def limits(self) -> np.ndarray:
        documents = self.tokens if self.documents is None else self.documents
        attention = self.tokens**2 if self.attention is None else self.attention
        return np.array([self.tokens, documents, attention], "i8")


@dataclass
class Runs:
    """Rows of the plan for one length, by first rank."""

    first: np.ndarray
    bin: np.ndarray
    each: np.ndarray
    offset: np.ndarray


def plan(counts: dict[int, int], capacity: Capacity) -> dict[int, Runs]:
    """Runs by length: ranks from `first` on go `each` to a bin, from `bin` and `offset` on."""
    if capacity.rule not in ("norm", "dot"):
        raise ValueError(f"rule {capacity.rule!r}")
    limits, weights = capacity.limits(), np.array(capacity.weights)
    size = 1024
    left = np.zeros((size, 3), "i8")  # residuals of each class of bins
    number = np.zeros(size, "i8")  # bins in it
    first_bin = np.zeros(size, "i8")
    used, bins = 0, 0
    runs: dict[int, list[tuple[int, int, int, int]]] = {}

    def add(bin_: int, count: int, residual: np.ndarray) -> None:
        nonlocal left, number, first_bin, used, size
        if count <= 0 or residual.min() <= 0:
            return
        if used == size:
            keep = np.flatnonzero(number[:used])
            used = len(keep)
            left[:used], number[:used], first_bin[:used] = left[keep], number[keep], first_bin[keep]
            number[used:] = 0
            if used > size // 2:
                size *= 2
                left = np.vstack([left, np.zeros_like(left)])
                number = np.concatenate([number, np.zeros_like(number)])
                first_bin = np.concatenate([first_bin, np.zeros_like(first_bin)])
        left[used], number[used], first_bin[used] = residual, count, bin_
        used += 1

    for length in sorted(counts, reverse=True):
        demand = np.array([length, 1, length * length], "i8")
        if (demand > limits).any():
            raise ValueError(f"a piece of {length} tokens fits in no bin")
        remaining, rank = counts[length], 0
        mine = runs.setdefault(length, [])
        while remaining:
            fits = np.flatnonzero((number[:used] > 0) & (left[:used] >= demand).all(axis=1))
            if len(fits):
                after = (left[fits] - demand) / limits
                if capacity.rule == "norm":
                    k = fits[np.argmin((weights * after * after).sum(axis=1))]
                else:
                    k = fits[np.argmax((weights * (demand / limits) * (left[fits] / limits)).sum(axis=1))]
                residual, start, there = left[k].copy(), int(first_bin[k]), int(number[k])
                number[k] = 0
            else:
                residual, start, there = limits, bins, None
            # by the norm a bin that took one piece is the best for the next alike
            each = int((residual // demand).min()) if capacity.rule == "norm" else 1
            if there is None:
                there = -(-remaining // each)
                bins += there
            placed = min(remaining, there * each)
            full, rest = divmod(placed, each)
            mine.append((rank, start, each, int(limits[0] - residual[0])))
            add(start, full, residual - each * demand)
            if rest:
                add(start + full, 1, residual - rest * demand)
            add(start + full + bool(rest), there - full - bool(rest), residual)
            rank += placed
            remaining -= placed
    return {n: Runs(*(np.array(c, "i8") for c in zip(*r))) for n, r in runs.items() if r}


def assign(pieces: DataFrame, capacity: Capacity, order: list[str], name: str = "pieces") -> DataFrame:
    """Give each row with a `length` of 1 to `tokens` a sequence_id and an offset.

    `order` names columns that tell the rows of one length apart; rows equal in all of
    them are interchangeable. An empty table stays empty.
    """
    spark = pieces.sparkSession
    pieces = stored(pieces, name)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    shared = spark.sparkContext.broadcast(plan(counts, capacity))
    buckets = max(4 * shuffle_tasks(spark), math.ceil(total / GROUP_ROWS))
    split = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    starts = (
        split.groupBy("length", "_bucket")
        .agg(F.count("*").alias("_n"))
        .withColumn(
            "_before",
            F.sum("_n").over(
                Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .select("length", "_bucket", F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    ranked = (
        split.withColumn("_nth", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*order)))
        .join(starts, ["length", "_bucket"])
        .withColumn("_rank", F.col("_before") + F.col("_nth") - 1)
        .select(*pieces.columns, "_rank")
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            bin_, offset = np.zeros(len(rank), "i8"), np.zeros(len(rank), "i8")
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                r = runs[int(n)]
                k = np.searchsorted(r.first, rank[at], side="right") - 1
                over = rank[at] - r.first[k]
                bin_[at] = r.bin[k] + over // r.each[k]
                offset[at] = r.offset[k] + over % r.each[k] * n
            columns = [batch.column(c) for c in batch.schema.names if c != "_rank"]
            names = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(bin_), pa.array(offset)], [*names, "sequence_id", "offset"]
            )

    return ranked.mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")


def token_pieces(
    docs: DataFrame, tokenizer: str, tokens: int = 2048, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): a document's ids and `end_id`,
    cut every `tokens` ids.

    A null text is empty and gives the single id `end_id`; a null doc_id is kept.
    """
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).column_ids
        end = np.array([end_id], "<u4").tobytes()
        for part in by_bytes(batches, "text", BATCH_BYTES):
            out: list[tuple] = []
            for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1))):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * tokens)):
                    chunk = ids[at : at + 4 * tokens]
                    row = (doc, piece, at // 4, len(chunk) // 4, zlib.crc32(chunk))
                    out.append(row + (np.frombuffer(chunk, "<u4").astype("i4"),) if with_ids else row)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                types, names = [*types, pa.list_(pa.int32())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), types)], names
            )
        pa.default_memory_pool().release_unused()  # workers are used again

    if with_ids:
        schema += ", ids array<int>"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: Capacity = Capacity(), end_id: int = 0) -> DataFrame:
    """Pack all documents (doc_id, text; further columns are not read) into sequences.

    One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Repeated rows are packed as often as they occur. Documents are cut at the smaller of
    the token capacity and the square root of the attention capacity.
    """
    limits = capacity.limits()
    longest = min(int(limits[0]), math.isqrt(int(limits[2])))
    pieces = token_pieces(docs, tokenizer, longest, end_id)
    return assign(pieces, capacity, ["doc_id", "piece", "ids_crc32"])
