"""Document fingerprints by consistent weighted sampling.

A text is a bag of weighted terms: its pairs of neighbouring words, its first and last
word with the text's border, each with its count. For every sample and term there are
fixed r, c ~ Gamma(2, 1) and b ~ U(0, 1); a term of weight S takes part with
t = floor(ln S / r + b) and ln a = ln c - r (t - b) - r, and the term of least a is the
sample. Two texts share a sample with a probability of their generalised Jaccard
similarity.

The draws are functions of the term's 64-bit hash and the sample's number, so no two terms
share any. They come from three independent exponential draws x, y, z as c = x + y,
r (1 - b) = ln(c / x) and r b = z, which are distributed as above; then a = x exp(-r t).
A term of weight 1 has t = 0 and needs x alone, which grows with its hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayglass.llm.common import shuffle_tasks, slices, texts
from dayglass.llm.words import mix, run_hashes, word_hashes

#: Texts that are turned into samples at a time, and draws (terms x samples) that are held at a time.
TEXTS, DRAWS = 128, 1 << 17


@dataclass(frozen=True)
class Sampling:
    samples: int = 64
    bits: int = 17  # without effect: terms are not folded
    seed: int = 20240229


_BORDER = np.array([0x5851F42D4C957F2D], "u8")


def _keys(s: Sampling) -> np.ndarray:
    """A key for each of the draws x, y and z of each sample."""
    return mix(mix(np.arange(1, 3 * s.samples + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(s.seed)).reshape(3, -1)


def _hashes(term: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Hash of each key (row) and term (column)."""
    out = key[:, None] ^ term[None, :]
    out *= np.uint64(0x9FB21C651E98DF25)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out


def _exponential(hashes: np.ndarray) -> np.ndarray:
    return -np.log1p(-((hashes >> np.uint64(11)).astype("f8") + 0.5) * 2.0**-53)


def _terms(batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, hash and weight of each of its distinct terms."""
    own, term, weight = [np.zeros(0, "i8")], [np.zeros(0, "u8")], [np.zeros(0, "i8")]
    for i, text in enumerate(batch):
        words = text.split()
        if words:
            found, n = np.unique(run_hashes(np.concatenate([_BORDER, word_hashes(words), _BORDER]), 2), return_counts=True)
            own.append(np.full(len(found), i))
            term.append(found)
            weight.append(n)
    return np.concatenate(own), np.concatenate(term), np.concatenate(weight)


def _lower(least: np.ndarray, own: np.ndarray, values: np.ndarray) -> None:
    """Bring `least` (sample, text) down to the values (sample, term) of each text's terms."""
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    least[:, own[first]] = np.minimum(least[:, own[first]], np.minimum.reduceat(values, first, axis=1))


def signatures(batch: list[str], s: Sampling = Sampling()) -> np.ndarray:
    """16 bits of each sample of each text; a text without words has zeros."""
    keys, block = _keys(s), max(1, DRAWS // s.samples)
    out = np.zeros((len(batch), s.samples), "u2")
    for start in range(0, len(batch), TEXTS):
        own, term, weight = _terms(batch[start : start + TEXTS])
        number = min(TEXTS, len(batch) - start)
        least = np.full((s.samples, number), np.inf)
        lowest = np.full((s.samples, number), np.iinfo("u8").max, "u8")
        once = weight == 1
        for at in range(0, int(once.sum()), block):
            if at == 0:
                own1, term1 = own[once], term[once]
            _lower(lowest, own1[at : at + block], _hashes(term1[at : at + block], keys[0]))
        with_one = np.isin(np.arange(number), own[once])
        least[:, with_one] = _exponential(lowest[:, with_one])
        own, term, weight = own[~once], term[~once], np.log(weight[~once])
        for at in range(0, len(term), block):
            x, y, z = (_exponential(_hashes(term[at : at + block], k)) for k in keys)
            r = np.log1p(y / x) + z
            t = np.floor((weight[at : at + block] + z) / r)
            _lower(least, own[at : at + block], x * np.exp(-r * t))
        hashed = mix(least.T.copy().view("u8")) >> np.uint64(48)
        out[start : start + TEXTS] = np.where(np.isinf(least.T), 0, hashed | np.uint64(1))
    return out


def _hex(signature: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in signature]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples: estimates the generalised Jaccard similarity, 0 to 1."""
    return (a == b).mean(axis=1)


def fingerprints(docs: DataFrame, sampling: Sampling = Sampling()) -> DataFrame:
    """doc_id, n_chars, fingerprint (hex) of every whole text; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = texts(part.column(1))
            columns = [pa.array(list(map(len, found)), pa.int64()), pa.array(_hex(signatures(found, sampling)), pa.string())]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n_chars bigint, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """Documents in descending doc_id, each range of ids in one partition in order, with
    its successor's row at its end (`extra`): range_, extra, doc_id, text.

    After the smallest id comes the largest; a null id counts as smaller than any, equal
    ids are ordered by text. Ranges come from quantiles of the ids, the rows at their ends
    (one a range) from one narrow aggregate.
    """
    spark = docs.sparkSession
    least = -(2.0**63)
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("doc_id").cast("double"), F.lit(least)).alias("_at"),
    )
    ranges = 3 * shuffle_tasks(spark)
    cuts = rows.approxQuantile("_at", [k / ranges for k in range(1, ranges)], 0.2 / ranges)
    splits = [-np.inf, *sorted({c for c in cuts if c > least}), np.inf]
    if len(splits) > 2:
        rows = Bucketizer(splits=splits, inputCol="_at", outputCol="range_").transform(rows)
    else:
        rows = rows.withColumn("range_", F.lit(0.0))
    heads = sorted(
        (r["range_"], r["id"])
        for r in rows.groupBy("range_").agg(F.max(F.coalesce("doc_id", F.lit(-(2**63)))).alias("id")).collect()
    )
    # the first row of a range also follows the last of the range above; the very first follows the very last
    following = [(head, heads[(k + 1) % len(heads)][0]) for k, (_, head) in enumerate(heads)]
    ends = F.broadcast(spark.createDataFrame(following, "head bigint, above double"))  # one row a range
    joined = rows.join(ends, F.coalesce("doc_id", F.lit(-(2**63))) == F.col("head"), "left")
    own = F.struct(F.col("range_"), F.lit(False).alias("extra"))
    extra = F.struct(F.col("above").alias("range_"), F.lit(True).alias("extra"))
    return (
        joined.select("doc_id", "text", F.explode(F.when(F.col("above").isNull(), F.array(own)).otherwise(F.array(own, extra))).alias("_to"))
        .select("_to.range_", "_to.extra", "doc_id", "text")
        .repartition(ranges, "range_")
        .sortWithinPartitions("range_", "extra", F.desc_nulls_last("doc_id"), "text")
    )


def edited_fingerprints(docs: DataFrame, sampling: Sampling = Sampling()) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    Edited: the last floor(n_chars / 3) characters give way to the first as many (or all)
    of the next document in descending doc_id. One row a document: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, kept_signature = None, None  # the last row seen: it waits for its successor
        for part in slices(batches):
            rows = list(zip(*(part.column(c).to_pylist() for c in range(4))))
            found = signatures([r[3] for r in rows], sampling)
            if kept is not None:
                rows, found = [kept, *rows], np.vstack([kept_signature, found])
            use = [k for k in range(len(rows) - 1) if not rows[k][1] and rows[k][0] == rows[k + 1][0]]
            edited = []
            for k in use:
                text = rows[k][3]
                cut = len(text) // 3
                edited.append(text[: len(text) - cut] + rows[k + 1][3][:cut])
            changed = signatures(edited, sampling)
            own, after = found[use], found[[k + 1 for k in use]]
            columns = [
                [rows[k][2] for k in use],
                [len(rows[k][3]) for k in use],
                [hashlib.sha256(e.encode("utf-8")).hexdigest() for e in edited],
                _hex(own),
                _hex(changed),
                likeness(own, changed) if use else [],
                likeness(own, after) if use else [],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
            kept, kept_signature = rows[-1], found[-1:]

    schema = (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double"
    )
    return with_next(docs).mapInArrow(run, schema)
