"""Removal of repeated passages: every window of words that starts earlier elsewhere.

Every window has an anchor, the least hash of its word runs, that depends on its content
only, so equal windows share an anchor. Texts are read once for their anchors; anchors
that occur once end there. The rest get a route: windows of anchors first seen in one
document travel together; where those are too many, anchors part, and where one anchor
alone is too frequent, its windows part by their own hash. Equal windows always have the
same route. Each text cuts the runs of windows of one route into segments. An FM-index (fm_index) of
segments, through which they are streamed again, gives their matching statistics by
backward search: a window with a match of full length goes unless it is the first of its
matches. The task that cuts the segments judges them so among themselves first and sends
only what stays, equal segments are reduced to their first one, and the task of a shard
judges what all tasks have sent for its routes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayglass.llm.common import slices, stored, texts
from dayglass.llm.fm_index import FMIndex
from dayglass.llm.words import mix, run_hashes, word_hashes

#: Fixed value: what a word is.
split_words = regex.compile(r"[^\x20\x09-\x0D]+").findall

_LAST = 2**63 - 1


@dataclass(frozen=True)
class Passages:
    """`window` words make a passage; anchors are runs of `run` words; a shard gets the
    segments of about `shard_anchors` anchors, a cutting task judges about `batch_words`
    words at a time."""

    window: int = 20
    run: int = 8
    shard_anchors: int = 20_000
    batch_words: int = 200_000


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """Least or greatest value of every `width` neighbours."""
    span, out = 1, x
    while span * 2 <= width:
        out = best(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return best(out[: len(out) - rest], out[rest:]) if rest else out


def window_anchors(hashes: np.ndarray, p: Passages) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window, and the anchors as often as they occur."""
    runs = run_hashes(hashes, p.run)
    width = p.window - p.run + 1
    if len(runs) < width:
        return runs[:0], runs[:0]
    least = _sliding(runs, width, np.minimum)
    padded = np.concatenate([np.zeros(width - 1, "u8"), least, np.zeros(width - 1, "u8")])
    return least, runs[_sliding(padded, width, np.maximum) == runs]


def _sha(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode("utf-8", "surrogatepass")).hexdigest()


def scan(docs: DataFrame, p: Passages) -> DataFrame:
    """node, doc_id, text_no, n_words, whole_sha256, anchors of every row, in one pass.

    `anchors` holds each anchor of the text once, with the times it occurs there.
    """
    names = ["node", "doc_id", "text_no", "n_words", "whole_sha256", "anchors"]
    pair = pa.struct([("anchor", pa.int64()), ("times", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = [split_words(t) for t in texts(part.column(3))]
            found = [np.unique(window_anchors(word_hashes(w), p)[1], return_counts=True) for w in words]
            flat = pa.StructArray.from_arrays(
                [
                    pa.array(np.concatenate([a for a, _ in found]).view("i8")),
                    pa.array(np.concatenate([n for _, n in found]).astype("i4")),
                ],
                fields=list(pair),
            )
            ends = np.cumsum([0, *(len(a) for a, _ in found)]).astype("i4")
            columns = [
                pa.array(list(map(len, words)), pa.int64()),
                pa.array(list(map(_sha, words)), pa.string()),
                pa.ListArray.from_arrays(pa.array(ends), flat),
            ]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *columns], names)

    schema = (
        "node bigint, doc_id bigint, text_no binary, n_words bigint, whole_sha256 string,"
        " anchors array<struct<anchor: bigint, times: int>>"
    )
    return _named(docs).mapInArrow(run, schema)


def _named(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    doc_id = F.col("doc_id").cast("bigint")
    return docs.select(F.coalesce(doc_id, F.lit(_LAST)).alias("node"), doc_id.alias("doc_id"), F.unhex(F.md5(text)).alias("text_no"), text.alias("text"))


def routes(rows: DataFrame, p: Passages) -> DataFrame:
    """anchor, route, parts of every repeated anchor, from rows (anchor, node)."""
    anchors = rows.groupBy("anchor").agg(F.count("*").alias("n"), F.min("node").alias("home"))
    homes = anchors.groupBy("home").agg(F.sum("n").alias("together"))
    limit = F.lit(p.shard_anchors)
    return anchors.join(homes, "home").select(
        "anchor",
        F.when(F.col("together") <= limit, F.xxhash64("home"))
        .when(F.col("n") <= limit, F.xxhash64("home", F.pmod("anchor", F.ceil(F.col("together") / limit))))
        .otherwise(F.xxhash64("home", "anchor"))
        .alias("route"),
        F.when(F.col("n") <= limit, 1).otherwise(F.ceil(F.col("n") / limit)).cast("int").alias("parts"),
    )


def _segments(words: list[str], wanted: dict[int, tuple[int, int]], p: Passages) -> list[tuple[int, int, int]]:
    """Route, first word and number of windows of each run of wanted windows."""
    hashes = word_hashes(words)
    anchors = window_anchors(hashes, p)[0].view("i8")
    keys = np.array(sorted(wanted), "i8")
    if not len(anchors) or not len(keys):
        return []
    at = np.minimum(np.searchsorted(keys, anchors), len(keys) - 1)
    hit = keys[at] == anchors
    route = np.array([wanted[k][0] for k in keys.tolist()], "i8")[at]
    parts = np.array([wanted[k][1] for k in keys.tolist()], "u8")[at]
    apart = hit & (parts > 1)
    if apart.any():
        own = run_hashes(hashes, p.window)[apart] % parts[apart]
        route[apart] = mix(route[apart].view("u8") + own * np.uint64(0x9E3779B97F4A7C15)).view("i8")
    first = np.flatnonzero(hit & np.r_[True, ~hit[:-1] | (route[1:] != route[:-1])])
    last = np.flatnonzero(hit & np.r_[~hit[1:] | (route[1:] != route[:-1]), True])
    return [(int(route[a]), int(a), int(b - a + 1)) for a, b in zip(first, last)]


def segments(docs: DataFrame, wanted: DataFrame, shards: int, p: Passages) -> DataFrame:
    """shard, node, text_no, start, n, segment_no, segment of texts with repeated anchors.

    `wanted`: node, anchors (array of anchor, route, parts). Rows without a segment are
    windows that an earlier one of the same batch of texts equals.
    """
    names = ["shard", "node", "text_no", "start", "n", "segment_no", "segment"]
    types = [pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, held = [], 0
        for part in slices(batches, 128):
            for node, text_no, text, anchors in zip(*(part.column(c).to_pylist() for c in range(4))):
                words = split_words(text)
                for route, start, n in _segments(words, {a["anchor"]: (a["route"], a["parts"]) for a in anchors}, p):
                    cut.append((node, text_no, start, route, words[start : start + n + p.window - 1]))
                    held += n + p.window - 1
            if held >= p.batch_words:
                yield from remaining(cut)
                cut, held = [], 0
        yield from remaining(cut)

    def remaining(cut: list[tuple]) -> Iterator[pa.RecordBatch]:
        cut.sort(key=lambda c: c[:3])
        out: list[tuple] = []
        for (node, text_no, start, route, words), late in zip(cut, repeated_windows([c[4] for c in cut], p)):
            gone = np.zeros(len(words) - p.window + 1, bool)
            gone[late] = True
            edges = np.flatnonzero(np.r_[True, gone[1:] != gone[:-1], True]).tolist()
            for a, b in zip(edges, edges[1:]):
                number = segment = shard = None
                if not gone[a]:
                    segment = " ".join(words[a : b + p.window - 1])
                    key = route.to_bytes(8, "big", signed=True)
                    number = hashlib.blake2b(segment.encode("utf-8", "surrogatepass"), digest_size=16, key=key).digest()
                    shard = route % shards
                out.append((shard, node, text_no, start + a, b - a, number, segment))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    schema = "shard int, node bigint, text_no binary, start int, n int, segment_no binary, segment string"
    named = _named(docs).select("node", "text_no", "text").join(wanted, "node")
    return named.mapInArrow(run, schema)


def repeated_windows(parts: list[list[str]], p: Passages) -> list[np.ndarray]:
    """For each segment (its words), in order of first appearance, the windows that an
    earlier window of any of the segments equals."""
    if not parts:
        return []
    known: dict[str, int] = {}
    split = [[known.setdefault(w, len(known) + 1) for w in s] for s in parts]
    lengths = np.array([len(s) for s in split])
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    sequence = np.zeros(int(lengths.sum() + len(split)), "i8")  # a 0 after each segment
    for start, s in zip(starts, split):
        sequence[start : start + len(s)] = s
    windows = np.concatenate([np.arange(a, a + n - p.window + 1) for a, n in zip(starts, lengths)])
    # windows whose hash is unique match nothing: only the others are searched
    hashes = run_hashes(mix(sequence.view("u8")), p.window)[windows]
    _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    asked = windows[counts[inverse] > 1]
    late = np.zeros(len(sequence), bool)
    if len(asked):
        index = FMIndex(sequence, len(known) + 1, p.window)
        length, low, high = index.matching(sequence, asked + p.window, p.window)
        full = length == p.window
        late[asked[full]] = index.earliest(low[full], high[full]) < asked[full]
    return [np.flatnonzero(late[a : a + n - p.window + 1]) for a, n in zip(starts, lengths)]


def judge_shards(parts: DataFrame, p: Passages) -> DataFrame:
    """node, text_no, from, to: words that repeated windows of distinct segments cover."""

    def judge(group: pa.Table) -> pa.Table:
        group = group.sort_by([("node", "ascending"), ("text_no", "ascending"), ("start", "ascending")])
        found = repeated_windows([s.split(" ") for s in group["segment"].to_pylist()], p)
        node, text_no, start = (group[c].to_pylist() for c in ("node", "text_no", "start"))
        out = []
        for k, late in enumerate(found):
            if len(late):
                cut = np.flatnonzero(np.diff(late) > 1)
                for a, b in zip(late[np.r_[0, cut + 1]], late[np.r_[cut, len(late) - 1]]):
                    out.append((node[k], text_no[k], start[k] + int(a), start[k] + int(b) + p.window))
        types = (pa.int64(), pa.binary(), pa.int32(), pa.int32())
        columns = list(zip(*out)) or [[], [], [], []]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("node", "text_no", "from", "to"), columns, types)})

    return parts.select("shard", "node", "text_no", "start", "segment").groupBy("shard").applyInArrow(
        judge, "node bigint, text_no binary, from int, to int"
    )


@dataclass
class Repeats:
    """`rows`: scan of every row; `first`: smallest node of each text; `cuts`: node, text_no
    and the words to remove (array of from, to) of texts that keep some others' windows."""

    rows: DataFrame
    first: DataFrame
    cuts: DataFrame


def find_repeats(docs: DataFrame, p: Passages = Passages()) -> Repeats:
    rows = stored(scan(docs, p), "anchors")
    first = stored(rows.groupBy("text_no").agg(F.min("node").alias("first")), "first")
    originals = rows.where(F.size("anchors") > 0).join(first, "text_no").where("node = first")
    seen = originals.dropDuplicates(["node", "text_no"]).select("node", F.inline("anchors"))
    several = seen.groupBy("anchor").agg(F.sum("times").alias("n")).where("n > 1").select("anchor")
    repeated = stored(seen.join(several, "anchor").select("node", "anchor"), "repeated")
    shards = max(1, math.ceil(repeated.count() / p.shard_anchors))
    wanted = (
        repeated.join(routes(repeated, p), "anchor")
        .groupBy("node")
        .agg(F.collect_list(F.struct("anchor", "route", "parts")).alias("anchors"))
    )
    sent = stored(segments(docs, wanted, shards, p), "segments")
    # of equal segments all but the first are covered by it; copies of whole texts are not asked
    place = F.struct("node", "text_no", "start")
    within = sent.where("segment is null")
    sent = sent.where("segment is not null")
    earliest = sent.groupBy("segment_no").agg(F.min(place).alias("earliest"))
    marked = sent.join(earliest, "segment_no").withColumn("own", place == F.col("earliest"))
    judged = judge_shards(marked.where("own").dropDuplicates(["segment_no"]), p)
    whole = marked.where(~F.col("own")).select(*within.columns).unionByName(within).select("node", "text_no", F.col("start").alias("from"), (F.col("start") + F.col("n") + p.window - 1).alias("to"))
    cuts = judged.unionByName(whole).groupBy("node", "text_no").agg(F.collect_list(F.struct("from", "to")).alias("cuts"))
    return Repeats(rows, first, stored(cuts, "cuts"))


def _kept(words: list[str], cuts: list[dict]) -> list[str]:
    gone = np.zeros(len(words) + 1, "i4")
    for c in cuts:
        gone[c["from"]] += 1
        gone[c["to"]] -= 1
    return [w for w, g in zip(words, np.cumsum(gone)) if not g]


def removal_digest(docs: DataFrame, p: Passages = Passages()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row.

    A null text has no words. Rows equal in doc_id and text are one document, texts that
    share a doc_id come in the order of their digest, a null doc_id after all others.
    """
    found = find_repeats(docs, p)
    names = ["node", "text_no", "n_removed", "kept_sha256"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            counts, hashes = [], []
            for text, cuts in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                words = split_words(text)
                kept = _kept(words, cuts)
                counts.append(len(words) - len(kept))
                hashes.append(_sha(kept))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array(hashes, pa.string())], names)

    cut = (
        _named(docs).select("node", "text_no", "text").join(found.cuts, ["node", "text_no"])
        .mapInArrow(digest, "node bigint, text_no binary, n_removed bigint, kept_sha256 string")
        .dropDuplicates(["node", "text_no"])
    )
    copy = (F.col("node") > F.col("first")) & (F.col("n_words") >= p.window)
    return (
        found.rows.drop("anchors")
        .join(found.first, "text_no")
        .join(cut, ["node", "text_no"], "left")
        .select(
            "doc_id",
            "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(copy, F.lit(_sha([]))).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
        )
    )


def without_repeats(docs: DataFrame, p: Passages = Passages()) -> DataFrame:
    """All rows of `docs` with their columns; texts that lose words are their kept words,
    joined by a space. Untouched texts stay as they are; a null text stays null."""
    found = find_repeats(docs, p)
    cuts = found.cuts.withColumnsRenamed({"node": "__node", "text_no": "__text_no", "cuts": "__cuts"})
    first = found.rows.where(F.col("n_words") >= p.window).select("node", "text_no").join(found.first, "text_no").where("node > first")
    copies = first.select(F.col("node").alias("__node"), F.col("text_no").alias("__text_no"), F.lit(True).alias("__copy")).distinct()
    marks = cuts.join(copies, ["__node", "__text_no"], "full")

    def cut(text: pa.Array, cuts: pa.Array) -> pa.Array:
        return pa.array(
            [t if c is None else " ".join(_kept(split_words(t), c)) for t, c in zip(text.to_pylist(), cuts.to_pylist())],
            pa.string(),
        )

    named = docs.withColumn("__key", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)))
    text_no = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))
    joined = named.join(marks, (F.col("__key") == F.col("__node")) & (text_no == F.col("__text_no")), "left")
    kept = F.when(F.col("__copy"), F.lit("")).when(F.col("__cuts").isNull(), F.col("text")).otherwise(F.arrow_udf(cut, "string")("text", "__cuts"))
    return joined.withColumn("text", kept).select(*docs.columns)
