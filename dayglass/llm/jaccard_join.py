"""Operator 11: all pairs of texts whose shingle sets are alike, by adaptive multi-match prefixes.

A text's set is its distinct runs of three words. Sets are put in one order of all
shingles, rare ones first by a bounded table of counts. Two sets of the asked similarity
share a shingle among the first |x| - t + 1 of each (t is the least overlap of x), and
share k of them among the first |x| - t + k. So one-shingle prefixes find the candidates,
and each text lengthens its prefix by as many shingles as its estimated candidates are
worth: a pair is only verified if the lengthened prefixes share as many as the smaller
lengthening asks.

Sizes and the parities of 512 bins, which differ in no more bins than the sets do in
shingles, drop most other pairs before any set is fetched.

Equal sets are one node. Links are followed to their components without all pairs of a
group: the members of a prefix bucket are compared with its leader first, and then only
members of different components with one another.

Defined results: null and empty texts have no shingles and no links; a text of fewer than
three words is one shingle, its whole sequence; equal rows count each; texts that share an
id keep their own sets; rows without an id take part, and their component is the smallest
id they reach (null if none). Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dayglass.llm.byte_words import Words, by_bytes, byte_classes, words
from dayglass.llm.common import shuffle_tasks, stored
from dayglass.llm.components import components
from dayglass.llm.words import mix

CLASSES = byte_classes(b" \t\n\x0b\x0c\r")
#: Places of the table of shingle counts, and the parts in which its sums are made.
PLACES, PARTS = 1 << 18, 16
#: Shingles beyond which a set keeps bin counts besides its parities.
LONG = 2048
#: Sets that a task remembers to have sent.
SEEN = 200_000


@dataclass(frozen=True)
class Join:
    """Words of a shingle; similarity as a fraction; the longest lengthening; leader rounds."""

    words: int = 3
    above: int = 90
    below: int = 100
    longest: int = 12
    leaders: int = 1

    def overlap(self, n: np.ndarray) -> np.ndarray:
        """The least overlap of a set of n with any set it links to."""
        return -(-self.above * n // self.below)


def shingle_sets(found: Words, rows: int, length: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each row, ascending."""
    bounds = np.searchsorted(found.rows, np.arange(rows + 1))
    n = len(found.hashes)
    code = np.zeros(max(n - length + 1, 0), "u8")
    for k in range(length):
        code = code * np.uint64(0xD6E8FEB86659FD93) + found.hashes[k : k + len(code)]
    code = mix(code)
    sets = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= length:
            sets.append(np.unique(code[a : b - length + 1]))
        elif b > a:
            short = np.array([b - a], "u8")  # mixed at each word, unlike a full shingle
            for h in found.hashes[a:b]:
                short = mix(short * np.uint64(0xA0761D6478BD642F) + h)
            sets.append(short)
        else:
            sets.append(np.zeros(0, "u8"))
    return sets


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order."""
    one, two = mix(tokens), mix(tokens ^ np.uint64(0x5851F42D4C957F2D))
    return int(one.sum(dtype="u8").astype("i8")), int(two.sum(dtype="u8").astype("i8"))


def place(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(46)).astype("i8")


def parities(tokens: np.ndarray) -> list[int]:
    """Whether each of 512 bins holds an odd number of shingles, as eight 64-bit numbers.

    The bins in which two sets differ are at most as many as the shingles in which they do.
    """
    bins = np.bincount(mix(tokens ^ np.uint64(0x8CB92BA72F3D8DD7)) >> np.uint64(55), minlength=512).astype("u1") & 1
    return np.packbits(bins).view("i8").tolist()


def bin_counts(tokens: np.ndarray) -> bytes | None:
    """Of a long set, whose parities say little: shingles in each of n / 16 bins (a power of two)."""
    if len(tokens) <= LONG:
        return None
    bits = int(len(tokens) - 1).bit_length() - 4
    return np.bincount((mix(tokens ^ np.uint64(0x8CB92BA72F3D8DD7)) >> np.uint64(64 - bits)).astype("i8"), minlength=1 << bits).astype("<u4").tobytes()


def apart(x: bytes, y: bytes) -> int:
    """A number that two sets differ by at least, from their bins; the wider ones are folded."""
    a, b = (np.frombuffer(v, "<u4").astype("i8") for v in (x, y))
    size = min(len(a), len(b))
    return int(np.abs(a.reshape(size, -1).sum(axis=1) - b.reshape(size, -1).sum(axis=1)).sum())


def summaries(docs: DataFrame, j: Join) -> DataFrame:
    """Rows of two kinds in one pass: doc_id, n, k1, k2, parity, bins of each text, and part, counts of each task."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("parity", pa.list_(pa.int64()))]
        + [("bins", pa.binary()), ("part", pa.int32()), ("counts", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(PLACES, "i8")
        for batch in by_bytes(batches, "text"):
            sets = shingle_sets(words(batch.column(1), CLASSES), batch.num_rows, j.words)
            held += np.bincount(place(np.concatenate(sets)), minlength=PLACES)
            out = [
                {"doc_id": d, "n": len(s), **dict(zip(("k1", "k2"), set_key(s))), "parity": parities(s), "bins": bin_counts(s)}
                for d, s in zip(batch.column(0).to_pylist(), sets)
            ]
            yield pa.RecordBatch.from_pylist(out, schema)
        if held.any():
            parts = held.astype("<i8").reshape(PARTS, -1)
            yield pa.RecordBatch.from_pylist([{"part": k, "counts": p.tobytes()} for k, p in enumerate(parts)], schema)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, n bigint, k1 bigint, k2 bigint, parity array<bigint>, bins binary, part int, counts binary")


def summed(parts: DataFrame) -> np.ndarray:
    """The tables of (part, counts) rows added up: PLACES numbers, whatever the input."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts, "<i8")
        schema = pa.schema([("part", pa.int32()), ("counts", pa.binary())])
        yield pa.RecordBatch.from_pylist([{"part": part, "counts": counts.tobytes()} for part, counts in sums.items()], schema)

    width = PLACES // PARTS
    total = np.zeros(PLACES, "i8")
    for row in parts.repartition(PARTS, "part").mapInArrow(add, "part int, counts binary").collect():
        total[row["part"] * width : (row["part"] + 1) * width] = np.frombuffer(row["counts"], "<i8")
    return total


def marks(keys: DataFrame) -> np.ndarray:
    """Which places hold a set of `keys` (k1): a bounded filter that lets all of them through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(PLACES, "i8")
        for batch in batches:
            held[place(batch.column(0).to_numpy().view("u8"))] = 1
        parts = held.astype("<i8").reshape(PARTS, -1)
        schema = pa.schema([("part", pa.int32()), ("counts", pa.binary())])
        yield pa.RecordBatch.from_pylist([{"part": k, "counts": p.tobytes()} for k, p in enumerate(parts) if p.any()], schema)

    return summed(keys.select("k1").mapInArrow(run, "part int, counts binary")) > 0


def in_order(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rare shingles first; ties by hash, so that all sets use one order."""
    return tokens[np.lexsort((tokens, counts[place(tokens)]))]


def lengthening(ordered: np.ndarray, counts: np.ndarray, noise: float, j: Join) -> int:
    """By how many shingles the prefix is worth lengthening: 1 to j.longest.

    `counts` less `noise`, the mean of all places, estimates how many texts hold a shingle.
    With k further ones, at most their sum / k texts share k. Reading a prefix entry costs
    1, verifying a text its size.
    """
    n = len(ordered)
    least = int(j.overlap(n))
    most = min(j.longest, least)
    held = np.cumsum(np.maximum(counts[place(ordered[: n - least + most])] - noise, 0))
    k = np.arange(1, most + 1)
    sums = held[n - least + k - 1]
    cost = (n - least + k) + sums * n / k
    return int(k[np.argmin(cost)])


def prefixes(docs: DataFrame, counts, j: Join) -> DataFrame:
    """token, n, k1, k2: the one-shingle prefix of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = counts.value
        seen: set[tuple[int, int]] = set()  # equal sets of a task are sent once
        for batch in by_bytes(batches, "text"):
            new = {}
            for s in shingle_sets(words(batch.column(0), CLASSES), batch.num_rows, j.words):
                if len(s) and (key := set_key(s)) not in seen:
                    new[key] = s
            seen = (seen if len(seen) < SEEN else set()) | new.keys()
            if not new:
                continue
            sets = list(new.values())
            firsts = [in_order(s, held)[: len(s) - int(j.overlap(len(s))) + 1] for s in sets]
            keys = np.array([(len(s), *key) for key, s in new.items()], "i8")
            each = np.repeat(keys, [len(f) for f in firsts], axis=0)
            columns = [np.concatenate(firsts).view("i8"), each[:, 0], each[:, 1], each[:, 2]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "n", "k1", "k2"])

    return docs.select("text").mapInArrow(run, "token bigint, n bigint, k1 bigint, k2 bigint")


def set_table(docs: DataFrame, wanted: DataFrame, counts, j: Join) -> DataFrame:
    """node, lead, prefix, tokens of the sets in `wanted` (node, n, k1, k2).

    `prefix` is lengthened by lead shingles; both it and `tokens` are ascending 64-bit numbers.
    No text is shuffled: a bounded filter holds the wanted sets, and the join drops the few
    others that it lets through.
    """
    marked = docs.sparkSession.sparkContext.broadcast(marks(wanted))
    schema = pa.schema([(c, pa.int64()) for c in ("n", "k1", "k2")] + [("lead", pa.int32()), ("prefix", pa.binary()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, let = counts.value, marked.value
        noise = float(held.mean())
        seen: set[tuple[int, int]] = set()
        for batch in by_bytes(batches, "text"):
            out = []
            for s in shingle_sets(words(batch.column(0), CLASSES), batch.num_rows, j.words):
                key = set_key(s)
                if not len(s) or key in seen or not let[place(np.array(key[:1], "i8").view("u8"))[0]]:
                    continue
                seen = seen if len(seen) < SEEN else set()
                seen.add(key)
                ordered = in_order(s, held)
                lead = lengthening(ordered, held, noise, j)
                prefix = np.sort(ordered[: len(s) - int(j.overlap(len(s))) + lead])
                out.append({"n": len(s), "k1": key[0], "k2": key[1], "lead": lead, "prefix": prefix.tobytes(), "tokens": s.tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema)

    found = docs.select("text").mapInArrow(run, "n bigint, k1 bigint, k2 bigint, lead int, prefix binary, tokens binary")
    return found.join(wanted, ["n", "k1", "k2"]).dropDuplicates(["n", "k1", "k2"]).select("node", "lead", "prefix", "tokens")


def _shared(x: bytes, y: bytes) -> int:
    return len(np.intersect1d(np.frombuffer(x, "u8"), np.frombuffer(y, "u8"), assume_unique=True))


def verified(pairs: DataFrame, table: DataFrame, j: Join) -> DataFrame:
    """The pairs (a, b) that link: the lengthened prefixes share enough, and so do the whole sets."""

    def run(*columns: pa.Array) -> pa.Array:
        out = []
        for lead_a, lead_b, prefix_a, prefix_b, a, b in zip(*(c.to_pylist() for c in columns)):
            linked = _shared(prefix_a, prefix_b) >= min(lead_a, lead_b)
            if linked:
                same = _shared(a, b)
                linked = j.below * same >= j.above * ((len(a) + len(b)) // 8 - same)
            out.append(linked)
        return pa.array(out, pa.bool_())

    names = ("lead", "prefix", "tokens")
    for side in ("a", "b"):
        one = table.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in names])
        pairs = pairs.join(one, side)
    return pairs.where(F.arrow_udf(run, "boolean")(*[f"{c}_{side}" for c in names for side in ("a", "b")])).select("a", "b")


def same_size(j: Join, n: str, m: str) -> Column:
    return j.below * F.least(n, m) >= j.above * F.greatest(n, m)


def parities_allow(j: Join, one: str, other: str) -> Column:
    """`one` and `other` are prefixes of the columns n and parity."""
    odd = [F.bit_count(F.col(f"{one}parity")[k].bitwiseXOR(F.col(f"{other}parity")[k])) for k in range(8)]
    return (j.below + j.above) * reduce(Column.__add__, odd) <= (j.below - j.above) * (F.col(f"{one}n") + F.col(f"{other}n"))


def likely(pairs: DataFrame, nodes: DataFrame, j: Join) -> DataFrame:
    """The pairs (a, b) whose parities and bin counts allow the similarity."""

    def run(*columns: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in columns))
        close = [x is None or y is None or (j.below + j.above) * apart(x, y) <= (j.below - j.above) * (n + m) for x, y, n, m in rows]
        return pa.array(close, pa.bool_())

    for side in ("a", "b"):
        one = nodes.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("n", "parity", "bins")])
        pairs = pairs.join(one, side)
    near = pairs.where(parities_allow(j, "a_", "b_"))
    return near.where(F.arrow_udf(run, "boolean")("a_bins", "b_bins", "a_n", "b_n")).select("a", "b")


def remaining(labelled: DataFrame, nodes: DataFrame, j: Join) -> DataFrame:
    """Pairs of a bucket's members in different components; the largest is not paired with itself."""
    sizes = labelled.groupBy("token", "component").agg(F.count("*").alias("k"))
    main = sizes.groupBy("token").agg(F.max_by("component", F.struct("k", "component")).alias("main"))
    # sizes and parities are part of the join: pairs that cannot link are not made
    members = labelled.drop("n", "meets").join(nodes.select("node", "n", "parity"), "node").join(main, "token")
    rest = members.where("component <> main").select(*[F.col(c).alias(f"other_{c}") for c in ("token", "node", "component", "n", "parity")])
    near = (F.col("token") == F.col("other_token")) & (F.col("component") != F.col("other_component"))
    near = near & same_size(j, "n", "other_n") & parities_allow(j, "", "other_")
    return members.join(rest, near).select("node", F.col("other_node").alias("other"))


def linked_sets(docs: DataFrame, j: Join = Join()) -> tuple[DataFrame, DataFrame]:
    """All rows (doc_id, n, k1, k2), and of each set that links to another: node, component, n, k1, k2."""
    sc = docs.sparkSession.sparkContext
    both = stored(summaries(docs, j), "summaries")
    rows = both.where("part is null").drop("part", "counts")
    counts = sc.broadcast(summed(both.where("part is not null").select("part", "counts")))
    key = ["n", "k1", "k2"]
    # one shuffle by token: equal sets once, then only those with one of like size beside them
    posted = prefixes(docs, counts, j).repartition(shuffle_tasks(docs.sparkSession), "token").distinct()
    beside = W.partitionBy("token").orderBy(*key)
    like = (j.below * F.lag("n").over(beside) >= j.above * F.col("n")) | (j.below * F.col("n") >= j.above * F.lead("n").over(beside))
    posted = stored(posted.withColumn("like", like).where("like").drop("like"), "prefixes")
    nodes = rows.join(posted.select(key).distinct(), key).groupBy(key).agg(F.any_value("parity").alias("parity"), F.any_value("bins").alias("bins"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = posted.join(nodes.select("node", *key), key).select("token", "node", "n")
    held = members.groupBy("token").agg(F.count("*").alias("held"))
    meets = members.join(held, "token").groupBy("node").agg(F.sum("held").alias("meets"))
    members = stored(members.join(meets, "node"), "members")
    links, labels = None, None
    for turn in range(j.leaders + 1):
        if labels is None:
            labelled = members.withColumn("component", F.col("node"))
        else:
            labelled = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        open_ = labelled.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        labelled = stored(labelled.join(open_.where("low < high").select("token"), "token"), "open")
        if turn < j.leaders:
            rank = F.struct("meets", "node") if turn == 0 else F.struct(F.xxhash64("node", F.lit(turn)), "node")
            leader = labelled.groupBy("token").agg(F.max_by(F.struct("node", "component", "n"), rank).alias("leader"))
            met = labelled.join(leader, "token").where(same_size(j, "n", "leader.n") & (F.col("component") != F.col("leader.component")))
            met = met.select("node", F.col("leader.node").alias("other"))
        else:
            met = remaining(labelled, nodes, j)
        met = met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
        pairs = stored(likely(met.distinct(), nodes, j), "pairs")
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        wanted = stored(nodes.join(ends, "node").select("node", *key), "wanted")
        table = stored(set_table(docs, wanted, counts, j), "sets")
        found = stored(verified(pairs, table, j), "links")
        links = found if links is None else links.unionByName(found)
        labels = components(links)
    return rows.select("doc_id", *key), labels.join(nodes.select("node", *key), "node")


def jaccard_components(docs: DataFrame, j: Join = Join()) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of every row."""
    rows, linked = linked_sets(docs, j)
    alike = rows.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("least"))
    grouped = alike.join(linked, ["n", "k1", "k2"])
    lowest = grouped.groupBy("component").agg(F.min("least").alias("lowest"))
    linked_least = grouped.join(lowest, "component").select("n", "k1", "k2", "lowest")
    named = alike.join(linked_least, ["n", "k1", "k2"], "left").select("n", "k1", "k2", F.coalesce("lowest", "least").alias("lowest"))
    out = rows.join(named, ["n", "k1", "k2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("lowest", "doc_id").alias("component_id"))
