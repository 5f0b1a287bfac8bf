"""Near-duplicate classes by ProbMinHash over weighted word shingles.

Weights are the counts of a text's runs of five words. Each element arrives in a Poisson
process at the rate of its weight, each arrival at a hashed register; a register keeps
the element of its first arrival, and an element stops once its next arrival is later
than all registers of its text. Two texts agree in a register with a probability of
their probability Jaccard similarity. Bands of registers give buckets.

Equal texts are one from the start. In a bucket, members are compared with a leader, not
with each other; texts that are connected already need no further comparison. Buckets
whose members are in several components can get further leaders; in the end the
remaining pairs of different components in a bucket are compared, but for those whose
similarity has a bound below the threshold (see `remaining_pairs`). So no link between two
texts of one bucket that could join components is left out. Pairs are verified exactly,
on all shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayglass.llm.common import slices, stored, texts
from dayglass.llm.components import components
from dayglass.llm.words import mix, run_hashes, word_hashes


@dataclass(frozen=True)
class Matching:
    """With 36 bands of 8 rows, texts of similarity 0.8 meet with a probability of 0.9987."""

    words: int = 5
    similarity: float = 0.8
    bands: int = 36
    rows: int = 8
    leaders: int = 1  # rounds of leaders before the remaining pairs
    rare: int = 3  # texts that share a rare shingle, at most


def shingles(text: str, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the runs of `length` words, lower-cased, and their counts. A shorter
    text is one run; a text without words has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, "u8"), np.zeros(0, "i8")
    found = run_hashes(word_hashes(words), min(length, len(words)))
    return np.unique(found, return_counts=True)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over shared elements i of 1 / sum_j max(x_j / x_i, y_j / y_i)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    x, y = a[1] / a[1].sum(), b[1] / b[1].sum()
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    xs, ys = x[i], y[j]
    order = np.argsort(ys / xs, kind="stable")
    xs, ys = xs[order], ys[order]
    ratio = ys / xs
    only_x, only_y = max(0.0, 1 - xs.sum()), max(0.0, 1 - ys.sum())
    last = np.searchsorted(ratio, ratio, side="right")  # elements of at most this ratio
    below, above = np.r_[0, np.cumsum(xs)], np.r_[np.cumsum(ys[::-1])[::-1], 0]
    return float((xs / (only_x + below[last] + (only_y + above[last]) / ratio)).sum())


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, number: int, registers: int) -> np.ndarray:
    """The element of each register of each of `number` texts; 0 if a text has no element."""
    first = np.full(number * registers, np.inf)
    held = np.zeros(number * registers, "u8")
    clock = np.zeros(len(element))
    step, width = 0, 1
    while len(element):
        turns = np.arange(step, step + width, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)
        bits = mix(element[:, None] + turns[None, :])
        waits = -np.log(((bits >> np.uint64(11)).astype("f8") + 0.5) * 2.0**-53) / weight[:, None]
        waits[:, 0] += clock
        times = waits if width == 1 else np.cumsum(waits, axis=1)
        register = mix(bits ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(registers)
        place = (owner[:, None] * registers + register.astype("i8")).ravel()
        flat = times.ravel()
        np.minimum.at(first, place, flat)
        won = flat == first[place]
        held[place[won]] = np.repeat(element, width)[won]
        clock = times[:, -1]
        latest = first.reshape(number, registers).max(axis=1)
        going = clock < latest[owner]
        owner, element, weight, clock = owner[going], element[going], weight[going], clock[going]
        step += width
        width = width if step < 4 else min(64, step)
    return held.reshape(number, registers)


def _bands(batch: list[str], m: Matching) -> list[np.ndarray]:
    """Bucket keys of each text; none for a text without words."""
    parts = [shingles(t, m.words) for t in batch]
    owner = np.repeat(np.arange(len(batch)), [len(p[0]) for p in parts])
    element, weight = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    held = signatures(owner, element, weight.astype("f8"), len(batch), m.bands * m.rows)
    held = held.reshape(len(batch), m.bands, m.rows)
    key = np.zeros((len(batch), m.bands), "u8") + np.arange(1, m.bands + 1, dtype="u8")
    for k in range(m.rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + held[:, :, k])
    return [row.view("i8") if len(p[0]) else np.zeros(0, "i8") for row, p in zip(key, parts)]


def _text_key(text: Column) -> Column:
    return F.unhex(F.sha1(F.coalesce(text, F.lit(""))))


def sketches(docs: DataFrame, m: Matching) -> DataFrame:
    """doc_id, text_key, bands of every row, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            found = _bands(texts(part.column(2)), m)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "text_key", "bands"]
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _text_key(F.col("text")).alias("text_key"), "text")
    return rows.mapInArrow(run, "doc_id bigint, text_key binary, bands array<bigint>")


def shingle_table(docs: DataFrame, ids: DataFrame, m: Matching) -> DataFrame:
    """node, elements, counts (flat little-endian arrays) of the texts in `ids` (doc_id, text_key, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [shingles(t, m.words) for t in texts(part.column(1))]
            columns = [
                pa.array([a.astype("<u8").tobytes() for a, _ in found], pa.binary()),
                pa.array([b.astype("<i4").tobytes() for _, b in found], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["node", "elements", "counts"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _text_key(F.col("text")).alias("text_key"), "text")
    rows = rows.join(ids, ["doc_id", "text_key"]).select("node", "text")
    return rows.mapInArrow(run, "node bigint, elements binary, counts binary").dropDuplicates(["node"])


def verified(pairs: DataFrame, table: DataFrame, m: Matching) -> DataFrame:
    """Pairs (a, b) with their exact similarity."""

    def run(ea: pa.Array, ca: pa.Array, eb: pa.Array, cb: pa.Array) -> pa.Array:
        out = []
        for row in zip(*(c.to_pylist() for c in (ea, ca, eb, cb))):
            x, cx, y, cy = (np.frombuffer(v, t) for v, t in zip(row, ("<u8", "<i4", "<u8", "<i4")))
            out.append(probability_jaccard((x, cx), (y, cy)))
        return pa.array(out, pa.float64())

    left = table.select(F.col("node").alias("a"), F.col("elements").alias("ea"), F.col("counts").alias("ca"))
    right = table.select(F.col("node").alias("b"), F.col("elements").alias("eb"), F.col("counts").alias("cb"))
    similarity = F.arrow_udf(run, "double")("ea", "ca", "eb", "cb")
    return pairs.join(left, "a").join(right, "b").select("a", "b", similarity.alias("similarity"))


def _elements(table: DataFrame) -> DataFrame:
    """node, element, count: the rows of a shingle table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            rows = [
                (node, np.frombuffer(e, "<i8"), np.frombuffer(c, "<i4"))
                for node, e, c in zip(*(part.column(k).to_pylist() for k in ("node", "elements", "counts")))
            ]
            nodes = np.repeat([r[0] for r in rows], [len(r[1]) for r in rows])
            columns = [pa.array(nodes, pa.int64()), *(pa.array(np.concatenate([r[k] for r in rows])) for k in (1, 2))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "element", "count"])

    return table.mapInArrow(run, "node bigint, element bigint, count int")


def remaining_pairs(labelled: DataFrame, table: DataFrame, m: Matching) -> DataFrame:
    """Pairs (a, b) of different components of a bucket that may be similar enough.

    `labelled`: bucket, node, component. Two texts that share a shingle which few others
    hold are a pair. Any other two share common shingles only; if those are the shares h
    and k of their weights, the similarity is at most hk / (h + k - hk), and for texts
    without repeated shingles, with c and d common ones of n and o, at most
    min(c, d) / (n + o - min(c, d)). A bucket's largest component is not paired with itself.
    """
    nodes = labelled.select("node", "component").distinct()
    elements = stored(_elements(table.join(nodes.select("node"), "node", "left_semi")), "elements")
    few = elements.groupBy("element").agg(F.count("*").alias("holders")).where(F.col("holders") <= m.rare)
    rare = stored(elements.join(few, "element"), "rare")
    uncommon = rare.groupBy("node").agg(F.sum("count").alias("uncommon"))
    weights = (
        elements.groupBy("node")
        .agg(F.sum("count").alias("n"), (F.max("count") == 1).alias("flat"))
        .join(uncommon, "node", "left")
        .select("node", "n", "flat", (F.col("n") - F.coalesce("uncommon", F.lit(0))).alias("c"))
    )
    members = stored(labelled.select("bucket", "node", "component").join(weights, "node"), "weighed")
    sizes = members.groupBy("bucket", "component").agg(F.count("*").alias("k"))
    main = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("k", "component")).alias("main"))
    rest = members.join(main, "bucket").where("component <> main").drop("main")
    rest = rest.select(F.col("bucket").alias("in_"), *(F.col(c).alias(f"{c}_") for c in rest.columns if c != "bucket"))
    c = F.least("c", "c_")
    h, k = F.col("c") / F.col("n"), F.col("c_") / F.col("n_")
    bound = F.when(F.col("flat") & F.col("flat_"), c / (F.col("n") + F.col("n_") - c)).otherwise(
        F.when(F.least(h, k) <= 0, 0.0).otherwise(h * k / (h + k - h * k))
    )
    near = (F.col("bucket") == F.col("in_")) & (F.col("component") != F.col("component_")) & (bound >= m.similarity - 1e-9)
    pairs = members.join(rest, near).select(F.least("node", "node_").alias("a"), F.greatest("node", "node_").alias("b"))
    holders = F.array_sort(F.collect_list(F.struct("node", "component")))  # at most m.rare
    shared = (
        rare.where("holders > 1")
        .join(nodes, "node")
        .groupBy("element")
        .agg(holders.alias("x"))
        .select("x", F.explode("x").alias("one"))
        .select("one", F.explode("x").alias("two"))
        .where("one.node < two.node and one.component <> two.component")
        .select(F.col("one.node").alias("a"), F.col("two.node").alias("b"))
    )
    return pairs.union(shared).distinct()


def _classes(docs: DataFrame, m: Matching) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, text_key), and of each distinct text its text_key, n_equal, and
    the smallest doc_id and text_key of its class (class_id, class_key).

    Nodes are numbers of the distinct texts in the order of (smallest doc_id, text_key).
    """
    rows = stored(sketches(docs, m), "sketches")
    distinct = rows.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_equal"))
    distinct = stored(distinct.orderBy("doc_id", "text_key").withColumn("node", F.monotonically_increasing_id()), "distinct")
    named = distinct.where("doc_id is not null").select("doc_id", "text_key", "node")
    own = rows.join(named, ["doc_id", "text_key"])
    banded = own.select("node", F.explode("bands").alias("bucket")).distinct()
    several = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(banded.join(several, "bucket"), "members")
    # texts that meet the most others lead: they are in the middle of their group
    meets = members.groupBy("node").agg(F.sum("n").alias("meets"))
    members = stored(members.drop("n").join(meets, "node"), "members")
    table = stored(shingle_table(docs, named.join(members.select("node").distinct(), "node", "left_semi"), m), "shingles")

    compared, labels = None, None
    for turn in range(m.leaders + 1):
        if labels is None:
            labelled = members.withColumn("component", F.col("node"))
        else:
            labelled = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        open_ = (
            labelled.groupBy("bucket")
            .agg(F.min("component").alias("low"), F.max("component").alias("high"))
            .where("low < high")
            .select("bucket")
        )
        labelled = stored(labelled.join(open_, "bucket"), "open")
        if labels is not None and labelled.isEmpty():
            break
        if turn < m.leaders:
            rank = F.struct("meets", "node") if turn == 0 else F.struct(F.xxhash64("node", F.lit(turn)), "node")
            leader = labelled.groupBy("bucket").agg(F.max_by(F.struct("node", "component"), rank).alias("leader"))
            met = labelled.join(leader, "bucket").where("component <> leader.component")
            other = F.col("leader.node")
            pairs = met.select(F.least("node", other).alias("a"), F.greatest("node", other).alias("b")).distinct()
        else:
            pairs = remaining_pairs(labelled, table, m)
        if compared is not None:
            pairs = pairs.join(compared.select("a", "b"), ["a", "b"], "left_anti")
        found = stored(verified(pairs, table, m), "compared")
        compared = found if compared is None else compared.unionByName(found)
        labels = components(compared.where(F.col("similarity") >= m.similarity).select("a", "b"))
    first = named.select(F.col("node").alias("component"), F.col("doc_id").alias("class_id"), F.col("text_key").alias("class_key"))
    classed = labels.join(first, "component").drop("component")
    classes = distinct.join(classed, "node", "left").select(
        "text_key", "n_equal", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_key", "text_key").alias("class_key")
    )
    return rows.select("doc_id", "text_key"), classes


def near_duplicates(docs: DataFrame, m: Matching = Matching()) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class), class_key, n_equal (rows with its text).

    Classes are the connected components of texts of similarity m.similarity or more. A
    null text is empty; texts without words are alike only if equal; a row without doc_id
    joins the class of its text, or none (class_id null) if no row with that text has an id.
    Unlike texts may share an id: class_key, the SHA-1 of the text of the smallest
    (doc_id, SHA-1) of the class, tells their classes apart.
    """
    rows, classes = _classes(docs, m)
    return rows.join(classes, "text_key").select("doc_id", "class_id", F.hex("class_key").alias("class_key"), "n_equal")


def keep_one(docs: DataFrame, m: Matching = Matching()) -> DataFrame:
    """The document of each class that has the smallest id, all columns as they were.

    Of a class's texts with that id the one of the smallest SHA-1 stays, and of rows with
    the same id and text the one whose other columns come first as JSON. Unlike texts that
    share an id are different classes, each of which keeps a row. A document without id
    belongs to no class and stays.
    """
    _, classes = _classes(docs, m)
    kept = classes.where("text_key = class_key and class_id is not null").select(
        F.col("class_id").alias("__id"), F.col("text_key").alias("__key")
    )
    columns = [F.col(f"`{c}`") for c in docs.columns]
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    tie = F.to_json(F.struct(*others)) if others else F.lit("")
    named = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("bigint").alias("__id"), _text_key(F.col("text")).alias("__key"), F.struct(*columns).alias("__row"), tie.alias("__tie")
    )
    # null and empty texts have one key
    order = F.struct("__tie", F.col("__row.text").isNull())
    one = named.join(kept, ["__id", "__key"], "left_semi").groupBy("__id", "__key").agg(F.min_by("__row", order).alias("__row"))
    return one.select("__row.*").unionByName(docs.where("doc_id is null"))
