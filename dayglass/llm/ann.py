"""Approximate nearest neighbours by inner product: an HNSW graph per shard.

Rows are dealt to shards of a bounded size by a hash of their id, so copies of one
vector spread over all shards; a shard holds each distinct vector once, with the ids
that have it. A shard is one row of flat arrays: vectors, the nodes of each level and
their neighbours (-1: none). Queries go to every shard in blocks of a bounded size; a
task searches one shard for one block at once, level by level, and keeps its best k by
exact double-precision products. The best k of all shards are the result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayglass.llm.common import stored


@dataclass(frozen=True)
class Graph:
    """`links` neighbours a node on the upper levels, twice as many on the lowest."""

    links: int = 16
    candidates: int = 64
    beam: int = 96
    shard_rows: int = 8192
    block_queries: int = 1024


INDEX = (
    "dim int, shard int, ids array<bigint>, firsts array<int>, vectors binary, kind string,"
    " level_nodes array<binary>, level_links array<binary>"
)


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _levels(ids: np.ndarray, links: int) -> np.ndarray:
    """Geometric levels from a hash of the id, so that a rebuilt shard is the same."""
    x = ids.astype("u8") + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    uniform = ((x >> np.uint64(11)).astype("f8") + 0.5) / 2.0**53
    return np.floor(-np.log(uniform) / math.log(links)).astype("i4")


def _diverse(own: np.ndarray, among: np.ndarray, keep: int) -> np.ndarray:
    """Which candidates (nearest first) to link to: those nearer to the node than to any
    candidate linked before, then the nearest of the rest. Returns positions, -1 padded."""
    rows, width = own.shape
    taken = np.zeros((rows, width), bool)
    for j in range(width):
        nearer = (among[:, j, :] > own[:, j, None]) & taken
        taken[:, j] = ~nearer.any(axis=1) & (own[:, j] > -np.inf) & (taken.sum(axis=1) < keep)
    order = np.argsort(~taken, axis=1, kind="stable")[:, :keep]
    empty = np.take_along_axis(own, order, axis=1) == -np.inf
    return np.where(empty, -1, order)


def _link(vectors: np.ndarray, degree: int, width: int) -> np.ndarray:
    """Neighbours of every vector among all: half by choice, the rest by whom they were chosen."""
    n = len(vectors)
    width = min(width, n - 1)
    if width <= 0:
        return np.full((n, degree), -1, "i4")
    chosen = np.full((n, degree // 2), -1, "i4")
    for start in range(0, n, 512):
        block = vectors[start : start + 512] @ vectors.T
        block[np.arange(len(block)), np.arange(start, start + len(block))] = -np.inf
        near = np.argpartition(-block, width - 1, axis=1)[:, :width]
        own = np.take_along_axis(block, near, axis=1)
        order = np.argsort(-own, axis=1, kind="stable")
        near, own = np.take_along_axis(near, order, axis=1), np.take_along_axis(own, order, axis=1)
        gathered = vectors[near]
        picked = _diverse(own, gathered @ gathered.transpose(0, 2, 1), degree // 2)
        found = np.take_along_axis(near, np.maximum(picked, 0), axis=1)
        chosen[start : start + len(block), : picked.shape[1]] = np.where(picked < 0, -1, found)
    source, slot = np.nonzero(chosen >= 0)
    target = chosen[source, slot]
    target = target.astype("i8")
    mutual = np.isin(target * n + source, source * n + target)
    source, target = source[~mutual], target[~mutual]  # linked both ways already
    closeness = np.einsum("ij,ij->i", vectors[source], vectors[target])
    order = np.lexsort((-closeness, target))
    source, target = source[order], target[order]
    nth = np.arange(len(target)) - np.searchsorted(target, target)
    room = nth < degree - chosen.shape[1]
    back = np.full((n, degree - chosen.shape[1]), -1, "i4")
    back[target[room], nth[room]] = source[room]
    return np.hstack([chosen, back])


def build_shard(dim: int, shard: int, ids: np.ndarray, vectors: np.ndarray, graph: Graph) -> dict:
    """The index row of one shard. Rows equal in id and vector count once."""
    raw = np.ascontiguousarray(vectors).view(f"V{vectors.dtype.itemsize * dim}").ravel()
    _, node = np.unique(raw, return_inverse=True)
    order = np.lexsort((ids, node))
    ids, node, vectors = ids[order], node[order], vectors[order]
    keep = np.ones(len(ids), bool)
    keep[1:] = (ids[1:] != ids[:-1]) | (node[1:] != node[:-1])
    ids, node, vectors = ids[keep], node[keep], vectors[keep]
    firsts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    distinct = vectors[firsts]
    level = _levels(ids[firsts], graph.links)
    level_nodes, level_links = [], []
    for at in range(int(level.max()) + 1):
        nodes = np.flatnonzero(level >= at).astype("i4")
        degree = graph.links * (2 if at == 0 else 1)
        links = _link(distinct[nodes].astype("f4"), degree, graph.candidates)
        level_nodes.append(nodes.tobytes())
        level_links.append(links.tobytes())
    return {
        "dim": dim,
        "shard": shard,
        "ids": ids,
        "firsts": firsts.astype("i4"),
        "vectors": distinct.tobytes(),
        "kind": distinct.dtype.str,
        "level_nodes": level_nodes,
        "level_links": level_links,
    }


def search_shard(index: dict, queries: np.ndarray, graph: Graph) -> np.ndarray:
    """Nodes found for each query, -1 padded: greedy on the upper levels, a beam on the lowest."""
    vectors = np.frombuffer(index["vectors"], index["kind"]).reshape(-1, index["dim"]).astype("f4")
    levels = [
        (np.frombuffer(a, "i4"), np.frombuffer(b, "i4").reshape(len(a) // 4, -1))
        for a, b in zip(index["level_nodes"], index["level_links"])
    ]
    n, q = len(vectors), queries.astype("f4")
    rows = np.arange(len(q))
    top = levels[-1][0]
    at = top[np.argmax(q @ vectors[top].T, axis=1)]
    best = np.einsum("ij,ij->i", q, vectors[at])
    for nodes, links in levels[-1:0:-1]:
        place = np.full(n, -1, "i4")
        place[nodes] = np.arange(len(nodes))
        moving = rows
        while len(moving):
            near = links[place[at[moving]]]
            score = np.einsum("ij,ikj->ik", q[moving], vectors[nodes[near]])
            score[near < 0] = -np.inf
            k = score.argmax(axis=1)
            gain = score[np.arange(len(moving)), k]
            better = gain > best[moving]
            moving, k, near, gain = moving[better], k[better], near[better], gain[better]
            at[moving], best[moving] = nodes[near[np.arange(len(moving)), k]], gain
    links = levels[0][1]
    beam = min(graph.beam, n)
    found = np.full((len(q), beam), -1, "i4")
    score = np.full((len(q), beam), -np.inf, "f4")
    done = np.ones((len(q), beam), bool)
    found[:, 0], score[:, 0], done[:, 0] = at, best, False
    seen = np.zeros((len(q), n), bool)
    seen[rows, at] = True
    active = rows
    while len(active):
        open_ = np.where(done[active], -np.inf, score[active])
        k = open_.argmax(axis=1)
        going = open_[np.arange(len(active)), k] > -np.inf
        active, k = active[going], k[going]
        if not len(active):
            break
        done[active, k] = True
        near = links[found[active, k]]
        fresh = (near >= 0) & ~seen[active[:, None], near]
        new = np.einsum("ij,ikj->ik", q[active], vectors[near])
        new[~fresh] = -np.inf
        r, c = np.nonzero(fresh)
        seen[active[r], near[r, c]] = True
        all_score = np.hstack([score[active], new])
        pick = np.argpartition(-all_score, beam - 1, axis=1)[:, :beam]
        score[active] = np.take_along_axis(all_score, pick, axis=1)
        found[active] = np.take_along_axis(np.hstack([found[active], near]), pick, axis=1)
        done[active] = np.take_along_axis(np.hstack([done[active], ~fresh]), pick, axis=1)
    return np.where(score == -np.inf, -1, found)


def nearest(index: dict, query_ids: np.ndarray, queries: np.ndarray, k: int, graph: Graph) -> list[np.ndarray]:
    """query_id, vec_id, score of the best k of each query in this shard."""
    found = search_shard(index, queries, graph)
    exact = np.frombuffer(index["vectors"], index["kind"]).reshape(-1, index["dim"]).astype("f8")
    ids = np.asarray(index["ids"])
    starts = np.append(np.asarray(index["firsts"]), len(ids))
    out: list[list[np.ndarray]] = [[], [], []]
    for own, vector, nodes in zip(query_ids, queries.astype("f8"), found):
        nodes = nodes[nodes >= 0]
        # one sum after the other, in the order of the components
        scores = np.cumsum(exact[nodes] * vector, axis=1)[:, -1]
        copies = [ids[starts[m] : min(starts[m + 1], starts[m] + k + 1)] for m in nodes]
        score = np.repeat(scores, [len(c) for c in copies])
        ids_found = np.concatenate(copies) if copies else np.zeros(0, "i8")
        other = ids_found != own
        score, ids_found = score[other], ids_found[other]
        first = np.lexsort((ids_found, -score))[:k]
        for column, values in zip(out, (np.full(len(first), own), ids_found[first], score[first])):
            column.append(values)
    return [np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(out, ("i8", "i8", "f8"))]


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def build_index(rows: DataFrame, graph: Graph = Graph(), total: int | None = None) -> DataFrame:
    """One row a shard (INDEX) over all usable rows of vec_id, embedding."""
    rows = rows.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    total = rows.count() if total is None else total
    shards = max(1, math.ceil(total / graph.shard_rows))
    keyed = rows.select(
        F.size("embedding").alias("dim"),
        F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"),
        F.col("vec_id").cast("bigint").alias("vec_id"),
        "embedding",
    )

    def build(key: tuple, group: pa.Table) -> pa.Table:
        dim, shard = (k.as_py() for k in key)
        row = build_shard(dim, shard, group["vec_id"].to_numpy(), _matrix(group["embedding"], dim), graph)
        types = [
            pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.string(),
            pa.list_(pa.binary()), pa.list_(pa.binary()),
        ]
        return pa.table({name: pa.array([v], t) for (name, v), t in zip(row.items(), types)})

    return keyed.groupBy("dim", "shard").applyInArrow(build, INDEX)


def search(index: DataFrame, queries: DataFrame, k: int = 20, graph: Graph = Graph(), total: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each usable query (vec_id, embedding).

    Ties go to the smaller vec_id; a query's own id is no candidate; queries repeated in
    id and vector count once, and meet only vectors of their own dimension.
    """
    queries = queries.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    total = queries.count() if total is None else total
    blocks = max(1, math.ceil(total / graph.block_queries))
    shards = index.select("dim", "shard")
    asked = (
        queries.select(F.size("embedding").alias("dim"), F.col("vec_id").cast("bigint").alias("query_id"), "embedding")
        .withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        .join(shards.groupBy("dim").agg(F.collect_list("shard").alias("shards")), "dim")
        .select("dim", "block", "query_id", "embedding", F.explode("shards").alias("shard"))
    )
    offered = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def find(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        columns = [np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "f8")]
        if left.num_rows and right.num_rows:
            row = {c: left[c][0].as_py() if c not in ("ids", "firsts") else left[c][0].values.to_numpy() for c in left.schema.names}
            ids, vectors = right["query_id"].to_numpy(), _matrix(right["embedding"], dim)
            seen: dict = {}
            for i in range(len(ids)):
                seen.setdefault((ids[i], vectors[i].tobytes()), i)
            own = np.fromiter(seen.values(), "i8")
            columns = nearest(row, ids[own], vectors[own], k, graph)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, columns))))

    found = (
        offered.groupBy("dim", "shard", "block")
        .cogroup(asked.groupBy("dim", "shard", "block"))
        .applyInArrow(find, "query_id bigint, vec_id bigint, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def nearest_neighbours(rows: DataFrame, every: int = 20, k: int = 20, graph: Graph = Graph()) -> DataFrame:
    """Index all rows, then search with those whose vec_id is divisible by `every`."""
    asks = F.col("vec_id") % every == 0
    good = usable(F.col("embedding")) & F.col("vec_id").isNotNull()
    n, q = rows.agg(F.count_if(good), F.count_if(good & asks)).first()
    index = stored(build_index(rows, graph, n), "graphs")
    return search(index, rows.where(asks), k, graph, q)
