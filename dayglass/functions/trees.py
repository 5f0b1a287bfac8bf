"""Numpy kernels of the isolation forest, run inside Spark tasks on Arrow batches.

Trees use heap numbering: the root is 0, the children of i are 2i+1 and 2i+2.
Definitions: Liu, Ting and Zhou, "Isolation Forest" (ICDM 2008); path-dependent
Shapley values after Lundberg et al. (arXiv:1802.03888), evaluated here through the
multilinear extension (Owen 1972) with Gauss-Legendre points, which is exact.
"""

from __future__ import annotations

import math

import numpy as np

EULER_GAMMA = 0.5772156649


def average_path(n) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    c = 2.0 * (np.log(big - 1.0) + EULER_GAMMA) - 2.0 * (big - 1.0) / big
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


def height_limit(subsample: int) -> int:
    return max(1, math.ceil(math.log2(max(subsample, 2))))


def draw_positions(pool: int, subsample: int, seed: int, tree: int) -> np.ndarray:
    """Rows of the pool a tree is grown on, without replacement."""
    rng = np.random.default_rng([seed, tree, 0])
    return rng.choice(pool, size=min(subsample, pool), replace=False)


def grow(x: np.ndarray, limit: int, seed: int, tree: int) -> list[tuple[int, int, float, int]]:
    """Grow one isolation tree: nodes (node, feature or -1, cut, samples)."""
    rng = np.random.default_rng([seed, tree, 1])
    nodes, todo = [], [(0, 0, x)]
    while todo:
        node, depth, part = todo.pop()
        low, high = part.min(axis=0), part.max(axis=0)
        splittable = np.flatnonzero(high > low)
        if depth >= limit or len(part) <= 1 or len(splittable) == 0:
            nodes.append((node, -1, math.nan, len(part)))
            continue
        f = int(rng.choice(splittable))
        cut = min(rng.uniform(low[f], high[f]), np.nextafter(high[f], low[f]))
        nodes.append((node, f, float(cut), len(part)))
        goes_left = part[:, f] <= cut
        todo.append((2 * node + 2, depth + 1, part[~goes_left]))
        todo.append((2 * node + 1, depth + 1, part[goes_left]))
    return nodes


class Forest:
    """A fitted forest as arrays. Size is bounded by trees * (2 * subsample - 1) nodes."""

    def __init__(self, nodes, n_features: int, subsample: int, features=()):
        """`nodes` holds (tree, node, feature or -1, cut, samples); `features` their names in order."""
        self.features = tuple(features)
        self.nodes = [tuple(n) for n in nodes]
        self.n_features = n_features
        self.subsample = subsample
        self.tree_ids = sorted({n[0] for n in self.nodes})
        self.limit = max((n[1] + 1).bit_length() - 1 for n in self.nodes)
        width = 2 ** (self.limit + 1) - 1
        row = {t: i for i, t in enumerate(self.tree_ids)}
        feature = np.zeros((len(row), width), dtype=np.intp)
        cut = np.full((len(row), width), np.inf)
        length = np.zeros((len(row), width))
        for tree, node, f, c, samples in self.nodes:
            depth = (node + 1).bit_length() - 1
            if f >= 0:
                feature[row[tree], node], cut[row[tree], node] = f, c
            else:  # walk on to the leftmost slot of the last level
                end = node
                for _ in range(self.limit - depth):
                    end = 2 * end + 1
                length[row[tree], end] = depth + float(average_path(samples))
        self._feature, self._cut, self._length = feature.ravel(), cut.ravel(), length.ravel()
        self._start = np.arange(len(row), dtype=np.intp) * width

    def path_length(self, x: np.ndarray) -> np.ndarray:
        """Mean path length per row."""
        out = np.empty(len(x))
        for at in range(0, len(x), 1024):
            part = np.ascontiguousarray(x[at : at + 1024], dtype=float)
            flat = part.ravel()
            row = (np.arange(len(part)) * self.n_features)[:, None]
            node = np.zeros((len(part), len(self._start)), dtype=np.intp)
            for _ in range(self.limit):
                slot = self._start + node
                right = flat.take(row + self._feature.take(slot)) > self._cut.take(slot)
                node = 2 * node + 1 + right
            out[at : at + 1024] = self._length.take(self._start + node).mean(axis=1)
        return out

    def raw_score(self, x: np.ndarray) -> np.ndarray:
        """-2^(-E[h] / c(subsample)); lower is more anomalous."""
        return -np.power(2.0, -self.path_length(x) / float(average_path(self.subsample)))

    def _paths(self):
        """Per tree: leaf value and, per path feature, its interval and cover share."""
        by_tree = {t: {} for t in self.tree_ids}
        for tree, node, f, c, samples in self.nodes:
            by_tree[tree][node] = (f, c, samples)
        for tree in self.tree_ids:
            nodes = by_tree[tree]
            leaves = []
            for node, (f, _, samples) in nodes.items():
                if f >= 0:
                    continue
                depth = (node + 1).bit_length() - 1
                path: dict[int, list[float]] = {}
                child = node
                while child > 0:
                    parent = (child - 1) // 2
                    pf, pc, ps = nodes[parent]
                    low, high, share = path.get(pf, (-np.inf, np.inf, 1.0))
                    if child % 2:
                        high = min(high, pc)
                    else:
                        low = max(low, pc)
                    path[pf] = [low, high, share * nodes[child][2] / ps]
                    child = parent
                leaves.append((depth + float(average_path(samples)), path))
            slots = max(1, max(len(p) for _, p in leaves))
            value = np.array([v for v, _ in leaves])
            feature = np.zeros((len(leaves), slots), dtype=np.intp)
            low = np.full((len(leaves), slots), -np.inf)
            high = np.full((len(leaves), slots), np.inf)
            share = np.ones((len(leaves), slots))  # an unused slot has no effect
            for i, (_, path) in enumerate(leaves):
                for k, (f, (lo, hi, s)) in enumerate(path.items()):
                    feature[i, k], low[i, k], high[i, k], share[i, k] = f, lo, hi, s
            yield value, feature, low, high, share

    def base_value(self) -> float:
        """Expected mean path length under the training covers."""
        return float(np.mean([(v * s.prod(axis=1)).sum() for v, _, _, _, s in self._paths()]))

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Shapley values of the mean path length of finite rows: one column per feature.

        What a leaf adds depends only on which of its path intervals hold the row, so it is
        computed once for each such pattern that occurs and looked up for every row.
        """
        x = np.asarray(x, dtype=float)
        phi = np.zeros((len(x), self.n_features))
        for tree in self._paths():
            _, feature, low, high, _ = tree
            leaves, slots = feature.shape
            bit = 1 << np.arange(slots)
            first = np.arange(leaves) << slots  # of each leaf's patterns
            used = np.unique(feature)
            steps = []
            for f in used:
                mine = feature == f
                ends = np.unique(np.concatenate([low[mine], high[mine]]))
                ends = ends[np.isfinite(ends)]
                upper = np.append(ends, np.inf)[:, None, None]  # stands for the values of a step
                holds = mine & (low < upper) & (upper <= high)
                steps.append((f, ends, (holds * bit).sum(axis=2)))
            seen = np.zeros(leaves << slots, dtype=bool)
            codes = []
            for at in range(0, len(x), 256):
                part = x[at : at + 256]
                code = np.repeat(first[None], len(part), axis=0)
                for f, ends, held in steps:
                    code += held.take(np.searchsorted(ends, part[:, f]), axis=0)
                seen[code.ravel()] = True
                codes.append(code.astype("i4"))
            patterns = np.flatnonzero(seen)
            place = np.zeros(len(seen), dtype=np.intp)
            place[patterns] = np.arange(len(patterns))
            worth = self._worth(patterns, tree, used)
            for k, code in enumerate(codes):
                phi[256 * k : 256 * k + len(code), used] += worth.take(place.take(code), axis=0).sum(axis=1)
        return phi / len(self.tree_ids)

    @staticmethod
    def _worth(patterns: np.ndarray, tree: tuple, used: np.ndarray) -> np.ndarray:
        """What the leaf of each pattern (leaf, then a bit for each path interval) adds to the used features."""
        value, feature, _, _, share = tree
        slots = share.shape[1]
        points, weights = np.polynomial.legendre.leggauss((slots + 1) // 2)
        points, weights = (points + 1) / 2, weights / 2
        out = np.zeros((len(patterns), len(used)))
        for at in range(0, len(patterns), 4096):
            some = patterns[at : at + 4096]
            leaf = some >> slots
            inside = (some[:, None] >> np.arange(slots) & 1).astype(bool)
            covered = share[leaf]
            others = np.zeros(inside.shape)
            for t, w in zip(points, weights):
                absent = covered * (1 - t)
                factor = np.where(inside, absent + t, absent)
                others += (w * factor.prod(axis=1))[:, None] / factor
            part = np.where(inside, 1 - covered, -covered) * others * value[leaf][:, None]
            column = np.searchsorted(used, feature[leaf])
            np.add.at(out[at : at + 4096], (np.arange(len(some))[:, None], column), part)
        return out
