"""Forest kernels and jobs: brute force, additivity, independence of partitioning."""

import itertools
import math

import numpy as np
import pytest

from dayglass.contract import FEATURES, KEY, Params
from dayglass.functions import trees
from dayglass.functions.trees import Forest, average_path
from dayglass.operators import forest as IF

RNG = np.random.default_rng(0)
X = RNG.normal(size=(300, 4))


@pytest.fixture(scope="module")
def grown():
    nodes = [
        (t, *n)
        for t in range(5)
        for n in trees.grow(X[trees.draw_positions(300, 64, 42, t)], 6, 42, t)
    ]
    return nodes, Forest(nodes, 4, 64)


def walk(nodes, x, known):
    """Expected path length when only the features in `known` are observed."""

    def visit(tree, i, depth):
        _, _, f, cut, n = tree[i]
        if f < 0:
            return depth + float(average_path(n))
        left, right = 2 * i + 1, 2 * i + 2
        if f in known:
            return visit(tree, right if x[f] > cut else left, depth + 1)
        return sum(tree[c][4] * visit(tree, c, depth + 1) for c in (left, right)) / n

    by_tree = [{m[1]: m for m in nodes if m[0] == t} for t in sorted({m[0] for m in nodes})]
    return np.mean([visit(tree, 0, 0) for tree in by_tree])


def test_average_path():
    assert average_path([0, 1, 2]).tolist() == [0.0, 0.0, 1.0]
    assert float(average_path(256)) == pytest.approx(2 * (math.log(255) + 0.5772156649) - 2 * 255 / 256)


def test_path_length_matches_a_walk(grown):
    nodes, forest = grown
    want = [walk(nodes, x, {0, 1, 2, 3}) for x in X[:40]]
    np.testing.assert_allclose(forest.path_length(X[:40]), want, rtol=1e-12)


def test_contributions_match_brute_force(grown):
    nodes, forest = grown
    for x in X[:4]:
        phi = np.zeros(4)
        for i in range(4):
            rest = [j for j in range(4) if j != i]
            for k in range(4):
                weight = math.factorial(k) * math.factorial(3 - k) / math.factorial(4)
                for s in itertools.combinations(rest, k):
                    phi[i] += weight * (walk(nodes, x, {*s, i}) - walk(nodes, x, set(s)))
        np.testing.assert_allclose(forest.contributions(x[None])[0], phi, atol=1e-12)


def test_contributions_of_a_pattern_are_computed_once(grown, monkeypatch):
    _, forest = grown
    computed = []
    worth = Forest._worth
    monkeypatch.setattr(Forest, "_worth", staticmethod(lambda patterns, *rest: computed.append(len(patterns)) or worth(patterns, *rest)))
    one = forest.contributions(X[:40])
    once = sum(computed)
    many = forest.contributions(np.tile(X[:40], (20, 1)))
    assert sum(computed) == 2 * once
    np.testing.assert_allclose(many, np.tile(one, (20, 1)), rtol=0, atol=1e-12)


def test_contributions_add_up(grown):
    _, forest = grown
    total = forest.base_value() + forest.contributions(X).sum(axis=1)
    np.testing.assert_allclose(total, forest.path_length(X), rtol=1e-12)


def test_outliers_score_lower(grown):
    _, forest = grown
    assert forest.raw_score(np.full((1, 4), 9.0))[0] < np.quantile(forest.raw_score(X), 0.05)


def training(spark, n):
    rows = [(f"u{i}", "2024-01-01", *map(float, r)) for i, r in enumerate(np.random.default_rng(1).normal(size=(n, 15)))]
    schema = f"user string, activity_date string, {', '.join(f'x_{f} double' for f in FEATURES)}"
    return spark.createDataFrame(rows, schema)


def test_fit_does_not_depend_on_partitioning(spark):
    params = Params(trees=6, subsample=32)
    tables = [
        sorted(map(tuple, IF.fit_forest(training(spark, 500).repartition(p), 500, params).fillna(0.0).collect()), key=repr)
        for p in (1, 8)
    ]
    assert tables[0] == tables[1]
    roots = [r for r in tables[0] if r[1] == 0]
    assert len(roots) == 6 and all(r[4] == 32 for r in roots)


def test_spark_score_equals_kernel(spark):
    df = training(spark, 200)
    table = IF.fit_forest(df, 200, Params(trees=4, subsample=64)).cache()
    forest = IF.load_forest(table, 64)
    rows = df.select("*", IF.raw_score(df, forest).alias("s"), IF.contributions(df, forest).alias("phi")).collect()
    x = np.array([[r[f"x_{f}"] for f in FEATURES] for r in rows])
    np.testing.assert_allclose([r["s"] for r in rows], forest.raw_score(x), rtol=1e-12)
    np.testing.assert_allclose([r["phi"] for r in rows], forest.contributions(x), atol=1e-12)


def test_sample_is_the_smallest_hashes(spark):
    from pyspark.sql import functions as F

    df = training(spark, 3000).select(*KEY)
    got = {r["user"] for r in IF.sample_rows(df, 100, 7, 3000).collect()}
    ranked = df.select("user", F.xxhash64(*KEY, F.lit(7)).alias("h")).orderBy("h").limit(100)
    assert got == {r["user"] for r in ranked.collect()}
