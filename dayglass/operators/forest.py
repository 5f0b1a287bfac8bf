"""Isolation forest as Spark jobs: sample, grow per tree, score by Arrow batches."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dayglass.contract import FEATURES, KEY, Params
from dayglass.functions import trees
from dayglass.functions.trees import Forest
from dayglass.operators.quantiles import even_grid, quantiles

cloudpickle.register_pickle_by_value(trees)  # the kernels travel with the task

FOREST_SCHEMA = "tree int, node int, feature string, cut double, samples long"
SCORE_POINTS = 1000  # fixed value: points of the stored training score table
AUTO_OFFSET = -0.5

Scaling = Mapping[str, tuple[float, float]]


def model_input(df: DataFrame, fill: float, scaling: Scaling | None, prefix: str = "z_", features: Sequence[str] = FEATURES) -> DataFrame:
    """Replace the z columns by filled and robustly scaled x_<feature> columns."""

    def scaled(f: str) -> str:
        z = f"coalesce({prefix}{f}, {float(fill)!r}D)"
        center, scale = scaling[f] if scaling else (0.0, 1.0)
        return f"({z} - {float(center)!r}D) / {float(scale)!r}D AS x_{f}"

    return df.selectExpr("*", *map(scaled, features))


def sample_rows(df: DataFrame, n: int, seed: int, total: int, order: tuple[str, ...] = KEY) -> DataFrame:
    """The n rows with the smallest seeded key hash: independent of partitioning.

    The hash is uniform, so a cut slightly above n/total leaves few candidates; only
    those are ordered. The cut widens until it holds n rows.
    """
    digest = F.xxhash64(*[F.col(c) for c in order], F.lit(seed))
    marked = df.withColumn("_digest", digest)
    share = (n + 8 * math.sqrt(n) + 64) / max(total, 1)
    while True:
        near = marked.where(F.col("_digest") <= min(2**63 - 1, int(-(2**63) + share * 2**64)))
        if share >= 1 or near.count() >= n:
            return near.orderBy("_digest", *order).limit(n).drop("_digest")
        share *= 2


def spread(spark: SparkSession, most: int | None = None) -> int:
    """Tasks for costly rows: a stated number is not coalesced to fewer."""
    tasks = 2 * spark.sparkContext.defaultParallelism
    return tasks if most is None else max(1, min(tasks, most))


def fit_forest(
    training: DataFrame, total: int, params: Params = Params(), prefix: str = "x_"
) -> DataFrame:
    """Grow the forest on x_<feature> columns: rows (tree, node, feature, cut, samples).

    A pool of at most trees * subsample rows is numbered; every tree draws its rows
    from it, and each tree grows in its own group of `subsample` rows.
    """
    spark = training.sparkSession
    n_trees, seed = params.trees, params.seed
    subsample = min(params.subsample, total)
    limit = trees.height_limit(subsample)
    pool_size = min(total, n_trees * subsample)
    features = params.features
    columns = [f"{prefix}{f}" for f in features]
    pool = sample_rows(training.select(*KEY, *columns), pool_size, seed, total)
    numbered = pool.select(
        # the pool is bounded by the parameters
        (F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.xxhash64(*KEY, F.lit(seed)), *KEY)) - 1).alias("pos"),
        *columns,
    )

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tree in batch["id"]:
                pos = trees.draw_positions(pool_size, subsample, seed, int(tree))
                yield pd.DataFrame({"tree": int(tree), "pos": pos.astype("int64")})

    def plant(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        x = rows.sort_values("pos")[columns].to_numpy(dtype=float)
        nodes = trees.grow(x, limit, seed, tree)
        names = [features[f] if f >= 0 else None for _, f, _, _ in nodes]
        return pd.DataFrame(
            {
                "tree": tree,
                "node": [n[0] for n in nodes],
                "feature": names,
                "cut": [None if n[1] < 0 else n[2] for n in nodes],
                "samples": [n[3] for n in nodes],
            }
        )

    picks = spark.range(n_trees).mapInPandas(draw, "tree int, pos long")
    drawn = picks.join(numbered, "pos").repartition(spread(spark, n_trees), "tree")
    return drawn.groupBy("tree").applyInPandas(plant, FOREST_SCHEMA)


def load_forest(table: DataFrame, subsample: int, features: Sequence[str] = FEATURES) -> Forest:
    """The forest as arrays; its rows are bounded by trees * (2 * subsample - 1)."""
    index = {f: i for i, f in enumerate(features)}
    rows = table.select("tree", "node", "feature", "cut", "samples").collect()
    nodes = [
        (r["tree"], r["node"], index[r["feature"]] if r["feature"] else -1, r["cut"] or 0.0, r["samples"])
        for r in sorted(rows, key=lambda r: (r["tree"], r["node"]))
    ]
    return Forest(nodes, len(features), subsample, features)


def _ship(df: DataFrame, forest: Forest):
    """Broadcast the forest, its code included: workers need no installed package."""
    return df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(forest))


def raw_score(df: DataFrame, forest: Forest, prefix: str = "x_") -> Column:
    """Forest score of x_<feature> columns; vectorised per Arrow batch.

    Declared non-deterministic to keep it a boundary: filters on the verdict stay above
    it instead of being rewritten in terms of the raw features. Filter keys before scoring.
    """
    shipped = _ship(df, forest)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        local = pickle.loads(shipped.value)
        for columns in batches:
            yield pd.Series(local.raw_score(np.column_stack(columns)))

    return score.asNondeterministic()(*[F.col(f"{prefix}{f}") for f in forest.features])


def score_table(scores: DataFrame, column: str = "raw") -> DataFrame:
    """The stored training score table: one row (n, quantiles array<double>)."""
    return quantiles(scores, column, even_grid(SCORE_POINTS))


def calibrated_percentile(score: Column, points: list[float]) -> Column:
    """Share of the stored training scores not above `score`; null for null."""
    ordered = np.sort(np.asarray(points, dtype=float))

    @F.pandas_udf("double")
    def share(values: pd.Series) -> pd.Series:
        return (np.searchsorted(ordered, values, side="right") / len(ordered)) + 0 * values

    return share(score)


def importance(attributed: DataFrame, column: str = "phi", features: Sequence[str] = FEATURES) -> DataFrame:
    """Mean absolute attribution per feature with rank (ties take the smallest)."""
    spread = attributed.select(
        F.posexplode(column).alias("i", "phi")
    ).groupBy("i").agg(F.avg(F.abs("phi")).alias("mean_abs_shap"))
    named = spread.select(
        F.element_at(F.array(*map(F.lit, features)), F.col("i") + 1).alias("feature"), "mean_abs_shap"
    )
    return ranked(named)


def ranked(named: DataFrame) -> DataFrame:
    """Rank (feature, mean_abs_shap), one row per feature."""
    order = W.partitionBy(F.lit(0)).orderBy(F.desc("mean_abs_shap"))
    return named.select("feature", "mean_abs_shap", F.rank().over(order).alias("rank")).orderBy(
        "rank", "feature"
    )


def contributions(df: DataFrame, forest: Forest, prefix: str = "x_") -> Column:
    """Shapley values of the mean path length, in feature order; null if a row fails.

    Use it on filtered rows: no filter is pushed through it.
    """
    shipped = _ship(df, forest)

    @F.pandas_udf("array<double>")
    def explain(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        local = pickle.loads(shipped.value)
        for columns in batches:
            x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            usable = np.isfinite(x).all(axis=1)
            phi = np.zeros(x.shape)
            phi[usable] = local.contributions(x[usable])
            yield pd.Series([list(p) if ok else None for p, ok in zip(phi, usable)])

    return explain.asNondeterministic()(*[F.col(f"{prefix}{f}") for f in forest.features])
