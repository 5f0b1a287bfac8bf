"""Has the scored population moved away from the training one, and is a refit due?

A sketch of a column is its counts by bin, the bins cut at the training deciles. Sketches
of days add up to those of longer spans, so history is sketched once and each day once; all
later comparisons read a few counts. Every sketch takes one pass with partial counts.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dayglass.contract import FEATURES
from dayglass.operators.quantiles import quantiles

DECILES = tuple(i / 10 for i in range(1, 10))
#: Bin of unobserved values, beside those of the cuts.
UNOBSERVED = -1
#: A share that an empty bin counts as, so that the index stays finite.
LEAST_SHARE = 1e-4
WATCH, RETRAIN = 0.1, 0.25

Cuts = Mapping[str, Sequence[float]]


def training_cuts(training: DataFrame, measures: Sequence[str] = FEATURES) -> dict[str, list[float]]:
    """The distinct deciles of each measure: at most nine numbers a measure; none if it has no value."""
    long = training.select(*measures).unpivot([], list(measures), "measure", "value")
    found = {r["measure"]: r["quantiles"] for r in quantiles(long, "value", DECILES, ["measure"]).collect()}
    return {m: sorted({c for c in found.get(m, []) if math.isfinite(c)}) for m in measures}


def sketch(df: DataFrame, cuts: Cuts, by: Sequence[str] = ("activity_date",)) -> DataFrame:
    """Rows (by..., measure, bin, n): values in each bin, which is the number of cuts below the value."""

    def bin_of(m: str) -> str:
        value = f"nullif(double({m}), double('NaN'))"
        below = " + ".join(f"int({value} > {float(c)!r}D)" for c in cuts[m]) or f"IF({value} IS NULL, NULL, 0)"
        return f"coalesce({below}, {UNOBSERVED}) AS {m}"

    binned = df.selectExpr(*by, *[bin_of(m) for m in cuts])
    long = binned.unpivot(list(by), list(cuts), "measure", "bin")
    return long.groupBy(*by, "measure", "bin").agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches added up over everything but `by`."""
    return sketches.groupBy(*by, "measure", "bin").agg(F.sum("n").alias("n"))


def write_sketch(sketches: DataFrame, path: str) -> None:
    """Sketches by day; writing a day again replaces it."""
    sketches.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("activity_date").parquet(path)


def stability(reference: DataFrame, live: DataFrame) -> DataFrame:
    """Rows (measure, n_reference, n_live, psi, distance) from two merged sketches.

    psi is the population stability index over the bins, unobserved values being one of
    them; distance is the greatest difference of the cumulated shares of observed values
    (two-sample Kolmogorov-Smirnov on the bins). A side without rows has null in both.
    """
    bins = reference.select("measure", "bin", F.col("n").alias("r"), F.lit(0).cast("bigint").alias("l")).unionByName(
        live.select("measure", "bin", F.lit(0).cast("bigint").alias("r"), F.col("n").alias("l"))
    )
    bins = bins.groupBy("measure", "bin").agg(F.sum("r").alias("r"), F.sum("l").alias("l"))
    all_ = W.partitionBy("measure")  # a dozen bins a measure
    so_far = all_.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = lambda c: F.when(F.col("bin") != UNOBSERVED, F.col(c))
    shares = bins.select(
        "measure",
        F.sum("r").over(all_).alias("n_reference"),
        F.sum("l").over(all_).alias("n_live"),
        *[F.greatest(F.try_divide(F.col(c), F.sum(c).over(all_)), F.lit(LEAST_SHARE)).alias(f"share_{c}") for c in "rl"],
        *[F.try_divide(F.sum(seen(c)).over(so_far), F.sum(seen(c)).over(all_)).alias(f"below_{c}") for c in "rl"],
    )
    sides = (F.col("n_reference") > 0) & (F.col("n_live") > 0)
    term = (F.col("share_l") - F.col("share_r")) * F.log(F.col("share_l") / F.col("share_r"))
    return shares.groupBy("measure", "n_reference", "n_live").agg(
        F.sum(F.when(sides, term)).alias("psi"), F.max(F.when(sides, F.abs(F.col("below_l") - F.col("below_r")))).alias("distance")
    )


def decisions(stable: DataFrame, least_rows: int = 100, watch: float = WATCH, retrain: float = RETRAIN) -> DataFrame:
    """The stability table with `verdict`: too_few, stable, watch or retrain."""
    few = (F.col("n_live") < least_rows) | F.col("psi").isNull()
    verdict = F.when(few, "too_few").when(F.col("psi") >= retrain, "retrain").when(F.col("psi") >= watch, "watch").otherwise("stable")
    return stable.withColumn("verdict", verdict)


def retrain_due(decided: DataFrame, least_measures: int = 1) -> bool:
    """Whether so many measures have moved; one row reaches the driver."""
    return decided.agg(F.count_if(F.col("verdict") == "retrain")).first()[0] >= least_measures
