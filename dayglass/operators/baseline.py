"""Personal and population baselines, routing between them, and self-scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayglass.contract import FEATURES, KEY, Params
from dayglass.functions.robust import (
    NORMAL_QUARTILE,
    absolute_deviations,
    self_score,
    sorted_quantile,
)
from dayglass.operators.quantiles import quantiles

PERSONAL, GLOBAL = "personal", "global_cold_start"
NO_STATS = {"median": 0.0, "mad": 1.0, "p95": 0.0}  # a feature without any baseline

GlobalStats = Mapping[str, Mapping[str, float]]


def mad_divisor(params: Params) -> float:
    return NORMAL_QUARTILE if params.mad_scale == "normal" else 1.0


def user_baseline(history: DataFrame, params: Params = Params()) -> DataFrame:
    """Rows (user, history_days, stats struct<feature: struct<median, mad, p95>>).

    One row per user with enough days. A user's arrays hold one entry per day, so the
    calendar bounds them; one shuffle by user serves both the quantiles and the MAD.
    """
    gathered = history.groupBy("user").agg(F.count("*").alias("history_days"), *[F.collect_list(f).alias(f) for f in params.features])
    return _statistics(gathered.where(F.col("history_days") >= params.min_history_days), params)


def _statistics(gathered: DataFrame, params: Params) -> DataFrame:
    """Rows of user_baseline from (user, history_days, array of values of each feature)."""
    sorted_values = gathered.selectExpr(
        "user", "history_days", *[f"array_sort({f}) AS {f}" for f in params.features]
    )
    centred = sorted_values.selectExpr(
        "*", *[f"coalesce({sorted_quantile(f, 0.5)}, 0D) AS {f}_m" for f in params.features]
    ).selectExpr("*", *[f"{absolute_deviations(f, f'{f}_m')} AS {f}_d" for f in params.features])

    def stats(f: str) -> str:
        spread = f"{sorted_quantile(f'{f}_d', 0.5)} / {mad_divisor(params)!r}D"
        p95 = sorted_quantile(f, 0.95)
        return f"struct({f}_m AS median, coalesce({spread}, 0D) AS mad, coalesce({p95}, 0D) AS p95) AS {f}"

    return centred.selectExpr(
        "user", "history_days", f"struct({', '.join(map(stats, params.features))}) AS stats"
    )


#: The state's row that counts a user's days stands beside those of the features.
DAYS = "_days"


def baseline_state(history: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """What the personal baselines need of some days: rows (user, feature, value, n).

    n counts equal values; the feature `_days` counts the user's rows. States of different
    days add up, so a new day updates them without reading history again.
    """
    days = history.select("user", F.lit(DAYS).alias("feature"), F.lit(0.0).alias("value"))
    values = history.select("user", *features).unpivot("user", list(features), "feature", "value").where("value IS NOT NULL")
    return days.unionByName(values).groupBy("user", "feature", "value").agg(F.count("*").alias("n"))


def merge_states(state: DataFrame, other: DataFrame) -> DataFrame:
    """The state of both spans; they must not share a day."""
    return state.unionByName(other).groupBy("user", "feature", "value").agg(F.sum("n").alias("n"))


def baseline_from_state(state: DataFrame, params: Params = Params()) -> DataFrame:
    """The same rows as user_baseline of the days in the state; one shuffle by user."""
    days = F.sum(F.when(F.col("feature") == DAYS, F.col("n")))
    repeated = "flatten(collect_list(IF(feature = '{0}', array_repeat(value, int(n)), NULL)))"
    gathered = state.groupBy("user").agg(days.alias("history_days"), *[F.expr(repeated.format(f)).alias(f) for f in params.features])
    return _statistics(gathered.where(F.col("history_days") >= params.min_history_days), params)


def cells(df: DataFrame, prefix: str = "", features: Sequence[str] = FEATURES) -> DataFrame:
    """Long form of the feature columns: rows (feature, value)."""
    return df.select(*[F.col(f"{prefix}{f}").alias(f) for f in features]).unpivot(
        [], list(features), "feature", "value"
    )


def global_baseline(history: DataFrame, params: Params = Params()) -> DataFrame:
    """Population statistics: rows (feature, median, mad, p95)."""
    return global_from_cells(cells(history, features=params.features), params)


def global_from_cells(values: DataFrame, params: Params = Params()) -> DataFrame:
    """Population statistics of (feature, value) cells, nulls skipped."""
    location = quantiles(values, "value", (0.5, 0.95), ["feature"]).select(
        "feature", F.get("quantiles", F.lit(0)).alias("median"), F.get("quantiles", F.lit(1)).alias("p95")
    )
    # one row per feature
    off = values.join(F.broadcast(location), "feature").select(
        "feature", F.abs(F.col("value") - F.col("median")).alias("off")
    )
    spread = quantiles(off, "off", (0.5,), ["feature"]).select(
        "feature", (F.get("quantiles", F.lit(0)) / mad_divisor(params)).alias("mad")
    )
    return location.join(F.broadcast(spread), "feature").select("feature", "median", "mad", "p95")


def fetch_global(table: DataFrame) -> dict[str, dict[str, float]]:
    """The population baseline as constants (one row per feature)."""
    return {
        r["feature"]: {"median": r["median"], "mad": r["mad"], "p95": r["p95"]}
        for r in table.collect()
    }


def routed(
    live: DataFrame, baseline: DataFrame, population: GlobalStats, params: Params = Params()
) -> DataFrame:
    """`live` with history_days, baseline_source and the stats that apply to each row.

    The stats are flat columns <feature>_median, _mad and _p95. Users without a personal baseline get the population's. route_on "live" also sends
    users there who have fewer than `min_history_days` rows in the batch itself.
    """
    known = "stats IS NOT NULL"
    if "baseline_source" in live.columns:  # already routed: keep that choice
        known = f"{known} AND routed_before = '{PERSONAL}'"
        live = live.withColumnRenamed("baseline_source", "routed_before")
    elif params.route_on == "live":
        live = live.selectExpr("*", "count(*) OVER (PARTITION BY user) AS batch_days")
        known = f"{known} AND batch_days >= {params.min_history_days}"
    joined = live.join(baseline.select("user", "history_days", "stats"), "user", "left")

    def stat(f: str, k: str) -> str:
        constant = float(population.get(f, NO_STATS)[k])
        return f"IF({known}, stats.{f}.{k}, {constant!r}D) AS {f}_{k}"

    return joined.selectExpr(
        *[c for c in live.columns if c not in ("batch_days", "routed_before")],
        "coalesce(history_days, 0L) AS history_days",
        f"IF({known}, '{PERSONAL}', '{GLOBAL}') AS baseline_source",
        *[stat(f, k) for f in params.features for k in NO_STATS],
    )


def with_self_scores(df: DataFrame, params: Params = Params()) -> DataFrame:
    """Add z_<feature> for every feature of a routed table."""
    return df.selectExpr(
        "*", *[f"{self_score(f, params.mad_threshold)} AS z_{f}" for f in params.features]
    )


def self_scores(
    live: DataFrame, baseline: DataFrame, population: GlobalStats, params: Params = Params()
) -> DataFrame:
    """Key and the z columns named by feature; null = unobserved."""
    scored = with_self_scores(routed(live, baseline, population, params), params)
    return scored.select(*KEY, *[F.col(f"z_{f}").alias(f) for f in params.features])


def unknown_users(live: DataFrame, baseline: DataFrame) -> DataFrame:
    """Live users without a personal baseline (cold start)."""
    return live.select("user").distinct().join(baseline.select("user"), "user", "left_anti")


def first_unknown_users(live: DataFrame, baseline: DataFrame, n: int = 10) -> DataFrame:
    return unknown_users(live, baseline).orderBy("user").limit(n)


def known_users(live: DataFrame, baseline: DataFrame) -> DataFrame:
    return live.select("user").distinct().join(baseline.select("user"), "user", "left_semi")


def fill_value(scores: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Median over all z cells: one row (fill_value). Stands in for unobserved cells."""
    return quantiles(cells(scores, features=features), "value", (0.5,)).select(
        F.get("quantiles", F.lit(0)).alias("fill_value")
    )


def scaling(scores: DataFrame, fill: float, features: Sequence[str] = FEATURES) -> DataFrame:
    """Robust scaling of the filled z matrix: rows (feature, center, q25, q75, scale)."""
    filled = cells(scores, features=features).withColumn("value", F.coalesce("value", F.lit(float(fill))))
    q = lambda i: F.get("quantiles", F.lit(i))
    return quantiles(filled, "value", (0.25, 0.5, 0.75), ["feature"]).select(
        "feature",
        q(1).alias("center"),
        q(0).alias("q25"),
        q(2).alias("q75"),
        F.when(q(2) == q(0), 1.0).otherwise(q(2) - q(0)).alias("scale"),
    )
