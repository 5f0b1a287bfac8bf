"""Baselines by role, between a user's own and the whole population's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayglass.contract import FEATURES, KEY, Params
from dayglass.operators.baseline import GLOBAL, PERSONAL, mad_divisor
from dayglass.operators.quantiles import quantiles

ROLE = "role"


def role_baseline(history: DataFrame, roles: DataFrame, params: Params = Params()) -> DataFrame:
    """Rows (role, feature, median, mad, p95) from a history matrix and rows (user, role).

    Exact quantiles by role and feature; a role of any size is spread like the population.
    Equal values of a role are counted first: the cells themselves meet neither the medians
    nor a shuffle by role and feature, which has few groups however many rows there are.
    """
    by = [ROLE, "feature"]
    counted = (
        history.join(roles.where("role is not null"), "user")
        .select(ROLE, *FEATURES)
        .unpivot([ROLE], list(FEATURES), "feature", "value")
        .where("value IS NOT NULL")
        .groupBy(*by, "value")
        .agg(F.count("*").alias("cells"))
    )
    location = quantiles(counted, "value", (0.5, 0.95), by, "cells").select(
        *by, F.get("quantiles", F.lit(0)).alias("median"), F.get("quantiles", F.lit(1)).alias("p95")
    )
    # one row per role and feature
    off = counted.join(F.broadcast(location), by).select(*by, F.abs(F.col("value") - F.col("median")).alias("off"), "cells")
    spread = quantiles(off, "off", (0.5,), by, "cells").select(
        *by, (F.get("quantiles", F.lit(0)) / mad_divisor(params)).alias("mad")
    )
    return location.join(F.broadcast(spread), by).select(*by, "median", "mad", "p95")


def baseline_route(live: DataFrame, personal: DataFrame, roles: DataFrame, stats: DataFrame) -> DataFrame:
    """Key, role and baseline_source of every live row: the user's own baseline, else the
    role's where it has one, else the population's."""
    known = personal.select("user", F.lit(True).alias("own"))
    served = stats.select(ROLE).distinct().withColumn("served", F.lit(True))
    source = F.when(F.col("own"), PERSONAL).when(F.col("served"), ROLE).otherwise(GLOBAL)
    return (
        live.select(*KEY)
        .join(roles, "user", "left")
        .join(known, "user", "left")
        .join(served, ROLE, "left")
        .select(*KEY, ROLE, source.alias("baseline_source"))
    )
