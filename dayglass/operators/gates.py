"""Input gates: emptiness, keys, duplicates, feature drift."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from dayglass.contract import FEATURES, KEY
from dayglass.operators.fusion import require_key

log = logging.getLogger(__name__)


def require_rows(df: DataFrame, name: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{name} is empty; check the filters before it")
    return df


def duplicate_keys(df: DataFrame) -> DataFrame:
    """User-days that occur more than once: rows (user, activity_date, n)."""
    return df.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1")


def numeric_columns(df: DataFrame) -> list[str]:
    found = [
        f.name
        for f in df.schema
        if isinstance(f.dataType, T.NumericType) and f.name not in KEY
    ]
    if not found:
        raise ValueError("no numeric feature column found")
    return found


def validate(df: DataFrame, name: str = "input") -> DataFrame:
    """Refuse an empty table, a missing key, no features, or a repeated user-day."""
    require_key(df, name)
    numeric_columns(df)
    require_rows(df, name)
    twice = duplicate_keys(df).take(1)
    if twice:
        raise ValueError(f"{name} has repeated user-days, such as {twice[0].asDict()}")
    return df


def require_unique(df: DataFrame) -> DataFrame:
    """`df`, whose evaluation aborts at a repeated user-day: a window, no further scan."""
    n = F.count("*").over(W.partitionBy(*KEY))
    text = F.concat(F.lit("repeated user-day: "), F.concat_ws(" ", *[F.col(k).cast("string") for k in KEY]))
    once = F.when(F.col("_n") == 1, True).otherwise(F.raise_error(text).cast("boolean"))
    return df.withColumn("_n", n).where(once).drop("_n")


def feature_drift(
    df: DataFrame, trained: Sequence[str] = FEATURES, mode: str = "warn"
) -> dict[str, list[str]]:
    """Trained features that are missing and new ones; mode "raise" refuses missing ones."""
    have = set(numeric_columns(df))
    missing = [f for f in trained if f not in have]
    extra = sorted(have - set(trained))
    if missing and mode == "raise":
        raise ValueError(f"trained features are missing: {missing}")
    if missing:
        log.warning("trained features are missing and count as unobserved: %s", missing)
    if extra:
        log.warning("features unknown to the model are ignored: %s", extra)
    return {"missing": missing, "extra": extra}
