"""MAD flags, the data-quality gate, and the fusion of both models."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayglass.contract import FEATURES, Params
from dayglass.operators.quantiles import quantiles


def _total(terms: Iterable[str]) -> str:
    return f"({' + '.join(terms)})"


def missing_share(features: Sequence[str] = FEATURES) -> str:
    """SQL for the share of a row's features that are null."""
    return f"{_total(f'int(isnull({f}))' for f in features)} / {len(features)}D"


MISSING_SHARE = missing_share()


def with_flags(df: DataFrame, params: Params = Params()) -> DataFrame:
    """From z_<feature> columns: flags, counts, ratio and the data-quality gate."""
    threshold = f"{float(params.mad_threshold)!r}D"
    return (
        df.selectExpr(
            "*",
            *[f"coalesce(int(z_{f} > {threshold}), 0) AS {f}_flag" for f in params.features],
            f"int({missing_share(params.features)} > {float(params.missing_data_tolerance)!r}D) AS data_quality_risk",
        )
        .selectExpr(
            "*",
            f"{_total(f'{f}_flag' for f in params.features)} AS mad_score_count",
            f"{_total(f'int(isnotnull({f}))' for f in params.features)} AS observed_feature_count",
        )
        .selectExpr(
            "*",
            "coalesce(try_divide(mad_score_count, observed_feature_count), 0D) AS mad_flag_ratio",
        )
    )


def critical_ratio(flagged: DataFrame, params: Params = Params()) -> DataFrame:
    """One row (active_rows, critical_flag_ratio) from the positive training ratios."""
    active = flagged.selectExpr("IF(mad_flag_ratio > 0, mad_flag_ratio, NULL) AS active")
    q = quantiles(active, "active", (params.mad_flag_percentile / 100.0,))
    fitted = q.select("n", F.get("quantiles", F.lit(0)).alias("q"))
    # an aggregate, so that no active row at all still gives the default
    one = fitted.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.max("q").alias("q"))
    value = F.when(F.col("n") < params.min_active_ratios, params.default_critical_ratio).otherwise(
        F.col("q")
    )
    if params.critical_flag_ratio is not None:
        value = F.lit(float(params.critical_flag_ratio))
    return one.select(F.col("n").alias("active_rows"), value.alias("critical_flag_ratio"))


def critical_flag(ratio: float) -> Column:
    return (F.col("mad_flag_ratio") >= ratio).cast("int")


def iso_flag(threshold: float) -> Column:
    return (F.col("iso_forest_raw_score") < threshold).cast("int")


def with_verdict(df: DataFrame, gap_name: str = "telemetry_gap_flag") -> DataFrame:
    """Fuse both models with the data-quality gate into three exclusive 0/1 columns."""
    both = (F.col("mad_critical_flag") == 1) & (F.col("iso_forest_flag") == 1)
    dirty = F.col("data_quality_risk") == 1
    return df.select(
        "*",
        (both & ~dirty).cast("int").alias("confirmed_threat"),
        (both & dirty).cast("int").alias("high_risk_review"),
        (dirty & ~both).cast("int").alias(gap_name),
    )
