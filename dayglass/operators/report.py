"""Queries over the alert report: typing, filters, counts, timeline, panels."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayglass.contract import ALERT_COLUMNS, FEATURES, KEY

# Labels and limits of the report.
BADGES = {
    "confirmed_threat": "🔴 CONFIRMED",
    "high_risk_review": "🟠 REVIEW",
    "telemetry_gap_flag": "🟡 DATA GAP",
}
CLEAN = "⚪ CLEAN"
TIMELINE = {
    "confirmed_threat": "Confirmed Threat",
    "high_risk_review": "High Risk Review",
    "telemetry_gap_flag": "Telemetry Gap",
}
HIGH_Z, RAISED_Z = 3.5, 2.0


def typed_report(report: DataFrame, as_of: dt.date) -> DataFrame:
    """Typed report with category booleans.

    A missing score is 0, an unreadable date is `as_of`, and "review" counts as a gap.
    """
    if "threat_category" not in report.columns:
        present = [c for c in ALERT_COLUMNS if c in report.columns]
        flags = {c: F.col(c).cast("boolean") for c in present}
    else:
        category = F.trim("threat_category")
        flags = {
            "confirmed_threat": category == "confirmed_threat",
            "high_risk_review": category == "high_risk_review",
            "telemetry_gap_flag": category.isin("review", "telemetry_gap_flag"),
        }
        flags = {c: F.coalesce(v, F.lit(False)) for c, v in flags.items()}
    day = F.col("activity_date").cast("string").try_cast("date")
    return report.withColumns(
        {
            "iso_raw_score": F.coalesce("iso_raw_score", F.lit(0.0)),
            "activity_date": F.coalesce(day, F.lit(as_of)),
            **flags,
        }
    )


def by_dates(report: DataFrame, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """Rows between two days, both included."""
    if first is not None:
        report = report.where(F.col("activity_date") >= F.lit(first))
    if last is not None:
        report = report.where(F.col("activity_date") <= F.lit(last))
    return report


def by_categories(report: DataFrame, chosen: Sequence[str] = ALERT_COLUMNS) -> DataFrame:
    """Rows of any chosen category; none chosen keeps nothing."""
    keep = F.lit(False)
    for c in chosen:
        keep = keep | F.col(c)
    return report.where(keep)


def by_user(report: DataFrame, text: str, regex: bool = False) -> DataFrame:
    """Case-insensitive search in the user id; blank text keeps everything."""
    text = text.strip()
    if not text:
        return report
    if regex:
        return report.where(F.col("user").rlike(f"(?i){text}"))
    return report.where(F.contains(F.lower("user"), F.lit(text.lower())))


def by_score(report: DataFrame, highest: float | None = None) -> DataFrame:
    """Rows with a score of at most `highest`; by default all of them."""
    return report if highest is None else report.where(F.col("iso_raw_score") <= highest)


def score_range(report: DataFrame) -> DataFrame:
    return report.agg(
        F.min("iso_raw_score").alias("score_min"), F.max("iso_raw_score").alias("score_max")
    )


def dates(report: DataFrame) -> DataFrame:
    return report.select("activity_date").distinct().orderBy("activity_date")


def kpis(report: DataFrame, shown: Column) -> DataFrame:
    """Counts of the shown rows beside the totals, in one pass: one row.

    `shown` is the filter as a condition, so the report is read once for both.
    """
    inside = F.coalesce(shown, F.lit(False))
    return report.agg(
        *[F.count_if(inside & F.col(c)).alias(f"{c}_shown") for c in ALERT_COLUMNS],
        *[F.count_if(F.col(c)).alias(f"{c}_total") for c in ALERT_COLUMNS],
        F.count_if(inside).alias("alerts_shown"),
    )


def _first_match(labels: dict[str, str], default: str | None) -> Column:
    chain = F
    for c, label in labels.items():
        chain = chain.when(F.col(c), label)
    return chain.otherwise(default) if default is not None else chain


def badge() -> Column:
    return _first_match(BADGES, CLEAN)


def timeline(report: DataFrame) -> DataFrame:
    """Alerts per day and first matching category."""
    return (
        report.select("activity_date", _first_match(TIMELINE, None).alias("category"))
        .where("category IS NOT NULL")
        .groupBy("activity_date", "category")
        .agg(F.count("*").alias("alerts"))
    )


def alert_table(report: DataFrame) -> DataFrame:
    """The table view: badge, key, rounded scores and the first two drivers."""
    drivers = [c for c in report.columns if c.startswith(("top1_", "top2_"))]
    return report.select(
        badge().alias("severity"),
        *KEY,
        F.bround("iso_raw_score", 4).alias("iso_raw_score"),
        F.bround("mad_flag_ratio", 3).alias("mad_flag_ratio"),
        *drivers,
    )


def z_band(z: Column) -> Column:
    return F.when(z > HIGH_Z, "red").when(z > RAISED_Z, "orange").otherwise("green")


def latest_details(detail: DataFrame, order: str) -> DataFrame:
    """One record per alert, the later one by `order` (pre-aggregated, no sort)."""
    rest = [c for c in detail.columns if c not in (*KEY, order)]
    return (
        detail.groupBy(*KEY)
        .agg(F.max_by(F.struct(*rest), F.col(order)).alias("d"))
        .select(*KEY, *[F.col(f"d.{c}").alias(c) for c in rest])
    )


def with_details(report: DataFrame, detail: DataFrame) -> DataFrame:
    """Report rows with their detail record; a miss keeps the row with found = false."""
    marked = detail.withColumn("found", F.lit(True))
    return report.join(marked, list(KEY), "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def missing_details(report: DataFrame, detail: DataFrame) -> DataFrame:
    return report.select(*KEY).join(detail.select(*KEY), list(KEY), "left_anti")


def flag_split(scores: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Flagged and unflagged features of every alert row as two arrays."""
    pairs = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), (F.col(f"{f}_flag") == 1).alias("flagged"))
            for f in features
        ]
    )
    pick = lambda keep: F.transform(
        F.filter(pairs, lambda p: p.flagged if keep else ~p.flagged), lambda p: p.feature
    )
    return scores.select(
        *KEY, pick(True).alias("flagged_features"), pick(False).alias("unflagged_features")
    )
