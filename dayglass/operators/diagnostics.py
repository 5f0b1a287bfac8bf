"""Diagnostics of a scored batch. Each section is a DataFrame; each reads the scores once.

What-if tables evaluate every grid value as its own aggregate in a single pass, so the
rows are never multiplied by the grid.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayglass.contract import (
    FEATURES,
    KEY,
    RATIO_GRID,
    SCORE_PERCENTILE_GRID,
    STATUS_COLUMNS,
    TOLERANCE_GRID,
)
from dayglass.operators.flags import missing_share
from dayglass.operators.quantiles import quantiles

DRIFT_LIMIT = 0.05  # fixed value
COLD_START_LIMIT = 0.3  # fixed value
FEW_CONFIRMED = 50  # fixed value


def _on(column: str) -> Column:
    return F.col(column) == 1


def _share(part: Column, whole: Column) -> Column:
    """Percent; zero of nothing is 0."""
    return F.when(whole > 0, 100.0 * part / whole).otherwise(0.0)


def _per_column(df: DataFrame, columns: Mapping[str, Column], name: str, value: str) -> DataFrame:
    """One-pass aggregates turned into rows (name, value, total)."""
    wide = df.agg(*[v.alias(c) for c, v in columns.items()], F.count("*").alias("_total"))
    entries = F.array(
        *[F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in columns]
    )
    return wide.select(F.explode(entries).alias("e"), F.col("_total").alias("total")).select(
        "e.*", "total"
    )


def score_summary(scores: DataFrame) -> DataFrame:
    """Counts and percentages of the three verdicts: one row."""
    n = F.count("*")
    out = [n.alias("n_total")]
    for c, short in (
        ("confirmed_threat", "confirmed"),
        ("high_risk_review", "review"),
        ("telemetry_gap_flag", "gap"),
    ):
        hits = F.count_if(_on(c))
        out += [hits.alias(f"n_{short}"), _share(hits, n).alias(f"pct_{short}")]
    return scores.agg(*out)


def flag_counts(scores: DataFrame) -> DataFrame:
    """Rows (flag, n, total, pct); absent columns are left out."""
    present = {c: F.count_if(_on(c)) for c in STATUS_COLUMNS if c in scores.columns}
    return _per_column(scores, present, "flag", "n").withColumn(
        "pct", _share(F.col("n"), F.col("total"))
    )


def fusion_breakdown(scores: DataFrame) -> DataFrame:
    """How the two models and the data-quality gate combine: one row with a diagnosis."""
    both = _on("mad_critical_flag") & _on("iso_forest_flag")
    dirty = _on("data_quality_risk")
    counted = scores.agg(
        F.count_if(both).alias("both_agree"),
        F.count_if(both & ~dirty).alias("clean"),
        F.count_if(both & dirty).alias("dirty"),
        F.count_if(dirty & ~both).alias("dirty_alone"),
    )
    return counted.withColumn(
        "diagnosis",
        F.when(F.col("both_agree") == 0, "the models agree on no row")
        .when(F.col("dirty") == 0, "the models agree only where telemetry is clean")
        .otherwise("ok"),
    )


DISTRIBUTION_COLUMNS = ("iso_forest_raw_score", "mad_flag_ratio", "mad_score_count")
_DISTRIBUTION = {"min": 0.0, "p1": 0.01, "p5": 0.05, "median": 0.5, "p95": 0.95, "p99": 0.99, "max": 1.0}


def score_distribution(scores: DataFrame) -> DataFrame:
    """Rows (column, min, p1, p5, median, p95, p99, max)."""
    long = scores.select(
        *[F.col(c).cast("double").alias(c) for c in DISTRIBUTION_COLUMNS]
    ).unpivot([], list(DISTRIBUTION_COLUMNS), "column", "value")
    found = quantiles(long, "value", list(_DISTRIBUTION.values()), ["column"])
    return found.select(
        "column", *[F.get("quantiles", F.lit(i)).alias(n) for i, n in enumerate(_DISTRIBUTION)]
    )


def _what_if(
    df: DataFrame,
    name: str,
    grid: Sequence[float],
    current: float | None,
    measures: Mapping[str, Callable[[float], Column]],
) -> DataFrame:
    """Rows (name, measures..., total, is_current): one pass, one aggregate per cell."""
    wide = df.agg(
        F.count("*").alias("total"),
        *[
            F.count_if(make(v)).alias(f"{m}_{i}")
            for i, v in enumerate(grid)
            for m, make in measures.items()
        ],
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(float(v)).alias(name),
                F.lit(current is not None and v == current).alias("is_current"),
                *[F.col(f"{m}_{i}").alias(m) for m in measures],
            )
            for i, v in enumerate(grid)
        ]
    )
    return wide.select(F.explode(entries).alias("e"), "total").select("e.*", "total")


def _with_current(grid: Sequence[float], current: float | None) -> list[float]:
    return sorted({*grid, *([] if current is None else [current])})


def ratio_what_if(scores: DataFrame, current: float | None = None) -> DataFrame:
    """Confirmed and review counts at other critical flag ratios."""
    iso, dirty = _on("iso_forest_flag"), _on("data_quality_risk")
    hit = lambda r: (F.col("mad_flag_ratio") >= r) & iso
    table = _what_if(
        scores,
        "ratio",
        _with_current(RATIO_GRID, current),
        current,
        {"confirmed": lambda r: hit(r) & ~dirty, "high_risk": lambda r: hit(r) & dirty},
    )
    return table.withColumn("pct", _share(F.col("confirmed") + F.col("high_risk"), F.col("total")))


def live_thresholds(scores: DataFrame, current: float | None = None) -> DataFrame:
    """Distinct thresholds to try: live percentiles and the current one, 6 places, ascending."""
    probs = [p / 100.0 for p in SCORE_PERCENTILE_GRID]
    found = quantiles(scores, "iso_forest_raw_score", probs).select(
        F.explode("quantiles").alias("threshold")
    )
    if current is not None:
        one = found.sparkSession.range(1).select(F.lit(float(current)).alias("threshold"))
        found = found.union(one)
    return found.select(F.bround("threshold", 6).alias("threshold")).distinct().orderBy("threshold")


def iso_what_if(scores: DataFrame, current: float | None = None) -> DataFrame:
    """Flag, confirmed and review counts at other forest thresholds."""
    grid = [r["threshold"] for r in live_thresholds(scores, current).collect()]  # at most 7
    mad, dirty = _on("mad_critical_flag"), _on("data_quality_risk")
    below = lambda t: F.col("iso_forest_raw_score") < t
    return _what_if(
        scores,
        "threshold",
        grid,
        None if current is None else round(current, 6),
        {
            "iso_flagged": below,
            "confirmed": lambda t: below(t) & mad & ~dirty,
            "high_risk": lambda t: below(t) & mad & dirty,
        },
    )


def score_position(scores: DataFrame, threshold: float) -> DataFrame:
    """Rows below and not below the forest threshold: one row."""
    below = F.col("iso_forest_raw_score") < threshold
    return scores.agg(F.count_if(below).alias("flagged"), F.count_if(~below).alias("clean"))


def score_drift(scores: DataFrame, score_points: Sequence[float]) -> DataFrame:
    """Live median score against the stored training median: one row."""
    trained = F.lit(float(score_points[len(score_points) // 2]))
    live = quantiles(scores, "iso_forest_raw_score", (0.5,)).select(
        F.get("quantiles", F.lit(0)).alias("live_median")
    )
    return live.select(
        trained.alias("train_median"),
        "live_median",
        (F.col("live_median") - trained).alias("shift"),
        (F.abs(F.col("live_median") - trained) > DRIFT_LIMIT).alias("drifted"),
    )


def missingness(live: DataFrame, scores: DataFrame, tolerance: float, features: Sequence[str] = FEATURES) -> DataFrame:
    """Distribution of the null share per row, with a diagnosis: one row."""
    share = live.select(F.expr(missing_share(features)).alias("share"))
    found = share.agg(
        F.min("share").alias("share_min"),
        # at most one value more than features
        F.percentile("share", 0.5).alias("share_median"),
        F.avg("share").alias("share_mean"),
        F.max("share").alias("share_max"),
        F.count_if(F.col("share") > 0).alias("rows_with_missing"),
        F.count_if(F.col("share") > tolerance).alias("rows_over_tolerance"),
    )
    fired = scores.agg(F.count_if(_on("data_quality_risk"))).scalar()
    return found.withColumn("dq_rows", fired).withColumn(
        "diagnosis",
        F.when(F.col("dq_rows") > 0, "ok")
        .when(F.col("share_max") < tolerance, "missingness never reaches the tolerance")
        .otherwise("missing values were filled before scoring"),
    )


def tolerance_what_if(live: DataFrame, current: float | None = None, features: Sequence[str] = FEATURES) -> DataFrame:
    """Rows at data-quality risk under other tolerances."""
    share = live.select(F.expr(missing_share(features)).alias("share"))
    table = _what_if(
        share,
        "tolerance",
        _with_current(TOLERANCE_GRID, current),
        current,
        {"dq_rows": lambda t: F.col("share") > t},
    )
    return table.withColumn("pct", _share(F.col("dq_rows"), F.col("total")))


def flag_columns(scores: DataFrame) -> list[str]:
    """Per-feature flag columns of a score table, reserved status columns excluded."""
    return [c for c in scores.columns if c.endswith("_flag") and c not in STATUS_COLUMNS]


def feature_flag_rates(scores: DataFrame) -> DataFrame:
    """Rows (feature, n, total, rate), highest rate first."""
    counts = {c.removesuffix("_flag"): F.count_if(_on(c)) for c in flag_columns(scores)}
    rates = _per_column(scores, counts, "feature", "n")
    return rates.withColumn("rate", _share(F.col("n"), F.col("total")) / 100.0).orderBy(
        F.desc("rate"), "feature"
    )


def dead_features(scores: DataFrame) -> DataFrame:
    return feature_flag_rates(scores).where("n = 0").select("feature").orderBy("feature")


def user_coverage(scores: DataFrame, baseline: DataFrame) -> DataFrame:
    """Trained, live, known and cold-start users: one row."""
    live = scores.select("user").distinct()
    trained = baseline.select("user", F.lit(1).alias("trained"))
    both = live.withColumn("live", F.lit(1)).join(trained, "user", "full")
    counted = both.agg(
        F.count("trained").alias("trained_users"),
        F.count("live").alias("live_users"),
        F.count_if(F.col("live").isNotNull() & F.col("trained").isNotNull()).alias("known_users"),
        F.count_if(F.col("live").isNotNull() & F.col("trained").isNull()).alias("cold_start_users"),
    )
    return counted.withColumns(
        {
            "cold_start_pct": _share(F.col("cold_start_users"), F.col("live_users")),
            "many_cold_starts": F.col("cold_start_users") > COLD_START_LIMIT * F.col("live_users"),
        }
    )


def threat_days(scores: DataFrame) -> DataFrame:
    """Users with confirmed threats: rows (user, threat_days)."""
    return (
        scores.groupBy("user")
        .agg(F.count_if(_on("confirmed_threat")).alias("threat_days"))
        .where("threat_days > 0")
    )


def top_threat_users(scores: DataFrame, baseline: DataFrame, n: int = 10) -> DataFrame:
    """The n users with most threat days and whether they are cold starts."""
    top = threat_days(scores).orderBy(F.desc("threat_days"), "user").limit(n)
    known = baseline.select("user", F.lit(True).alias("known"))
    return top.join(known, "user", "left").select(
        "user", "threat_days", F.isnull("known").alias("cold_start")
    )


# Issue texts of the recommendations.
ISSUES = {
    "mad": "mad_critical_flag never fires",
    "iso": "iso_forest_flag never fires",
    "dq": "data_quality_risk never fires → high_risk_review and telemetry_gap_flag impossible",
    "few": "Both models firing but very few confirmed threats",
}
ACTIONS = {
    "mad": "lower critical_flag_ratio or mad_threshold",
    "iso": "raise iso_threshold, for example to the 5th percentile of the live scores",
    "dq": "lower missing_data_tolerance or stop filling nulls before scoring",
    "few": "compare the per-feature flag rates and lower both thresholds together",
}


def recommendations(scores: DataFrame) -> DataFrame:
    """Rows (issue_no, issue, action) from the flag counts; no row when all is well."""
    n = scores.agg(*[F.count_if(_on(c)).alias(c) for c in STATUS_COLUMNS])
    rules = {
        "mad": F.col("mad_critical_flag") == 0,
        "iso": F.col("iso_forest_flag") == 0,
        "dq": F.col("data_quality_risk") == 0,
        "few": (F.col("mad_critical_flag") > 0)
        & (F.col("iso_forest_flag") > 0)
        & (F.col("confirmed_threat") < FEW_CONFIRMED),
    }
    found = F.array_compact(
        F.array(
            *[
                F.when(
                    rule, F.struct(F.lit(ISSUES[k]).alias("issue"), F.lit(ACTIONS[k]).alias("action"))
                )
                for k, rule in rules.items()
            ]
        )
    )
    return n.select(F.posexplode(found).alias("i", "r")).select(
        (F.col("i") + 1).alias("issue_no"), "r.issue", "r.action"
    )


# --- labelled evaluation --------------------------------------------------------


def labelled(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores with their label; a user-day without label is negative."""
    return scores.join(labels.select(*KEY, "label"), list(KEY), "left").withColumn(
        "label", F.coalesce("label", F.lit(0))
    )


def evaluate(scores: DataFrame, labels: DataFrame, score_col: str = "confirmed_threat") -> DataFrame:
    """Confusion counts and quality measures: one row, none without positive labels."""
    hit, true = _on(score_col), F.col("label") == 1
    c = labelled(scores, labels).agg(
        F.count_if(hit & true).alias("tp"),
        F.count_if(hit & ~true).alias("fp"),
        F.count_if(~hit & true).alias("fn"),
        F.count_if(~hit & ~true).alias("tn"),
    )
    ratio = lambda a, b: f"IF({b} > 0, {a} / ({b}), 0D)"
    f_beta = lambda b: ratio(f"{1 + b * b} * p * r", f"({b * b} * p + r)")
    return (
        c.where("tp + fn > 0")
        .selectExpr("*", f"{ratio('tp', '(tp + fp)')} AS p", f"{ratio('tp', '(tp + fn)')} AS r")
        .selectExpr(
            "round(p, 4) AS precision",
            "round(r, 4) AS recall",
            f"round({f_beta(1)}, 4) AS f1",
            f"round({f_beta(2)}, 4) AS f2",
            f"round({ratio('fp', '(fp + tn)')}, 4) AS false_positive_rate",
            "tp AS true_positives",
            "fp AS false_positives",
            "fn AS false_negatives",
            "tn AS true_negatives",
            "tp + fn AS support_positive",
            "fp + tn AS support_negative",
        )
    )
