"""Alerts with per-feature contributions, sentences and a flat report."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayglass.contract import ALERT_COLUMNS, FEATURES, KEY, Params
from dayglass.functions.text import fixed, quoted, sentence
from dayglass.operators.baseline import GLOBAL

DIRECTIONS = ("signed", "absolute")

# Wording of the sentences.
ELEVATED = "'%s' was %s — %s standard deviations above this user's personal baseline of %s."
SUPPRESSED = (
    "'%s' was %s — significantly below this user's personal baseline of %s. "
    "Unusual suppression can indicate credential compromise or forced absence."
)
NORMAL = "'%s' was %s (within normal range; baseline: %s)."
ALSO_FLAGGED = " ⚠ Also flagged by the MAD statistical model."
COLD_START_NOTE = (
    "Note: This user has limited history — scored against company-wide baseline."
)
NARRATIVE = (
    "User '%s' on %s was flagged as '%s' with an Isolation Forest anomaly score of %s "
    "(lower = more anomalous). The strongest driver was '%s': %s "
    "Investigate the top %s features listed below in priority order. %s"
)
NARRATIVE_WITHOUT_DRIVER = (
    "User '%s' on %s was flagged as '%s' with anomaly score %s. "
    "No dominant feature driver identified. %s"
)

REPORT_FIELDS = (
    ("feature", "feature_name"),
    ("shap", "shap_value"),
    ("z_score", "self_z_score"),
    ("raw_value", "raw_value"),
    ("baseline", "user_baseline"),
    ("mad_flagged", "mad_flagged"),
    ("direction", "direction"),
)


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"requested flag columns are missing: {missing}")


def flagged_rows(scores: DataFrame, flags: Sequence[str] = ALERT_COLUMNS) -> DataFrame:
    """Rows where any of the requested flag columns is set."""
    require_columns(scores, flags)
    return scores.where(reduce(lambda a, b: a | b, (F.col(c) == 1 for c in flags)))


def with_raw_features(
    scores: DataFrame, features: DataFrame, flags: Sequence[str] = ALERT_COLUMNS, names: Sequence[str] = FEATURES
) -> DataFrame:
    """Flagged score rows with their raw feature values."""
    return flagged_rows(scores, flags).join(features.select(*KEY, *names), list(KEY))


def direction(threshold: float, mode: str = "signed") -> str:
    """SQL for elevated / suppressed / normal of an entry c (z, x, median).

    "signed" calls an outlier below its median suppressed. "absolute" looks at the
    (never negative) score alone, so a drop reads elevated too.
    """
    if mode not in DIRECTIONS:
        raise ValueError(f"direction mode must be one of {DIRECTIONS}, not {mode!r}")
    outlier = f"c.z > {float(threshold)!r}D"
    drop = f"{outlier} AND c.x < c.median" if mode == "signed" else "c.z < 0"
    return f"CASE WHEN {drop} THEN 'suppressed' WHEN {outlier} THEN 'elevated' ELSE 'normal' END"


def reason() -> str:
    """SQL for the sentence of an entry c."""
    raw, base, z = fixed("c.x", 2), fixed("c.median", 2), fixed("c.z", 1)
    return f"""concat(
        CASE c.direction
          WHEN 'elevated' THEN {sentence(ELEVATED, "c.feature", raw, z, base)}
          WHEN 'suppressed' THEN {sentence(SUPPRESSED, "c.feature", raw, base)}
          ELSE {sentence(NORMAL, "c.feature", raw, base)} END,
        IF(c.mad_flagged, {quoted(ALSO_FLAGGED)}, ''))"""


ALERT_CATEGORY = """CASE
    WHEN high_risk_review = 1 THEN 'high_risk_review'
    WHEN confirmed_threat = 1 THEN 'confirmed_threat'
    WHEN telemetry_gap_flag = 1 THEN 'telemetry_gap_flag'
    ELSE 'review' END"""


def with_contributions(df: DataFrame, params: Params, fill: float, mode: str = "signed") -> DataFrame:
    """Add all_contributions, largest absolute attribution first; null without `phi`.

    Needs the features, their z_, _flag and _median columns, and `phi` in feature order.
    Ties keep the alphabetical feature order.
    """
    entries = ", ".join(
        f"struct('{f}' AS feature, {f} AS x, coalesce(z_{f}, {float(fill)!r}D) AS z, "
        f"{f}_median AS median, bround(phi[{i}], 6) AS phi, {f}_flag = 1 AS mad_flagged)"
        for i, f in enumerate(params.features)
    )
    return (
        df.selectExpr("*", f"IF(phi IS NULL, NULL, array({entries})) AS entries")
        .withColumn(
            "entries",
            F.expr(
                "array_sort(transform(entries, c -> struct(-abs(c.phi) AS place, c.feature AS feature, "
                "c.x AS x, c.z AS z, c.median AS median, c.phi AS phi, c.mad_flagged AS mad_flagged, "
                f"{direction(params.mad_threshold, mode)} AS direction)))"
            ),
        )
        .withColumn(
            "all_contributions",
            F.expr(
                "transform(entries, c -> struct(c.feature AS feature_name, bround(c.x, 4) AS raw_value, "
                "bround(c.median, 4) AS user_baseline, bround(c.z, 4) AS self_z_score, "
                "c.phi AS shap_value, c.mad_flagged AS mad_flagged, c.direction AS direction, "
                f"{reason()} AS plain_english))"
            ),
        )
        .drop("entries")
    )


def narrative(top_n: int) -> str:
    """SQL for the summary of an alert from its category, score and first contribution."""
    note = f"IF(baseline_source = '{GLOBAL}', {quoted(COLD_START_NOTE)}, '')"
    who = ("user", "string(activity_date)", "threat_category", fixed("iso_raw_score", 4))
    first = "get(top_contributors, 0)"
    n = f"string(least({top_n}, size(top_contributors)))"
    full = sentence(NARRATIVE, *who, f"{first}.feature_name", f"{first}.plain_english", n, note)
    bare = sentence(NARRATIVE_WITHOUT_DRIVER, *who, note)
    return f"trim(IF(size(top_contributors) > 0, {full}, {bare}))"


def alerts(attributed: DataFrame, params: Params, fill: float, top_n: int = 5, mode: str = "signed") -> DataFrame:
    """Alert records from flagged rows with `phi`; a row without phi carries explain_error."""
    return (
        with_contributions(attributed, params, fill, mode)
        .selectExpr(
            *KEY,
            f"{ALERT_CATEGORY} AS threat_category",
            "iso_forest_raw_score AS iso_raw_score",
            "mad_flag_ratio",
            f"slice(all_contributions, 1, {int(top_n)}) AS top_contributors",
            "all_contributions",
            "baseline_source",
        )
        .selectExpr(
            *KEY,
            "threat_category",
            "iso_raw_score",
            "mad_flag_ratio",
            "top_contributors",
            "all_contributions",
            f"{narrative(top_n)} AS narrative",
            "baseline_source",
            "IF(all_contributions IS NULL, 'attribution failed', NULL) AS explain_error",
        )
    )


def failed_alerts(explained: DataFrame) -> DataFrame:
    return explained.where("explain_error IS NOT NULL").select(*KEY, "threat_category", "explain_error")


def flat_report(explained: DataFrame, top_n: int = 5) -> DataFrame:
    """One wide row per explained alert, with top<k>_ columns."""
    top = [
        f"get(top_contributors, {k - 1}).{name} AS top{k}_{label}"
        for k in range(1, top_n + 1)
        for label, name in REPORT_FIELDS
    ]
    return explained.where("explain_error IS NULL").selectExpr(
        *KEY,
        "threat_category",
        "iso_raw_score",
        "mad_flag_ratio",
        "baseline_source",
        "narrative",
        *top,
    )


def contribution_rows(explained: DataFrame) -> DataFrame:
    """All contributions in long form with their position in the alert."""
    return explained.select(
        *KEY, F.posexplode("all_contributions").alias("pos", "c")
    ).select(*KEY, (F.col("pos") + 1).alias("position"), "c.*")
