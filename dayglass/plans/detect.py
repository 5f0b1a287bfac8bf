"""End-to-end jobs: matrix, explanation, importance, full diagnostics."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayglass.contract import ALERT_COLUMNS, KEY, Params
from dayglass.operators import attribution, baseline, diagnostics
from dayglass.operators import forest as IF
from dayglass.operators.features import KEYWORDS, email_features, http_features, logon_features
from dayglass.operators.fusion import align, fuse, require_nulls
from dayglass.operators.gates import require_rows
from dayglass.plans.model import Model, fit, score
from dayglass.sources.store import materialize

Window = tuple[dt.date | None, dt.date | None]


def source_features(
    logs: Mapping[str, DataFrame],
    window: Window = (None, None),
    keywords: Sequence[str] = KEYWORDS,
    feed: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The three daily feature tables of a window from typed logs.

    A daily threat feed takes the keywords' place (see http_features).
    """
    start, end = window
    return {
        "logon": logon_features(logs["logon"], start, end),
        "http": http_features(logs["http"], start, end, keywords, feed),
        "email": email_features(logs["email"], start, end),
    }


def matrix(
    logs: Mapping[str, DataFrame],
    window: Window = (None, None),
    keywords: Sequence[str] = KEYWORDS,
    feed: DataFrame | None = None,
    **fuse_options,
) -> DataFrame:
    """The fused user-day matrix of a window."""
    return fuse(**source_features(logs, window, keywords, feed), **fuse_options)


def explain(
    scores: DataFrame,
    features: DataFrame,
    model: Model,
    flags: Sequence[str] = ALERT_COLUMNS,
    top_n: int = 5,
    direction: str = "signed",
) -> DataFrame:
    """Explained alerts of the flagged rows only, one per user-day.

    The rows keep the baseline they were scored with. They are spread anew before the
    attribution, which costs far more per row than the scan that found them.
    """
    kept = [
        "iso_forest_raw_score", "mad_flag_ratio", "baseline_source", *ALERT_COLUMNS,
        *[f"{f}_flag" for f in model.features],
    ]
    chosen = attribution.with_raw_features(scores.select(*KEY, *kept), align(features, model.features), flags, model.features)
    routed = baseline.routed(chosen, model.baseline, model.population, model.params)
    scored = baseline.with_self_scores(routed, model.params)
    ready = IF.model_input(scored, model.thresholds.fill_value, model.scaling, features=model.features)
    ready = ready.repartition(IF.spread(ready.sparkSession), *KEY)  # a stated number stays
    attributed = ready.withColumn("phi", IF.contributions(ready, model.forest))
    return attribution.alerts(
        attributed, model.params, model.thresholds.fill_value, top_n, direction
    )


def training_input(history: DataFrame, model: Model) -> DataFrame:
    """Filled and scaled training z in x_<feature> columns, beside the key."""
    z = baseline.self_scores(align(history, model.features), model.baseline, model.population, model.params)
    return IF.model_input(z, model.thresholds.fill_value, model.scaling, "", model.features)


def background(history: DataFrame, model: Model, n: int = 200) -> DataFrame:
    """Seeded sample of model inputs from the training rows."""
    x = training_input(history, model)
    return IF.sample_rows(x.select(*KEY, *[f"x_{f}" for f in model.features]), n, model.params.seed, history.count())


def global_importance(history: DataFrame, model: Model, n: int = 500) -> DataFrame:
    """Mean absolute attribution per feature over a seeded training sample."""
    # the sample is bounded; spread it over the cores
    sample = background(history, model, n).repartition(16, *KEY)
    return IF.importance(sample.withColumn("phi", IF.contributions(sample, model.forest)), features=model.features)


def full_diagnostics(scores: DataFrame, live: DataFrame, model: Model) -> dict[str, DataFrame]:
    """The diagnostic sections by name."""
    t = model.thresholds
    return {
        "flag_counts": diagnostics.flag_counts(scores),
        "fusion_breakdown": diagnostics.fusion_breakdown(scores),
        "score_distribution": diagnostics.score_distribution(scores),
        "ratio_what_if": diagnostics.ratio_what_if(scores, t.critical_flag_ratio),
        "iso_what_if": diagnostics.iso_what_if(scores, t.iso_threshold),
        "score_drift": diagnostics.score_drift(scores, model.score_points),
        "missingness": diagnostics.missingness(
            align(live, model.features), scores, model.params.missing_data_tolerance, model.features
        ),
        "tolerance_what_if": diagnostics.tolerance_what_if(
            align(live, model.features), model.params.missing_data_tolerance, model.features
        ),
        "score_position": diagnostics.score_position(scores, t.iso_threshold),
        "score_summary": diagnostics.score_summary(scores),
        "feature_flag_rates": diagnostics.feature_flag_rates(scores),
        "dead_features": diagnostics.dead_features(scores),
        "user_coverage": diagnostics.user_coverage(scores, model.baseline),
        "top_threat_users": diagnostics.top_threat_users(scores, model.baseline),
        "recommendations": diagnostics.recommendations(scores),
    }


def run(
    logs: Mapping[str, DataFrame],
    history_window: Window,
    live_window: Window,
    params: Params = Params(),
    keywords: Sequence[str] = KEYWORDS,
    version: str = "1",
    top_n: int = 5,
    feed: DataFrame | None = None,
) -> dict[str, DataFrame | Model]:
    """Fit on one window, score and explain another."""
    model = fit(matrix(logs, history_window, keywords, feed), params, version)
    live = require_rows(materialize(matrix(logs, live_window, keywords, feed), "live"), "live")
    require_nulls(live)
    scores = materialize(score(live, model), "scores")
    alerts = explain(scores, live, model, top_n=top_n)
    return {
        "model": model,
        "live": live,
        "scores": scores,
        "alerts": alerts,
        "report": attribution.flat_report(alerts, top_n),
    }
