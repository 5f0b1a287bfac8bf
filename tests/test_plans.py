"""Fitted detector end to end on the small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from catalog.queries import ORACLE, QUERIES
from dayglass.contract import ALERT_COLUMNS, FEATURES, KEY, Params
from dayglass.operators import attribution, diagnostics, report
from dayglass.plans import detect, model, population
from dayglass.sources import activity, store

PARAMS = Params(trees=20, subsample=64, min_history_days=10)


@pytest.fixture(scope="module")
def job(spark, sf):
    logs = activity.logs(spark, sf)
    return detect.run(logs, activity.HISTORY, activity.LIVE, PARAMS, activity.KEYWORDS, "v1")


def test_scores_cover_the_live_matrix(job):
    live, scores = job["live"], job["scores"]
    assert scores.count() == live.count() > 0
    assert scores.select(*KEY).exceptAll(live.select(*KEY)).isEmpty()
    assert scores.where("confirmed_threat + high_risk_review + telemetry_gap_flag > 1").isEmpty()
    assert scores.where("data_quality_risk = 1").count() > 0


def test_scoring_ignores_column_order_and_partitioning(job):
    live = job["live"]
    other = live.select(*reversed(live.columns)).repartition(5)
    a = model.score(live, job["model"]).drop("iso_forest_raw_score")
    b = model.score(other, job["model"]).drop("iso_forest_raw_score")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_model_round_trip(spark, job, tmp_path):
    path = str(tmp_path / "models")
    model.save_model(job["model"], path)
    again = model.load_model(spark, path, "v1")
    assert again.thresholds == job["model"].thresholds and again.params == PARAMS
    rescored = model.score(job["live"], again)
    assert rescored.exceptAll(job["scores"]).isEmpty()
    broken = spark.read.parquet(f"{path}/v1/forest").where("tree > 0")
    broken.write.parquet(f"{path}/v2/forest")
    for part in ("baseline", "meta", "checksum"):
        spark.read.parquet(f"{path}/v1/{part}").write.parquet(f"{path}/v2/{part}")
    with pytest.raises(ValueError, match="checksum"):
        model.load_model(spark, path, "v2")


def test_missing_checksum_only_warns(spark, job, tmp_path, caplog):
    path = str(tmp_path / "models")
    model.save_model(job["model"], path)
    for part in ("baseline", "forest", "meta"):
        spark.read.parquet(f"{path}/v1/{part}").write.parquet(f"{path}/v3/{part}")
    model.load_model(spark, path, "v3")
    assert "checksum" in caplog.text


def test_override_needs_no_refit(job):
    loose = job["model"].override(critical_flag_ratio=0.0, iso_threshold=9.0, missing_data_tolerance=2.0)
    scores = model.score(job["live"], loose)
    assert scores.where("confirmed_threat = 0").isEmpty()


def test_explanations(job):
    alerts = store.materialize(job["alerts"], "alerts")
    scores = job["scores"]
    flagged = attribution.flagged_rows(scores)
    assert alerts.count() == flagged.count() > 0
    rows = alerts.collect()
    for r in rows:
        sizes = [-abs(c["shap_value"]) for c in r["all_contributions"]]
        assert sizes == sorted(sizes) and len(sizes) == 15
        assert r["top_contributors"] == r["all_contributions"][:5]
        assert r["explain_error"] is None and r["narrative"].startswith(f"User '{r['user']}' on ")
    wide = attribution.flat_report(alerts)
    assert {"top1_feature", "top5_direction"} <= set(wide.columns)
    typed = report.typed_report(wide, dt.date(2024, 2, 1))
    gaps = typed.where("telemetry_gap_flag").count()
    assert gaps == scores.where("telemetry_gap_flag = 1").count()


def test_explain_accepts_lazy_scores(job):
    """A filter on the verdict must not be rewritten through the whole plan."""
    lazy = model.score(job["live"], job["model"])
    assert detect.explain(lazy, job["live"], job["model"]).count() == job["alerts"].count()


def test_importance_and_background(job, spark, sf):
    history = store.materialize(detect.matrix(activity.logs(spark, sf), activity.HISTORY, activity.KEYWORDS), "h")
    ranks = detect.global_importance(history, job["model"], 50).collect()
    assert len(ranks) == 15 and ranks[0]["rank"] == 1
    assert {r["feature"] for r in ranks} == set(FEATURES)
    assert detect.background(history, job["model"], 30).count() == 30


def test_rank_ties_take_the_smallest(spark):
    from dayglass.operators.forest import ranked

    df = spark.createDataFrame([("a", 2.0), ("b", 2.0), ("c", 1.0)], "feature string, mean_abs_shap double")
    assert [r["rank"] for r in ranked(df).collect()] == [1, 1, 3]


def test_diagnostics_sections(job):
    sections = detect.full_diagnostics(job["scores"], job["live"], job["model"])
    for name, df in sections.items():
        rows = df.collect()
        assert rows or name in ("recommendations", "top_threat_users"), name
    current = sections["ratio_what_if"].where("is_current").first()
    assert current["confirmed"] == job["scores"].where("confirmed_threat = 1").count()


def test_evaluation_without_positives_is_empty(job):
    labels = job["scores"].select(*KEY, F.lit(0).alias("label"))
    assert diagnostics.evaluate(job["scores"], labels).isEmpty()
    truth = job["scores"].select(*KEY, F.col("telemetry_gap_flag").alias("label"))
    perfect = diagnostics.evaluate(job["scores"], truth, "telemetry_gap_flag").first()
    assert (perfect["precision"], perfect["recall"], perfect["f2"]) == (1.0, 1.0, 1.0)


def test_population_mode(spark, sf):
    logs = activity.logs(spark, sf)
    history = detect.matrix(logs, activity.HISTORY, activity.KEYWORDS, fill="blanket")
    fitted = population.fit_population(history, Params(trees=10, subsample=64, contamination=None))
    live = detect.matrix(logs, activity.LIVE, activity.KEYWORDS, fill="blanket")
    scores = population.score_population(live, fitted)
    assert scores.count() == live.count()
    assert scores.where("data_quality_risk = 1").isEmpty()  # the blanket fill hides gaps


def test_bad_report_arguments(job):
    with pytest.raises(ValueError, match="missing"):
        attribution.flagged_rows(job["scores"], [*ALERT_COLUMNS, "nope"])
    with pytest.raises(ValueError):
        attribution.direction(3.5, "sideways")


def test_catalog_matches_duckdb(spark, sf):
    """A few catalog queries at the smallest scale; check.py runs them all."""
    import duckdb

    from check import TABLES, compare

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for key in ("j01_fuse_full_outer", "a17_global_baseline", "m01_self_score", "m14_verdict", "m27_flat_report"):
        assert key in QUERIES and key in ORACLE
        _, _, verdict = compare(spark, con, key, sf)
        assert verdict == "ok", (key, verdict)
