"""Features beside the fifteen run through the whole chain."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dayglass.contract import FEATURES, KEY, Params
from dayglass.operators import diagnostics, fusion, gates
from dayglass.plans import detect, model
from dayglass.sources import store

MORE = ("badge_swipes", "print_share")
DAYS = 12


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    history, live = [], []
    for u in range(12):
        for d in range(1, DAYS + 2):
            row = [f"u{u}", dt.date(2024, 1, d), *[float(rng.randint(0, 3)) for _ in FEATURES], float(rng.randint(0, 4)), rng.random()]
            (history if d <= DAYS else live).append(row)
    live[0][2 + len(FEATURES)] = 500.0  # only the further feature tells
    live[1][3 + len(FEATURES)] = None
    schema = ", ".join(["user string", "activity_date date", *[f"{f} double" for f in (*FEATURES, *MORE)]])
    return tuple(store.materialize(spark.createDataFrame(t, schema), n) for t, n in ((history, "h"), (live, "l")))


@pytest.fixture(scope="module")
def fitted(tables):
    return model.fit(tables[0], Params(features=None, trees=20, subsample=64, critical_flag_ratio=0.01), "wide")


def test_fit_learns_the_names(fitted):
    assert fitted.features == (*FEATURES, *MORE)
    assert set(fitted.population) == set(fitted.features) == set(fitted.scaling)
    split = {r["feature"] for r in fitted.forest_table.where("feature IS NOT NULL").select("feature").distinct().collect()}
    assert set(MORE) <= split


def test_scores_flag_the_further_feature_and_count_its_gap(tables, fitted):
    scores = {r["user"]: r for r in model.score(tables[1], fitted).collect()}
    assert scores["u0"]["badge_swipes_flag"] == 1 and scores["u0"]["observed_feature_count"] == len(FEATURES) + 2
    assert scores["u1"]["print_share_flag"] == 0 and scores["u1"]["observed_feature_count"] == len(FEATURES) + 1
    plain = model.fit(tables[0], Params(trees=5, subsample=32, critical_flag_ratio=0.01))
    assert plain.features == FEATURES
    ours = {r["user"]: r.asDict() for r in model.score(tables[1], plain).collect()}
    assert "badge_swipes_flag" not in ours["u0"]
    assert all(scores[u][f"{f}_flag"] == ours[u][f"{f}_flag"] for u in ours for f in FEATURES)


def test_saved_model_keeps_the_names(spark, tables, fitted, tmp_path):
    model.save_model(fitted, str(tmp_path))
    again = model.load_model(spark, str(tmp_path), "wide")
    assert again.features == fitted.features and again.params == fitted.params
    assert sorted(model.score(tables[1], again).collect(), key=str) == sorted(model.score(tables[1], fitted).collect(), key=str)


def test_explanations_importance_and_sections(tables, fitted):
    history, live = tables
    scores = store.materialize(model.score(live, fitted), "s").withColumn("confirmed_threat", F.lit(1))
    alerts = detect.explain(scores, live, fitted).collect()
    assert len(alerts) == 12
    assert all(sorted(c["feature_name"] for c in a["all_contributions"]) == sorted(fitted.features) for a in alerts)
    swipes = next(c for a in alerts if a["user"] == "u0" for c in a["all_contributions"] if c["feature_name"] == "badge_swipes")
    assert swipes["raw_value"] == 500.0 and swipes["mad_flagged"] and swipes["direction"] == "elevated"
    ranks = detect.global_importance(history, fitted, 50).collect()
    assert sorted(r["feature"] for r in ranks) == sorted(fitted.features)
    rates = {r["feature"] for r in diagnostics.feature_flag_rates(scores).collect()}
    assert rates == set(fitted.features)
    assert detect.full_diagnostics(scores, live, fitted)["missingness"].first()["rows_with_missing"] == 1


def test_missing_features_can_raise(tables, fitted):
    less = tables[1].drop("badge_swipes")
    assert model.score(less, fitted).count() == 12  # counted as unobserved
    with pytest.raises(ValueError, match="badge_swipes"):
        model.score(less, fitted, drift="raise")
    assert gates.feature_drift(tables[1], fitted.features) == {"missing": [], "extra": []}


def test_bad_names():
    for names in ((), ("a", "A"), ("a b",), ("user",), ("x; drop",), ("iso_forest",)):
        with pytest.raises(ValueError):
            Params(features=names)


def test_fusing_further_sources(spark):
    day = dt.date(2024, 1, 2)
    key = "user string, activity_date date"
    empty = {s: spark.createDataFrame([], key + "".join(f", {f} double" for f in fs)) for s, fs in fusion.SOURCES.items()}
    base = {**empty, "logon": spark.createDataFrame([("a", day, 1.0, 0.5, 1.0, 0.0, 0.0)], empty["logon"].schema)}
    door = spark.createDataFrame([("b", day, 3, 0.5)], f"{key}, badge_swipes int, print_share double")
    rows = {r["user"]: r for r in fusion.fuse(**base, more={"door": door}, unknown=["print_share"], keep_presence=True).collect()}
    assert rows["a"]["badge_swipes"] == 0.0 and rows["a"]["print_share"] is None and not rows["a"]["has_door"]
    assert rows["b"]["badge_swipes"] == 3.0 and rows["b"]["off_hours_ratio"] is None and rows["b"]["url_visits"] == 0.0
    assert list(fusion.fuse(**base).columns) == [*KEY, *FEATURES]
    clash = door.withColumnRenamed("badge_swipes", "url_visits")
    with pytest.raises(ValueError):
        fusion.fuse(**base, more={"door": clash})
    with pytest.raises(ValueError):
        fusion.fuse(**base, more={"door": door}, unknown=["badge"])
