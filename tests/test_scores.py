"""Baselines, self-scores, flags, thresholds and quantiles against numpy."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayglass.contract import FEATURES, Params
from dayglass.operators import baseline, flags
from dayglass.operators.quantiles import even_grid, quantiles

SCHEMA = f"user string, activity_date date, {', '.join(f'{f} double' for f in FEATURES)}"


def days(spark, table):
    """user -> list of values of the first feature, one per day; other features 1.0."""
    rows = [
        (user, dt.date(2024, 1, 1) + dt.timedelta(days=i), v, *([1.0] * 14))
        for user, values in table.items()
        for i, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def first_z(spark, history, live, params=Params()):
    h = days(spark, history)
    base = baseline.user_baseline(h, params)
    population = baseline.fetch_global(baseline.global_baseline(h, params))
    z = baseline.self_scores(days(spark, live), base, population, params)
    return [r[FEATURES[0]] for r in z.orderBy("user", "activity_date").collect()]


def test_identical_history(spark):
    assert first_z(spark, {"u": [2.0] * 5}, {"u": [2.0, 1.0, None]}) == [0.0, 4.5, None]


def test_zero_mad_with_tail(spark):
    assert first_z(spark, {"u": [0.0, 0.0, 0.0, 0.0, 9.0]}, {"u": [-1.0, 0.0, 100.0]}) == [0.0, 0.0, 4.5]


def test_scaled_z(spark):
    z = first_z(spark, {"u": [1.0, 1.0, 4.0, 7.0, 9.0]}, {"u": [10.0]})
    assert z[0] == pytest.approx(0.6745 * 6 / (3 / 0.6744897501960817))
    raw = first_z(spark, {"u": [1.0, 1.0, 4.0, 7.0, 9.0]}, {"u": [10.0]}, Params(mad_scale="raw"))
    assert raw[0] == pytest.approx(0.6745 * 6 / 3)


def test_history_guard_and_routing(spark):
    history = days(spark, {"long": [1.0] * 5, "short": [1.0] * 4})
    base = baseline.user_baseline(history)
    assert [r["user"] for r in base.collect()] == ["long"]
    live = days(spark, {"long": [1.0] * 2, "short": [1.0] * 9, "new": [1.0]})
    population = baseline.fetch_global(baseline.global_baseline(history))

    def sources(params):
        routed = baseline.routed(live, base, population, params)
        return {r["user"]: r["baseline_source"] for r in routed.collect()}

    personal_by_history = {"long": "personal", "short": "global_cold_start", "new": "global_cold_start"}
    assert sources(Params()) == personal_by_history
    assert set(sources(Params(route_on="live")).values()) == {"global_cold_start"}
    assert baseline.first_unknown_users(live, base).count() == 2
    assert [r["user"] for r in baseline.known_users(live, base).collect()] == ["long"]


def test_empty_feature_counts_as_zero_stats(spark):
    base = baseline.user_baseline(days(spark, {"u": [None] * 5})).first()
    s = base["stats"][FEATURES[0]]
    assert (s["median"], s["mad"], s["p95"]) == (0.0, 0.0, 0.0)


def test_global_baseline_matches_numpy(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([np.zeros(40), rng.exponential(size=60), -rng.random(11)])
    got = baseline.fetch_global(baseline.global_baseline(days(spark, {"u": values.tolist()}), Params()))
    med = np.median(values)
    want = (med, np.median(np.abs(values - med)) / 0.6744897501960817, np.quantile(values, 0.95))
    stats = got[FEATURES[0]]
    assert (stats["median"], stats["mad"], stats["p95"]) == pytest.approx(want, rel=1e-12)


def test_quantiles_match_numpy_at_any_partitioning(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate(
        [np.full(4000, 7.25), rng.normal(size=3000) * 1e-3, rng.exponential(size=2000) * 1e6, -rng.random(999), [0.0, -0.0, 5e-324]]
    )
    rows = [(i % 2, float(v)) for i, v in enumerate(values)] + [(0, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    probs = [0.0, 0.01, 0.333, 0.5, 0.95, 1.0]
    for parts in (1, 7):
        found = {r["g"]: r for r in quantiles(df.repartition(parts), "v", probs, ["g"]).collect()}
        for g in (0, 1):
            mine = np.array([v for k, v in rows if k == g and v is not None])
            assert found[g]["n"] == len(mine)
            np.testing.assert_allclose(found[g]["quantiles"], np.quantile(mine, probs), rtol=1e-12, atol=1e-300)
    grid = quantiles(df, "v", even_grid(1000)).first()["quantiles"]
    np.testing.assert_allclose(grid, np.quantile(values, np.linspace(0, 1, 1000)), rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("n, want", [(29, 0.15), (30, 0.5)])
def test_critical_ratio_needs_thirty_active_rows(spark, n, want):
    df = spark.createDataFrame([(0.5,)] * n + [(0.0,)] * 5, "mad_flag_ratio double")
    assert flags.critical_ratio(df).first()["critical_flag_ratio"] == want
    assert flags.critical_ratio(df).first()["critical_flag_ratio"] == want


def test_critical_ratio_edges(spark):
    none = spark.createDataFrame([(0.0,)], "mad_flag_ratio double")
    assert flags.critical_ratio(none).first()["critical_flag_ratio"] == 0.15
    assert flags.critical_ratio(none, Params(critical_flag_ratio=0.4)).first()[1] == 0.4


def test_flag_comparisons(spark):
    row = {f"z_{f}": 0.0 for f in FEATURES} | {f: 1.0 for f in FEATURES}
    row |= {f"z_{FEATURES[0]}": 3.5, f"z_{FEATURES[1]}": 3.6, f"z_{FEATURES[2]}": None, FEATURES[2]: None}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} double" for k in row))
    out = flags.with_flags(df).first()
    assert [out[f"{f}_flag"] for f in FEATURES[:3]] == [0, 1, 0]
    assert (out["mad_score_count"], out["observed_feature_count"]) == (1, 14)
    assert out["mad_flag_ratio"] == pytest.approx(1 / 14)
    exact = spark.createDataFrame([(0.2, -0.1)], "mad_flag_ratio double, iso_forest_raw_score double")
    got = exact.select(flags.critical_flag(0.2).alias("c"), flags.iso_flag(-0.1).alias("i")).first()
    assert (got["c"], got["i"]) == (1, 0)


def test_missing_tolerance(spark):
    def dq(nulls):
        row = [None] * nulls + [1.0] * (15 - nulls) + [0.0] * 15
        schema = ", ".join(f"{c} double" for c in (*FEATURES, *[f"z_{f}" for f in FEATURES]))
        return flags.with_flags(spark.createDataFrame([tuple(row)], schema)).first()["data_quality_risk"]

    assert [dq(n) for n in (0, 2, 3)] == [0, 0, 1]


def test_verdicts_are_exclusive(spark):
    rows = [(m, i, d) for m in (0, 1) for i in (0, 1) for d in (0, 1)]
    df = spark.createDataFrame(rows, "mad_critical_flag int, iso_forest_flag int, data_quality_risk int")
    for r in flags.with_verdict(df).collect():
        both = r["mad_critical_flag"] and r["iso_forest_flag"]
        assert r["confirmed_threat"] == int(both and not r["data_quality_risk"])
        assert r["high_risk_review"] == int(both and r["data_quality_risk"])
        assert r["telemetry_gap_flag"] == int(r["data_quality_risk"] and not both)


def test_hot_value_and_user(spark):
    """A third of all rows in one value and one user gives the same exact results."""
    rng = np.random.default_rng(9)
    values = np.concatenate([np.full(3000, 4.0), rng.random(6000) * 100])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = quantiles(df, "v", (0.1, 0.5, 0.9)).first()["quantiles"]
    np.testing.assert_allclose(got, np.quantile(values, (0.1, 0.5, 0.9)), rtol=1e-12)


def test_quantiles_skip_nan_and_order_infinities(spark):
    from dayglass.operators.quantiles import quantiles

    nan, inf = float("nan"), float("inf")
    rows = [("a", v) for v in (1.0, 2.0, nan, None)] + [("b", v) for v in (1.0, 2.0, inf)] + [("c", v) for v in (-inf, 5.0, 5.0)]
    rows += [("d", 7.0)] * 5000 + [("d", float(k)) for k in range(2500)]
    found = quantiles(spark.createDataFrame(rows, "g string, v double"), "v", (0.25, 0.5, 1.0), ["g"])
    got = {r["g"]: (r["n"], list(r["quantiles"])) for r in found.collect()}
    assert got["a"] == (2, [1.25, 1.5, 2.0])
    assert got["b"] == (3, [1.5, 2.0, inf])
    assert got["c"] == (3, [-inf, 5.0, 5.0])
    assert got["d"] == (7500, [7.0, 7.0, 2499.0])
