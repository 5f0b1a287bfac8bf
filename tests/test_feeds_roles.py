import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayglass.contract import FEATURES, Params
from dayglass.operators import feeds, roles
from dayglass.operators.quantiles import quantiles


def test_hosts_and_hits(spark):
    day = dt.datetime(2024, 1, 2, 3)
    rows = [("a", "HTTP://Bad.example:80/x", day), ("a", "http://bad.example?y", day), ("b", "no url", day), ("c", None, day), ("SYSTEM", "http://bad.example", day)]
    log = spark.createDataFrame(rows, "user string, url string, ts timestamp_ntz")
    feed = spark.createDataFrame([("BAD.example",), ("bad.example",), (None,)], "host string")
    got = [tuple(r) for r in feeds.feed_hits(log, feed).collect()]
    assert got == [("a", day.date(), 2, 1)]
    assert feeds.feed_hits(log, feed.where("false")).count() == 0


def test_route_falls_back_from_user_to_role_to_population(spark):
    day = dt.date(2024, 1, 2)
    live = spark.createDataFrame([(u, day) for u in "abcd"], "user string, activity_date date")
    history = live.where("user in ('a', 'b')").select("*", *[F.lit(1.0).alias(f) for f in FEATURES])
    users = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", None)], "user string, role string")
    stats = roles.role_baseline(history, users)
    assert stats.count() == len(FEATURES) and {r["mad"] for r in stats.collect()} == {0.0}
    got = {r["user"]: r["baseline_source"] for r in roles.baseline_route(live, history.where("user = 'a'"), users, stats).collect()}
    assert got == {"a": "personal", "b": "role", "c": "role", "d": "global_cold_start"}


def test_role_cells_are_counted_before_they_meet_the_medians(spark):
    rng = np.random.default_rng(3)
    day = dt.date(2024, 1, 1)
    values = [(f"u{i % 6}", day + dt.timedelta(i), *[float(v) for v in rng.integers(0, 9, len(FEATURES))]) for i in range(90)]
    values += [("u0", day, *[None] * len(FEATURES))]
    history = spark.createDataFrame(values, "user string, activity_date date, " + ", ".join(f"{f} double" for f in FEATURES))
    users = spark.createDataFrame([(f"u{i}", "xy"[i % 2]) for i in range(6)], "user string, role string")
    table = roles.role_baseline(history, users, Params(mad_scale="raw"))
    got = {(r["role"], r["feature"]): (r["median"], r["mad"], r["p95"]) for r in table.collect()}
    assert len(got) == 2 * len(FEATURES)
    for i, f in enumerate(FEATURES):
        for role in "xy":
            x = np.array([v[2 + i] for v in values if v[2] is not None and "xy"[int(v[0][1]) % 2] == role])
            want = (np.median(x), np.median(abs(x - np.median(x))), np.quantile(x, 0.95))
            assert got[role, f] == pytest.approx(want)
    above: list[str] = []  # the nodes above a line of the plan
    for line in table._jdf.queryExecution().optimizedPlan().toString().splitlines():
        node = line.lstrip(" :+-")
        above = [*above[: (len(line) - len(node)) // 3], node]
        if node.startswith("Expand"):
            first = next(n for n in reversed(above) if n.startswith("Aggregate") or n.startswith("Join") and "feature" in n)
            assert first.startswith("Aggregate")


def test_weighted_rows_stand_for_equal_ones(spark):
    rows = [("a", 1.0, 3), ("a", 5.0, 1), ("a", 2.0, 4), ("b", None, 2), ("b", 7.0, 2)]
    df = spark.createDataFrame(rows, "g string, v double, n long")
    probs = (0.0, 0.4, 0.5, 0.95)
    got = {r["g"]: (r["n"], r["quantiles"]) for r in quantiles(df, "v", probs, ["g"], "n").collect()}
    assert got["a"] == (8, pytest.approx(np.quantile([1, 1, 1, 5, 2, 2, 2, 2], probs).tolist()))
    assert got["b"] == (2, [7.0] * 4)
