import datetime as dt
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from catalog.world import World
from dayglass.contract import ALERT_COLUMNS, FEATURES, KEY
from dayglass.operators import baseline, drift, explain_queue
from dayglass.sources.store import materialize, scratch_path, write_by_day


@pytest.fixture(scope="module")
def history(spark, sf):
    return World(spark, sf).history


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_sketches_of_days_add_up(history):
    cuts = drift.training_cuts(history)
    days = drift.sketch(history, cuts)
    assert same(drift.merged(days).select("measure", "bin", "n"), drift.sketch(history, cuts, by=()).select("measure", "bin", "n"))
    per = drift.merged(days).groupBy("measure").agg(F.sum("n").alias("n")).collect()
    assert {r.n for r in per} == {history.count()} and len(per) == len(FEATURES)


def test_equal_sets_are_stable_and_a_shift_triggers(history):
    cuts = drift.training_cuts(history)
    reference = drift.merged(drift.sketch(history, cuts))
    equal = drift.decisions(drift.stability(reference, reference), least_rows=10)
    assert {(r.verdict, r.psi, r.distance) for r in equal.collect()} == {("stable", 0.0, 0.0)}
    assert not drift.retrain_due(equal)
    moved = history.withColumn("emails_sent", F.col("emails_sent") + 5)
    shifted = drift.decisions(drift.stability(reference, drift.merged(drift.sketch(moved, cuts))), least_rows=10)
    assert {r.measure for r in shifted.collect() if r.verdict == "retrain"} == {"emails_sent"}
    assert drift.retrain_due(shifted) and not drift.retrain_due(shifted, 2)


def test_against_numbers_by_hand(spark):
    rng = random.Random(3)
    train = [rng.gauss(0, 1) for _ in range(500)] + [None] * 20 + [float("nan"), float("inf")]
    live = [rng.gauss(0.4, 1.3) for _ in range(300)] + [None] * 40
    a, b = (spark.createDataFrame([(v,) for v in values], "x double") for values in (train, live))
    cuts = drift.training_cuts(a, ["x"])
    row = drift.stability(*(drift.sketch(df, cuts, by=()) for df in (a, b))).first()

    def bins(values):
        gone = [v is None or math.isnan(v) for v in values]
        return Counter(-1 if g else sum(v > c for c in cuts["x"]) for v, g in zip(values, gone))

    r, q = bins(train), bins(live)
    share = lambda c, k: max(c[k] / sum(c.values()), drift.LEAST_SHARE)
    keys = set(r) | set(q)
    assert row.psi == pytest.approx(sum((share(q, k) - share(r, k)) * math.log(share(q, k) / share(r, k)) for k in keys))
    below = lambda c, k: sum(n for b, n in c.items() if 0 <= b <= k) / sum(n for b, n in c.items() if b >= 0)
    assert row.distance == pytest.approx(max(abs(below(r, k) - below(q, k)) for k in range(10)))


def test_empty_and_constant_measures(spark):
    none = spark.createDataFrame([(None, 1.0), (None, 1.0)], "x double, y double")
    cuts = drift.training_cuts(none, ["x", "y"])
    assert cuts == {"x": [], "y": [1.0]}
    full = drift.sketch(none, cuts, by=())
    assert {(r.measure, r.bin, r.n) for r in full.collect()} == {("x", -1, 2), ("y", 0, 2)}
    assert {r.verdict for r in drift.decisions(drift.stability(full, full.limit(0))).collect()} == {"too_few"}


def test_sketch_store_replaces_a_day(spark, history):
    path = scratch_path(spark, "sketch")
    days = drift.sketch(history, drift.training_cuts(history))
    drift.write_sketch(days, path)
    day = history.agg(F.max("activity_date")).first()[0]
    drift.write_sketch(days.where(F.col("activity_date") == F.lit(day)), path)
    assert same(spark.read.parquet(path).select(days.columns), days)


def test_refit_by_one_day_reads_that_day(spark, history):
    path = scratch_path(spark, "by-day")
    write_by_day(history, path)
    days = spark.read.parquet(path)
    last = history.agg(F.max("activity_date")).first()[0]
    state = materialize(baseline.baseline_state(days.where(F.col("activity_date") < F.lit(last))), "state")
    day = days.where(F.col("activity_date") == F.lit(last))
    assert {f.split("activity_date=")[1][:10] for f in day.inputFiles()} >= {last.isoformat()}
    update = baseline.merge_states(state, baseline.baseline_state(day))
    plan = update._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(activity_date" in plan and last.isoformat() in plan
    assert same(baseline.baseline_from_state(update), baseline.user_baseline(history))


def alerts(spark, n, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        kind = rng.randrange(3)
        score = rng.choice((-0.2, -0.2, None, rng.random() / 1000, rng.uniform(-0.5, 0.3)))
        rows.append((f"U{k % 97}", dt.date(2024, 1, 1) + dt.timedelta(k // 97), *[int(kind == c) for c in range(3)], score, k))
    return spark.createDataFrame(rows, "user string, activity_date date, " + ", ".join(f"{c} int" for c in ALERT_COLUMNS) + ", iso_forest_raw_score double, _row int")


def test_split_is_the_head_of_the_order(spark):
    df = alerts(spark, 3000)
    ranked = explain_queue.severity(df).collect()
    order = sorted(ranked, key=lambda r: (r._level, r._score, r._digest, r.user, r.activity_date))
    want = [r._row for r in order]
    for limit in (0, 1, 7, 500, 1400, 2999, 3000, 9999):
        for some in (df, df.repartition(5)):
            first, rest = explain_queue.split(some, limit)
            assert first.columns == rest.columns == df.columns
            assert sorted(r._row for r in first.collect()) == sorted(want[:limit])
            assert sorted(r._row for r in rest.collect()) == sorted(want[limit:])
    with pytest.raises(ValueError):
        explain_queue.split(df, -1)


def test_later_runs_drain_the_overflow(spark):
    df, total, carried, explained = alerts(spark, 300), 300, None, []
    for _ in range(4):
        new = df if carried is None else df.limit(0)
        now, rest = explain_queue.next_run(new, carried, 90)
        explained += [tuple(r) for r in now.select(*KEY).collect()]
        carried = materialize(rest, "overflow")
    assert carried.isEmpty() and len(explained) == len(set(explained)) == total
    again, rest = explain_queue.next_run(df, materialize(df.limit(10), "old"), 1000)
    assert again.count() == total and rest.isEmpty()
