import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from catalog.world import World
from dayglass.contract import KEY, LOGON_FEATURES
from dayglass.functions.timing import within
from dayglass.plans import detect
from dayglass.plans.model import score
from dayglass.sources import activity
from dayglass.sources.store import existing, scratch_path
from dayglass.streaming import features as S
from dayglass.streaming import scoring

CUTS = [dt.date(2024, 1, d) for d in (1, 8, 15, 22)] + [dt.date(2024, 2, 1)]


@pytest.fixture(scope="module")
def logs(spark, sf):
    return activity.logs(spark, sf)


def write(log, path, low, high):
    within(log, low, high).coalesce(1).write.mode("append").parquet(path)


def drain(days, path):
    query = S.write_days(days, f"{path}/rows", f"{path}/checkpoint", availableNow=True)
    assert query.awaitTermination(300)
    return query


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_batch_logs_give_the_batch_matrix(logs):
    assert same(S.daily_matrix(logs, keywords=activity.KEYWORDS), detect.matrix(logs, (None, None), activity.KEYWORDS))
    with pytest.raises(ValueError, match="missing"):
        S.daily_matrix({"logon": logs["logon"]})
    with pytest.raises(ValueError, match="logs are"):
        S.stacked_days({"badge": logs["logon"]})


def test_restart_late_rows_and_bounded_state(spark, logs):
    path = scratch_path(spark, "restart")
    for k, log in logs.items():
        for low, high in zip(CUTS[:2], CUTS[1:3]):
            write(log, f"{path}/{k}", low, high)
    streams = {k: S.read_log(spark, f"{path}/{k}", log.schema, 1) for k, log in logs.items()}
    days = S.daily_matrix(streams, keywords=activity.KEYWORDS)
    drain(days, path)
    first = spark.read.parquet(f"{path}/rows").collect()
    assert first and max(r.activity_date for r in first) < dt.date(2024, 1, 14)

    # a sign-in of a day that is closed, beside the rows that come next
    late = logs["logon"].limit(1).select("user", F.lit("PC-late").alias("pc"), "activity", F.lit(dt.datetime(2024, 1, 3, 9)).cast("timestamp_ntz").alias("ts"))
    late.coalesce(1).write.mode("append").parquet(f"{path}/logon")
    for k, log in logs.items():
        for low, high in zip(CUTS[2:], CUTS[3:]):
            write(log, f"{path}/{k}", low, high)
    query = drain(S.daily_matrix(streams, keywords=activity.KEYWORDS), path)
    steps = [p["stateOperators"] for p in query.recentProgress]
    assert sum(s["numRowsDroppedByWatermark"] for p in steps for s in p) >= 1
    closed = spark.read.parquet(f"{path}/rows")
    last = closed.agg(F.max("activity_date")).first()[0]
    assert last > dt.date(2024, 1, 26)
    want = detect.matrix(logs, (None, None), activity.KEYWORDS).where(F.col("activity_date") <= F.lit(last))
    assert same(closed, want)  # every closed day once, the late row in none
    # what is left in state is what the open days hold
    open_ = within(logs["logon"], last + dt.timedelta(1), None).count()
    assert all(s["numRowsTotal"] <= 3 * open_ + 200 for s in steps[-1])
    assert sum(s["numRowsTotal"] for s in steps[-1]) < sum(s["numRowsTotal"] for s in max(steps, key=lambda p: sum(s["numRowsTotal"] for s in p))) / 2


def test_one_log_alone(spark, logs):
    only = S.stacked_days({"logon": logs["logon"]})
    want = detect.source_features(logs)["logon"]
    casts = [F.col(f).cast("double").alias(f) for f in LOGON_FEATURES]
    assert same(only.select(*KEY, *LOGON_FEATURES), want.select(*KEY, *casts))


@pytest.mark.parametrize("zone", ["America/New_York", "Pacific/Apia"])
def test_session_time_zone_plays_no_part(spark, logs, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    want = S.daily_matrix(logs).collect()
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        assert sorted(S.daily_matrix(logs).collect(), key=str) == sorted(want, key=str)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_scores_reload_and_repeat(spark, sf):
    w = World(spark, sf)
    path = scratch_path(spark, "scores")
    logs = w.logs
    with pytest.raises(ValueError, match="no model"):
        scoring.published_version(spark, f"{path}/models")
    scoring.publish(w.model, f"{path}/models")
    def run():
        streams = {k: S.read_log(spark, f"{path}/{k}", log.schema, 1) for k, log in logs.items()}
        days = S.daily_matrix(streams, keywords=activity.KEYWORDS)
        query = scoring.score_days(days, f"{path}/models", f"{path}/out", f"{path}/checkpoint", availableNow=True)
        assert query.awaitTermination(300)
        return scoring.read_scores(spark, f"{path}/out")

    for k, log in logs.items():
        write(log, f"{path}/{k}", CUTS[2], CUTS[3])
    before = run().collect()
    assert {r.model_version for r in before} == {"stump"}
    loose = replace(w.model.override(critical_flag_ratio=0.01), version="loose")
    scoring.publish(loose, f"{path}/models")
    for k, log in logs.items():
        write(log, f"{path}/{k}", CUTS[3], CUTS[4])
    after = run()
    assert {r.model_version for r in after.collect()} == {"stump", "loose"}
    last = after.agg(F.max("activity_date")).first()[0]
    matrix = detect.matrix(logs, (CUTS[2], last + dt.timedelta(1)), activity.KEYWORDS)
    for version, model in (("stump", w.model), ("loose", loose)):
        rows = after.where(F.col("model_version") == version).drop("query", "batch", "model_version")
        want = score(matrix, model).join(rows.select(*KEY), list(KEY), "left_semi")
        assert same(rows, want)
    assert after.count() == matrix.count()

    # the same batch once more: the same rows, not more
    batch = after.where("batch >= 0").agg(F.max("batch")).first()[0]
    folder = f"{path}/out/query=scores/batch={batch}"
    once = existing(spark, folder).collect()
    again = matrix.join(spark.createDataFrame(once).select(*KEY), list(KEY), "left_semi") if once else matrix.limit(0)
    models = scoring.PublishedModel(f"{path}/models")
    for _ in range(2):
        scoring.score_batch(again, batch, models, f"{path}/out", "scores")
    assert sorted(map(str, existing(spark, folder).collect())) == sorted(map(str, once))
