import datetime as dt
from types import SimpleNamespace

from pyspark.sql import functions as F

from catalog import beyond


def test_a_larger_log_has_a_file_a_core_in_each_slice_and_is_made_once(spark, monkeypatch):
    monkeypatch.setattr(beyond, "FILES", 1)
    monkeypatch.setattr(beyond, "FILE_ROWS", 100, raising=False)
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def user(i):
        made.add(1)
        return f"U{i}"

    start = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")
    log = spark.range(2800).select(
        user(F.col("id") % 7).alias("user"), (start + F.make_dt_interval(F.col("id") % 28)).alias("ts"), F.col("id")
    )
    streams = beyond.replayed(SimpleNamespace(spark=spark, logs={"logon": log}), ["logon"])
    assert made.value == 2800
    days = []
    batches = streams["logon"].writeStream.trigger(availableNow=True).foreachBatch(
        lambda rows, _: days.append(rows.select(F.input_file_name().alias("file"), F.dayofmonth("ts").alias("d")).collect())
    ).start()
    assert batches.awaitTermination(300)
    files = max(1, min(spark.sparkContext.defaultParallelism, 28))
    assert [{r.d for r in rows} for rows in days] == [set(range(a, b)) for a, b in ((1, 8), (8, 15), (15, 22), (22, 29))]
    assert [len({r.file for r in rows}) for rows in days] == [files] * 4 and sum(map(len, days)) == 2800
