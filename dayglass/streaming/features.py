"""User-day features from log streams, one row per user and day once the day is closed.

All logs become one stream of small counters by (user, day, source, item), where the item is
what is counted distinct (machine, url). Three stateful steps follow one another in append
mode under one watermark:

1. sign-ins are deduplicated by (user, pc, activity, five-minute bucket);
2. counters are added up by (day, user, source, item);
3. items and counters are added up by (day, user).

So no state holds a set that grows with a user's activity, and every step adds up before its
shuffle. A day is closed when the watermark (the smallest of the logs' latest event times,
less `delay`) has passed its end; its state is dropped then. Rows older than the watermark
are dropped, too, and counted by Spark (numRowsDroppedByWatermark): a day, once written, does
not change. A log that falls silent holds all days open.

The functions also take batch logs; then every day is closed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayglass.contract import FEATURES, KEY, SOURCES
from dayglass.functions.text import like_any, list_size
from dayglass.functions.timing import outside_hours, weekend
from dayglass.operators.features import FAILED, INTERNAL_DOMAIN, KEYWORDS, LARGE_MAIL_BYTES, UPLOADS, people
from dayglass.operators.fusion import fill_silent

DAY = "1 day"
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
_FIVE_MINUTES = 300_000_000


def _micros(ts: str) -> str:
    """Wall-clock microseconds: the session's time zone plays no part."""
    return f"timestampdiff(MICROSECOND, {_EPOCH}, {ts})"


def read_log(spark: SparkSession, path: str, schema: T.StructType, files: int = 1000) -> DataFrame:
    """A typed log as a stream of Parquet files, at most `files` new ones a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def _one(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0).cast("bigint")


def logon_counters(log: DataFrame, delay: str) -> DataFrame:
    activity = F.col("activity")
    bucket = F.expr(f"{_micros('ts')} - pmod({_micros('ts')}, {_FIVE_MINUTES})")
    relevant = people(log).where(activity.isin("Logon", "Logoff") | like_any(activity, FAILED))
    once = (
        relevant.select("user", "pc", "activity", F.timestamp_micros(bucket).alias("event_time"))
        .withWatermark("event_time", delay)
        .dropDuplicates(["user", "pc", "activity", "event_time"])
    )
    at = F.expr(f"timestampadd(MICROSECOND, unix_micros(event_time), {_EPOCH})")
    return once.select(
        "user",
        "event_time",
        F.lit("logon").alias("source"),
        F.col("pc").alias("item"),
        F.lit(1).cast("bigint").alias("total_event_buckets"),
        _one(weekend(at) | outside_hours(at)).alias("off_hours"),
        _one(like_any(activity, FAILED)).alias("failed"),
        (_one(activity == "Logon") - _one(activity == "Logoff")).alias("active_orphan_sessions"),
    )


def http_counters(log: DataFrame, delay: str, keywords: Sequence[str]) -> DataFrame:
    url = F.col("url")
    return people(log).select(
        "user",
        F.expr(f"timestamp_micros({_micros('ts')})").alias("event_time"),
        F.lit("http").alias("source"),
        url.alias("item"),
        _one(url.isNotNull()).alias("url_visits"),
        _one(like_any(F.col("activity"), UPLOADS)).alias("upload_event_count"),
        _one(like_any(url, keywords)).alias("keyword_match_indicator"),
        _one(outside_hours(F.col("ts"))).alias("after_hours_browsing"),
    ).withWatermark("event_time", delay)


def email_counters(log: DataFrame, delay: str) -> DataFrame:
    return people(log).select(
        "user",
        F.expr(f"timestamp_micros({_micros('ts')})").alias("event_time"),
        F.lit("email").alias("source"),
        F.lit(None).cast("string").alias("item"),
        F.lit(1).cast("bigint").alias("emails_sent"),
        _one(~F.col("recipient").ilike(f"%@{INTERNAL_DOMAIN}%")).alias("external_recipients"),
        _one(outside_hours(F.col("ts"))).alias("after_hours_emails"),
        list_size(F.col("attachment_count")).cast("bigint").alias("attachments_sent"),
        _one(F.round(F.col("email_size").try_cast("double")) > LARGE_MAIL_BYTES).alias("large_attachment_count"),
    ).withWatermark("event_time", delay)


COUNTERS = (
    "total_event_buckets", "off_hours", "failed", "active_orphan_sessions",
    "url_visits", "upload_event_count", "keyword_match_indicator", "after_hours_browsing",
    "emails_sent", "external_recipients", "after_hours_emails", "attachments_sent", "large_attachment_count",
)


def stacked_days(logs: Mapping[str, DataFrame], delay: str = DAY, keywords: Sequence[str] = KEYWORDS) -> DataFrame:
    """user, activity_date, the features of the given logs and has_<source>, as stack_sources gives them.

    `logs` holds any of logon, http and email. A silent source's features are null, but only
    in the row of a closed day.
    """
    make = {
        "logon": lambda log: logon_counters(log, delay),
        "http": lambda log: http_counters(log, delay, keywords),
        "email": lambda log: email_counters(log, delay),
    }
    unknown = set(logs) - set(make)
    if unknown or not logs:
        raise ValueError(f"logs are logon, http and email, not {sorted(unknown) or 'none'}")
    parts = [make[name](logs[name]) for name in SOURCES if name in logs]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    counters = [c for c in COUNTERS if c in rows.columns]
    by_item = rows.groupBy(F.window("event_time", DAY), "user", "source", "item").agg(*[F.sum(c).alias(c) for c in counters])
    item = lambda name: _one((F.col("source") == name) & F.col("item").isNotNull())
    by_day = by_item.groupBy(F.window("window", DAY).alias("day"), "user").agg(
        *[F.sum(c).alias(c) for c in counters],
        F.sum(item("logon")).alias("pcs"),
        F.sum(item("http")).alias("urls"),
        *[F.max(F.col("source") == s).alias(f"has_{s}") for s in SOURCES],
    )
    value = {c: F.col(c) for c in counters}
    value["off_hours_ratio"] = F.col("off_hours") / F.col("total_event_buckets") if "logon" in logs else None
    value["failed_login_ratio"] = F.col("failed") / F.col("total_event_buckets") if "logon" in logs else None
    value["unique_systems_accessed"] = F.when(F.col("has_logon"), F.col("pcs"))
    value["unique_external_domains"] = F.when(F.col("has_http"), F.col("urls"))
    wanted = [f for s, features in SOURCES.items() if s in logs for f in features]
    date = F.expr("date_add(DATE'1970-01-01', cast(floor(unix_micros(day.start) / 86400000000) as int))")
    return by_day.select(
        "user", date.alias("activity_date"), *[value[f].cast("double").alias(f) for f in wanted], *[f"has_{s}" for s in SOURCES]
    )


def daily_matrix(logs: Mapping[str, DataFrame], delay: str = DAY, keywords: Sequence[str] = KEYWORDS) -> DataFrame:
    """The fused matrix of closed days from all three logs, with the nulls and zeros of `fuse`."""
    missing = set(SOURCES) - set(logs)
    if missing:
        raise ValueError(f"the matrix needs all logs; missing: {sorted(missing)}")
    return fill_silent(stacked_days(logs, delay, keywords)).select(*KEY, *FEATURES)


def write_days(days: DataFrame, path: str, checkpoint: str, **trigger):
    """Append closed days to a Parquet table, each row once also after a restart. Returns the query."""
    return (
        days.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )
