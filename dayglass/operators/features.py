"""Daily features per user from the three logs.

Every grouping pre-aggregates on the map side, and the distinct counts go through
a (user, day, value) grouping first, so one very active user-day reaches its last
task as at most one small row per upstream task.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayglass.contract import KEY, SYSTEM_ACCOUNT
from dayglass.functions.text import like_any, list_size
from dayglass.functions.timing import five_minutes, outside_hours, weekend, within
from dayglass.operators.feeds import feed_matches

# Match patterns and limits of the features.
FAILED = ("%fail%",)
UPLOADS = ("%upload%", "%post%")
KEYWORDS = ("%wikileaks%", "%keylog%")
INTERNAL_DOMAIN = "dtaa.com"
LARGE_MAIL_BYTES = 1_000_000


def _share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def people(log: DataFrame) -> DataFrame:
    return log.where(F.col("user") != SYSTEM_ACCOUNT)


def logon_buckets(
    log: DataFrame, start: dt.date | None = None, end: dt.date | None = None
) -> DataFrame:
    """Distinct (user, pc, activity, five-minute bucket) of relevant sign-in events."""
    activity = F.col("activity")
    return (
        people(within(log, start, end))
        .where(activity.isin("Logon", "Logoff") | like_any(activity, FAILED))
        .select("user", "pc", "activity", five_minutes(F.col("ts")).alias("bucket"))
        .distinct()
    )


def logon_features(
    log: DataFrame, start: dt.date | None = None, end: dt.date | None = None
) -> DataFrame:
    """Sign-in features from (user, pc, activity, ts)."""
    bucket, activity = F.col("bucket"), F.col("activity")
    return (
        logon_buckets(log, start, end)
        .groupBy("user", F.to_date(bucket).alias("activity_date"))
        .agg(
            F.count("*").alias("total_event_buckets"),
            _share(weekend(bucket) | outside_hours(bucket)).alias("off_hours_ratio"),
            F.countDistinct("pc").alias("unique_systems_accessed"),
            _share(like_any(activity, FAILED)).alias("failed_login_ratio"),
            (F.count_if(activity == "Logon") - F.count_if(activity == "Logoff")).alias(
                "active_orphan_sessions"
            ),
        )
    )


def http_features(
    log: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
    keywords: Sequence[str] = KEYWORDS,
    feed: DataFrame | None = None,
) -> DataFrame:
    """Web features from (user, url, activity, ts).

    With a daily threat feed, the keyword indicator counts visits to hosts that it blocks on
    the day of the visit, and the keywords are not used.
    """
    url, ts = F.col("url"), F.col("ts")
    visits = people(within(log, start, end))
    daily = (
        visits
        .groupBy("user", F.to_date(ts).alias("activity_date"))
        .agg(
            F.count(url).alias("url_visits"),
            F.count_if(like_any(F.col("activity"), UPLOADS)).alias("upload_event_count"),
            F.count_if(like_any(url, keywords)).alias("keyword_match_indicator"),
            F.countDistinct(url).alias("unique_external_domains"),
            F.count_if(outside_hours(ts)).alias("after_hours_browsing"),
        )
    )
    if feed is None:
        return daily
    seen = feed_matches(visits, feed).select(*KEY, F.col("feed_visits").alias("hits"))
    joined = daily.join(seen, list(KEY), "left")
    return joined.withColumn("keyword_match_indicator", F.coalesce("hits", F.lit(0))).drop("hits")


def email_features(
    log: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
    internal_domain: str = INTERNAL_DOMAIN,
    attachment_mode: str = "list",
) -> DataFrame:
    """Mail features from (user, recipient, email_size, attachment_count, ts)."""
    ts = F.col("ts")
    size = F.col("email_size").try_cast("double")
    return (
        people(within(log, start, end))
        .groupBy("user", F.to_date(ts).alias("activity_date"))
        .agg(
            F.count("*").alias("emails_sent"),
            F.count_if(~F.col("recipient").ilike(f"%@{internal_domain}%")).alias("external_recipients"),
            F.count_if(outside_hours(ts)).alias("after_hours_emails"),
            F.sum(list_size(F.col("attachment_count"), attachment_mode).cast("long")).alias(
                "attachments_sent"
            ),
            F.count_if(F.round(size) > LARGE_MAIL_BYTES).alias("large_attachment_count"),
        )
    )
