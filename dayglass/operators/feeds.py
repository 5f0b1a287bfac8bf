"""Web visits to the hosts of a threat feed.

A daily feed has rows (domain, verdict, listed_from, listed_to): from the day listed_from,
until the day before listed_to, the domain and all below it are `block`ed or `allow`ed.
A missing listed_from has always been, a missing listed_to is still open, a missing
verdict blocks. Of the entries that cover a host on a day the longest domain decides, then
the latest listed_from, then block before allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayglass.contract import KEY, SYSTEM_ACCOUNT


def host(url: Column) -> Column:
    """Lower-case host of a URL; null where there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))
    return F.when(found != "", found)


def feed_hits(http_log: DataFrame, feed: DataFrame) -> DataFrame:
    """Rows (user, activity_date, feed_visits, feed_hosts) of user-days with a hit.

    `feed` has one column `host`. Visits are counted by user, day and host before the
    join, so a busy host is joined as one row a user-day.
    """
    listed = feed.select(F.lower("host").alias("host")).where("host is not null").distinct()
    visits = (
        http_log.where(F.col("user") != SYSTEM_ACCOUNT)
        .groupBy("user", F.to_date("ts").alias("activity_date"), host(F.col("url")).alias("host"))
        .agg(F.count("*").alias("n"))
    )
    return visits.join(listed, "host").groupBy(*KEY).agg(F.sum("n").alias("feed_visits"), F.count("*").alias("feed_hosts"))


#: Shares that rows of one host, or of one top-level domain, are dealt to before a join.
SALTS = 16
BLOCK, ALLOW = "block", "allow"


def user_host_days(http_log: DataFrame) -> DataFrame:
    """Visits as rows (user, activity_date, host, n); visits without a host are left out."""
    return (
        http_log.where(F.col("user") != SYSTEM_ACCOUNT)
        .groupBy("user", F.to_date("ts").alias("activity_date"), host(F.col("url")).alias("host"))
        .agg(F.count("*").alias("n"))
        .where("host IS NOT NULL AND activity_date IS NOT NULL")
    )


def _salted(few: DataFrame) -> DataFrame:
    """Every row once for each salt, to meet rows that were dealt by a hash."""
    return few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _salt(name: str) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(SALTS)).cast("int").alias("salt")


def listed(feed: DataFrame) -> DataFrame:
    """The feed's entries in one form: lower-case domains without dots at their ends."""
    domain = F.trim(F.lower(F.trim("domain")), F.lit("."))
    entries = feed.select(
        domain.alias("domain"),
        F.coalesce(F.lower("verdict"), F.lit(BLOCK)).alias("verdict"),
        F.col("listed_from").cast("date").alias("listed_from"),
        F.col("listed_to").cast("date").alias("listed_to"),
    )
    return entries.where("domain <> ''").distinct()


def blocked_host_days(host_days: DataFrame, feed: DataFrame) -> DataFrame:
    """The rows (host, activity_date) that the feed blocks on that day.

    Each host is looked up by its suffixes, so the join is one of equal domains. All hosts
    share a few last labels: suffixes are dealt by host to SALTS shares, the feed is repeated.
    """
    labels = F.split(F.trim("host", F.lit(".")), r"\.")
    cut = F.sequence(F.lit(1), F.size("labels"))
    suffixes = (
        host_days.select("host", "activity_date").distinct()
        .withColumn("labels", labels)
        .withColumn("domain", F.explode(F.transform(cut, lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))))
        .select("host", "activity_date", "domain", _salt("host"))
    )
    day = F.col("activity_date")
    held = (F.col("listed_from").isNull() | (F.col("listed_from") <= day)) & (
        F.col("listed_to").isNull() | (day < F.col("listed_to"))
    )
    rank = F.struct(F.length("domain"), F.coalesce("listed_from", F.lit("0001-01-01").cast("date")), F.col("verdict") == BLOCK)
    return (
        suffixes.join(_salted(listed(feed)), ["domain", "salt"])
        .where(held)
        .groupBy("host", "activity_date")
        .agg(F.max_by("verdict", rank).alias("verdict"))
        .where(F.col("verdict") == BLOCK)
        .select("host", "activity_date")
    )


def feed_matches(http_log: DataFrame, feed: DataFrame) -> DataFrame:
    """Rows (user, activity_date, feed_visits, feed_hosts) of user-days with blocked visits.

    Only distinct (host, day) meet the feed. Visits, counted by user, day and host, then meet
    the blocked ones, dealt by user, so a host that everyone visits is no single key.
    """
    visits = user_host_days(http_log)
    blocked = _salted(blocked_host_days(visits, feed))
    hits = visits.withColumn("salt", _salt("user")).join(blocked, ["host", "activity_date", "salt"])
    return hits.groupBy(*KEY).agg(F.sum("n").alias("feed_visits"), F.count("*").alias("feed_hosts"))
