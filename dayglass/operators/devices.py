"""Daily features of removable devices, from connect and disconnect events.

The device log has (user, pc, activity, ts) with activity `Connect` or `Disconnect`; times
count in whole seconds. A session of a user at a machine runs from a connect to the next
event there, and is unclosed if that is another connect, or comes later than `cutoff`; it
then ends at that connect or after `cutoff`, whichever is first. Of events of one second a
disconnect goes first. A disconnect without an open session says nothing. Rows that lack a
user, machine, time or a known activity are left out.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dayglass.contract import KEY
from dayglass.functions.timing import within
from dayglass.operators.features import people

CONNECT, DISCONNECT = "Connect", "Disconnect"
CUTOFF = dt.timedelta(hours=12)
DAY = 86_400

DEVICE_FEATURES = (
    "device_sessions",
    "device_machines",
    "device_seconds",
    "device_overlap_seconds",
    "device_unclosed_sessions",
)


def _seconds(cutoff: dt.timedelta) -> int:
    seconds = int(cutoff.total_seconds())
    if not 0 < seconds <= DAY or seconds != cutoff.total_seconds():
        raise ValueError(f"cutoff must be whole seconds, more than none and at most a day, not {cutoff}")
    return seconds


def device_sessions(log: DataFrame, cutoff: dt.timedelta = CUTOFF) -> DataFrame:
    """Rows (user, pc, begins, ends, closed); begins and ends are seconds of wall time since 1970.

    A connect is only paired within `cutoff`, so events are grouped by user, machine and span
    of that length, and each span is shown the first event of the next. Repeated seconds
    collapse before the shuffle: a group has at most two rows a second of its span.
    """
    span = _seconds(cutoff)
    events = (
        people(log)
        .where(F.col("activity").isin(CONNECT, DISCONNECT) & F.col("pc").isNotNull() & F.col("ts").isNotNull())
        .select(
            "user", "pc", (F.col("activity") == CONNECT).alias("opens"),
            F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), "ts") / 1_000_000).alias("at"),
        )
        .distinct()
        .withColumn("span", F.floor(F.col("at") / span))
    )
    # false sorts before true: a disconnect goes first
    first = events.groupBy("user", "pc", "span").agg(F.min(F.struct("at", "opens")).alias("first"))
    shown = first.select("user", "pc", "first.opens", "first.at", (F.col("span") - 1).alias("span"), F.lit(True).alias("shown"))
    order = W.partitionBy("user", "pc", "span").orderBy("at", "opens")
    paired = events.withColumn("shown", F.lit(False)).unionByName(shown).select(
        "*", F.lead("at").over(order).alias("next_at"), F.lead("opens").over(order).alias("next_opens")
    )
    limit = F.col("at") + span
    return paired.where("opens AND NOT shown").select(
        "user",
        "pc",
        F.col("at").alias("begins"),
        F.least(limit, F.coalesce("next_at", limit)).alias("ends"),
        F.coalesce(~F.col("next_opens") & (F.col("next_at") <= limit), F.lit(False)).alias("closed"),
    )


def _day_of(second: str):
    return F.date_from_unix_date(F.floor(F.col(second) / DAY).cast("int"))


def split_at_midnight(sessions: DataFrame) -> DataFrame:
    """One row for each day that a session touches, with the part of it on that day.

    `begun` marks the day the session begins on; `closed` stays beside it.
    """
    days = F.sequence(F.floor(F.col("begins") / DAY), F.floor(F.greatest(F.col("ends") - 1, F.col("begins")) / DAY))
    return sessions.withColumn("day", F.explode(days)).select(
        "user",
        "pc",
        F.date_from_unix_date(F.col("day").cast("int")).alias("activity_date"),
        F.greatest("begins", F.col("day") * DAY).alias("begins"),
        F.least("ends", (F.col("day") + 1) * DAY).alias("ends"),
        (F.col("begins") >= F.col("day") * DAY).alias("begun"),
        "closed",
    )


def device_features(
    log: DataFrame, start: dt.date | None = None, end: dt.date | None = None, cutoff: dt.timedelta = CUTOFF
) -> DataFrame:
    """Daily device features of the days in [start, end).

    Sessions and unclosed ones count on the day they begin; machines, connected seconds and
    seconds with two or more machines at once on every day they touch. Events up to a cutoff
    outside of the window are read too, so a day's row doesn't depend on the window.
    """
    _seconds(cutoff)
    within(log, start, end)  # refuses other types than dates
    margin = -(-cutoff // dt.timedelta(days=1)) * dt.timedelta(days=1)
    sessions = device_sessions(within(log, start and start - margin, end and end + margin), cutoff)
    # one pass over the sessions: steps up and down by second, and a row for each machine
    zero, one = F.lit(0), F.lit(1)
    nowhere, never = F.lit(None).cast("string"), F.lit(None).cast("long")

    def mark(at, pc, step, begun=zero, unclosed=zero):
        columns = {"at": at, "pc": pc, "step": step, "begun": begun, "unclosed": unclosed}
        return F.struct(*[c.alias(n) for n, c in columns.items()])

    begun = F.col("begun").cast("int")
    marks = F.array(
        mark(F.col("begins"), nowhere, one, begun, F.when(F.col("closed"), zero).otherwise(begun)),
        mark(F.col("ends"), nowhere, -one),
        mark(never, F.col("pc"), zero),
    )
    # a user's day has at most a step a second, however many sessions it holds
    steps = (
        split_at_midnight(sessions)
        .select(*KEY, F.explode(marks).alias("m"))
        .select(*KEY, "m.*")
        .groupBy(*KEY, "at", "pc")
        .agg(*[F.sum(c).alias(c) for c in ("step", "begun", "unclosed")])
    )
    order = W.partitionBy(*KEY).orderBy("at")  # rows of machines, without a second, come first
    held = steps.select(
        "*",
        F.sum("step").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("open"),
        (F.lead("at").over(order) - F.col("at")).alias("lasts"),
    )
    lasting = lambda n: F.sum(F.when(F.col("open") >= n, F.col("lasts")))
    daily = held.groupBy(*KEY).agg(
        F.sum("begun").alias("device_sessions"),
        F.count("pc").alias("device_machines"),
        lasting(1).alias("device_seconds"),
        lasting(2).alias("device_overlap_seconds"),
        F.sum("unclosed").alias("device_unclosed_sessions"),
    )
    if start is not None:
        daily = daily.where(F.col("activity_date") >= F.lit(start))
    if end is not None:
        daily = daily.where(F.col("activity_date") < F.lit(end))
    return daily.select(*KEY, *[F.coalesce(f, F.lit(0)).cast("long").alias(f) for f in DEVICE_FEATURES])
