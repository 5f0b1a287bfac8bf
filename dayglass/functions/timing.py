"""Event-time expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayglass.contract import EVENT_TIME_FORMAT

OPEN_HOUR, CLOSE_HOUR = 6, 18  # fixed values: working hours 06:00-18:00


def event_time(text: Column, strict: bool = True) -> Column:
    """Parse the log timestamp; strict aborts on a bad one, otherwise it becomes null."""
    if strict:
        return F.to_timestamp_ntz(text, F.lit(EVENT_TIME_FORMAT))
    return F.try_to_timestamp(text, F.lit(EVENT_TIME_FORMAT)).cast("timestamp_ntz")


def five_minutes(ts: Column) -> Column:
    """Start of the five-minute bucket holding `ts`."""
    return F.window(ts, "5 minutes").getField("start")


def outside_hours(ts: Column) -> Column:
    return (F.hour(ts) < OPEN_HOUR) | (F.hour(ts) >= CLOSE_HOUR)


def weekend(ts: Column) -> Column:
    return F.dayofweek(ts).isin(1, 7)


def within(df: DataFrame, start: dt.date | None, end: dt.date | None, ts: str = "ts") -> DataFrame:
    """Half-open window [start, end); either end may be missing."""
    for name, day in (("start", start), ("end", end)):
        if day is not None and not isinstance(day, dt.date):
            raise TypeError(f"{name} must be a datetime.date, not {type(day).__name__}")
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col(ts) < F.lit(end).cast("timestamp_ntz"))
    return df


def iso_date(text: str) -> dt.date:
    """Parse a YYYY-MM-DD argument, refusing every other shape."""
    day = dt.date.fromisoformat(text)
    if day.isoformat() != text:
        raise ValueError(f"{text!r} is not YYYY-MM-DD")
    return day
