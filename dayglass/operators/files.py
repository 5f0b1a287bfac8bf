"""Daily features of file activity, with counts over the days before.

The file log has (user, filename, ts). A file is its whole name in lower case, a folder what
stands before the last / or \\, an extension what follows the last dot of the rest (none:
empty text). Rows without a user, a name or a time are left out.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dayglass.contract import KEY
from dayglass.functions.timing import within
from dayglass.operators.features import people

DAYS = 7  # a file is new if it wasn't seen on the days before that a span of so many holds

FILE_FEATURES = (
    "file_events",
    "distinct_files",
    "new_files",
    "new_folders",
    "rolling_files",
    "extension_entropy",
)
KINDS = ("file", "folder")
ENTROPY_DIGITS = 9


def _folder(name: Column) -> Column:
    return F.regexp_extract(name, r"^(.*)[/\\]", 1)


def _extension(name: Column) -> Column:
    return F.regexp_extract(name, r"\.([^./\\]*)$", 1)


def item_days(log: DataFrame) -> DataFrame:
    """Rows (user, kind, item, activity_date, n): a user's files and folders by day."""
    named = people(log).where("filename IS NOT NULL AND ts IS NOT NULL")
    name = F.lower("filename")
    files = named.groupBy("user", name.alias("item"), F.to_date("ts").alias("activity_date")).agg(F.count("*").alias("n"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), i.alias("item")) for k, i in zip(KINDS, (F.col("item"), _folder(F.col("item"))))])
    return (
        files.select("user", "activity_date", "n", F.explode(kinds).alias("k"))
        .groupBy("user", "k.kind", "k.item", "activity_date")
        .agg(F.sum("n").alias("n"))
    )


def last_seen(days: DataFrame) -> DataFrame:
    """What new days need of the days before them: rows (user, kind, item, activity_date).

    States of different spans merge by the latest day, in any order and repeatedly.
    """
    return days.groupBy("user", "kind", "item").agg(F.max("activity_date").alias("activity_date"))


def merge_seen(state: DataFrame, other: DataFrame, today: dt.date | None = None, days: int = DAYS) -> DataFrame:
    """The state of both spans; without what no day from `today` on looks back to."""
    merged = last_seen(state.unionByName(other))
    return merged if today is None else merged.where(F.col("activity_date") > F.date_sub(F.lit(today), days))


def file_features(
    log: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
    days: int = DAYS,
    seen: DataFrame | None = None,
) -> DataFrame:
    """Daily file features of the days in [start, end).

    A file (or folder) is new on a day if none of the user's days - 1 days before has it.
    rolling_files counts the distinct files of a span of `days` that ends on the day: a file
    adds one when it is new, and takes it back `days` after it was last seen, so the count is
    a running sum and holds no sets. `seen` is the state of the days before `start` (of a whole span);
    without it they are read from the log. A user without events on a day has no row.
    """
    if days < 1:
        raise ValueError(f"days must be at least 1, not {days}")
    if seen is not None and start is None:
        raise ValueError("a state of earlier days needs a start")
    within(log, start, end)  # refuses other types than dates
    first = start if start is None or seen is not None else start - dt.timedelta(days - 1)
    found = item_days(within(log, first, end))
    if seen is not None:
        before = seen.where((F.col("activity_date") < F.lit(start)) & (F.col("activity_date") > F.date_sub(F.lit(start), days)))
        found = found.unionByName(before.select("user", "kind", "item", "activity_date", F.lit(0).cast("long").alias("n")))
    order = W.partitionBy("user", "kind", "item").orderBy("activity_date")
    on = F.col("activity_date")
    before, after = F.lag(on).over(order), F.lead(on).over(order)
    marked = found.select(
        "*",
        F.coalesce(F.datediff(on, before) >= days, F.lit(True)).alias("new"),
        F.coalesce(F.datediff(after, on) >= days, F.lit(True)).alias("leaves"),
    )
    is_file, is_folder = F.col("kind") == "file", F.col("kind") == "folder"
    used = is_file & (F.col("n") > 0)
    one = lambda condition: F.when(condition, 1).otherwise(0)
    # one pass over the marked items: what a day counts, and what leaves the span on a later day
    today = F.struct(
        on.alias("activity_date"),
        F.when(used, _extension(F.col("item"))).alias("extension"),
        F.when(used, F.col("n")).alias("n"),
        one(is_file).alias("files"),
        one(is_file & F.col("new")).alias("new_files"),
        one(is_folder & F.col("new")).alias("new_folders"),
        one(is_file & F.col("new")).alias("step"),
    )
    later = F.struct(
        F.date_add(on, days).alias("activity_date"),
        F.lit(None).cast("string").alias("extension"),
        F.lit(None).cast("long").alias("n"),
        *[F.lit(0).alias(c) for c in ("files", "new_files", "new_folders")],
        F.lit(-1).alias("step"),
    )
    sums = ("n", "files", "new_files", "new_folders", "step")
    mixed = (
        marked.select("user", F.explode(F.when(is_file & F.col("leaves"), F.array(today, later)).otherwise(F.array(today))).alias("s"))
        .select("user", "s.*")
        .groupBy(*KEY, "extension").agg(*[F.sum(c).alias(c) for c in sums])
    )
    daily = (
        mixed.groupBy(*KEY).agg(
            # the order of a sum changes its last bits; equal mixes must have equal values
            F.round(F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n"), ENTROPY_DIGITS).alias("extension_entropy"),
            *[F.sum(c).alias(c) for c in sums],
        )
        .withColumn("rolling_files", F.sum("step").over(W.partitionBy("user").orderBy("activity_date")))
        .where("n IS NOT NULL")
        .withColumnsRenamed({"n": "file_events", "files": "distinct_files"})
    )
    if start is not None:
        daily = daily.where(on >= F.lit(start))
    return daily.select(*KEY, *FILE_FEATURES)
