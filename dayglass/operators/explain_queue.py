"""A bounded number of alerts to explain each run, the most severe first, none lost.

The cut is found by counting, not by sorting all alerts: severities are counted in bins,
the bin that holds the cut is counted again in finer bins, and only the alerts of the last
one are numbered. What does not fit is a table that the next run takes up again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dayglass.contract import ALERT_COLUMNS, KEY

#: Most severe first.
RANK = {name: k for k, name in enumerate(ALERT_COLUMNS)}
#: Scores within a millionth tie; ties are in the order of a digest of the key.
_SCORE = "bigint(round(coalesce(iso_forest_raw_score, 0D) * 1000000))"
_DIGEST = "md5(concat_ws('|', user, string(activity_date)))"


def severity(alerts: DataFrame) -> DataFrame:
    """`alerts` with the order keys _level (category), _score and _digest."""
    level = F.lit(len(RANK))
    for name, k in sorted(RANK.items(), key=lambda x: -x[1]):
        level = F.when(F.col(name) == 1, k).otherwise(level)
    return alerts.withColumns({"_level": level, "_score": F.expr(_SCORE), "_digest": F.expr(_DIGEST)})


#: Ever finer parts of the order; each has at most some thousand values within one value of those before.
STEPS = (
    ("_level", F.col),
    ("_wide", lambda _: F.expr("_score div 1000")),
    ("_fine", lambda _: F.col("_score")),
    ("_hash", lambda _: F.substring("_digest", 1, 3)),
)


def _step(order: int) -> Column:
    name, make = STEPS[order]
    return make(name).alias(name)


def split(alerts: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The `limit` most severe alerts and the rest; together they are `alerts`.

    A tie at the cut goes by the digest of the user-day, then by the user-day, so the split
    does not depend on the partitioning. At most a bin's few thousand counts reach the driver.
    """
    if limit < 0:
        raise ValueError("limit must not be negative")
    columns = alerts.columns
    ranked = severity(alerts)
    for k in range(1, len(STEPS)):
        ranked = ranked.withColumn(STEPS[k][0], _step(k))
    left = limit
    taken, here = F.lit(False), F.lit(True)
    for name, _ in STEPS:
        counts = ranked.where(here).groupBy(name).agg(F.count("*").alias("n")).orderBy(name).collect()
        edge = None
        for row in counts:
            if row["n"] > left:
                edge = row[name]
                break
            left -= row["n"]
        if edge is None:
            return ranked.where(taken | here).select(*columns), ranked.where(~(taken | here)).select(*columns)
        taken = taken | (here & (F.col(name) < F.lit(edge)))
        here = here & (F.col(name) == F.lit(edge))
    # alerts that share category, score and a 4096th of the digests
    order = W.partitionBy("_hash").orderBy("_digest", *KEY)
    numbered = ranked.where(here).withColumn("_place", F.row_number().over(order))
    first = numbered.where(F.col("_place") <= left).select(*columns)
    last = numbered.where(F.col("_place") > left).select(*columns)
    return ranked.where(taken).select(*columns).unionByName(first), ranked.where(~taken & ~here).select(*columns).unionByName(last)


def next_run(flagged: DataFrame, carried: DataFrame | None, limit: int) -> tuple[DataFrame, DataFrame]:
    """Alerts to explain now, and the overflow to store for the next run.

    `carried` is the stored overflow of the run before. A user-day that is flagged again
    counts once, with its new flags.
    """
    if carried is not None:
        flagged = flagged.unionByName(carried.join(flagged.select(*KEY), list(KEY), "left_anti"))
    return split(flagged, limit)
