"""Fusing the three sources into one row per user and day."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayglass.contract import FEATURES, KEY, SOURCES, UNKNOWN_IF_SILENT


def require_key(df: DataFrame, name: str) -> DataFrame:
    missing = [c for c in KEY if c not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks key column(s) {missing}; it has {df.columns}")
    return df


def align(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Key and the features in the given order; missing ones are null."""
    have = set(df.columns)
    return require_key(df, "table").select(
        *KEY,
        *[
            (F.col(f) if f in have else F.lit(None)).cast("double").alias(f)
            for f in features
        ],
    )


def further_features(more: Mapping[str, DataFrame]) -> dict[str, list[str]]:
    """Features of the sources beside the three: all columns but the key."""
    found = {name: [c for c in df.columns if c not in KEY] for name, df in more.items()}
    names = [*FEATURES, *[f for features in found.values() for f in features]]
    if len({n.lower() for n in names}) < len(names) or set(found) & set(SOURCES):
        raise ValueError(f"sources and features need different names, not {found}")
    return found


def stack_sources(
    logon: DataFrame, http: DataFrame, email: DataFrame, more: Mapping[str, DataFrame] = {}
) -> DataFrame:
    """Full outer union of the sources by key, nulls kept, with has_<source> markers.

    `more` holds further daily tables by name. One keyed aggregation over the union gives the rows of a three-way full outer
    join with one shuffle less.
    """
    parts, sources = [], {**SOURCES, **further_features(more)}
    for (name, features), df in zip(sources.items(), (logon, http, email, *more.values())):
        require_key(df, name)
        parts.append(df.select(*KEY, *features, F.lit(True).alias(f"has_{name}")))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.groupBy(*KEY).agg(
        *[F.max(f).cast("double").alias(f) for features in sources.values() for f in features],
        *[F.coalesce(F.max(f"has_{s}"), F.lit(False)).alias(f"has_{s}") for s in sources],
    )


def _filled(feature: str, mode: str, unknown: Mapping[str, str]) -> Column:
    value = F.col(feature)
    if mode == "blanket":
        return F.coalesce(value, F.lit(0.0))
    if feature in unknown:
        return F.when(F.col(f"has_{unknown[feature]}"), value)
    return F.coalesce(value, F.lit(0.0))


def fill_silent(
    stacked: DataFrame,
    fill: str = "by_role",
    keep_presence: bool = False,
    further: Mapping[str, Sequence[str]] = {},
    unknown: Sequence[str] = (),
) -> DataFrame:
    """Zeros and nulls of silent sources in a table with has_<source> markers; see fuse."""
    if fill not in ("by_role", "blanket"):
        raise ValueError(f"fill must be 'by_role' or 'blanket', not {fill!r}")
    present = [f"has_{s}" for s in (*SOURCES, *further)] if keep_presence else []
    source = {f: s for s, features in further.items() for f in features}
    if set(unknown) - set(source):
        raise ValueError(f"no further source has {sorted(set(unknown) - set(source))}")
    silent = {**UNKNOWN_IF_SILENT, **{f: source[f] for f in unknown}}
    return stacked.select(*KEY, *[_filled(f, fill, silent).alias(f) for f in (*FEATURES, *source)], *present)


def fuse(
    logon: DataFrame,
    http: DataFrame,
    email: DataFrame,
    fill: str = "by_role",
    keep_presence: bool = False,
    more: Mapping[str, DataFrame] = {},
    unknown: Sequence[str] = (),
) -> DataFrame:
    """The master matrix.

    `more` holds further daily tables by source name; their columns follow the fifteen
    features, and those in `unknown` are null rather than zero where their source is silent.

    fill "by_role": a silent source means zero for counts and unknown (null) for the
    ratio-like columns. fill "blanket": zero everywhere (the population mode).
    """
    return fill_silent(stack_sources(logon, http, email, more), fill, keep_presence, further_features(more), unknown)


def null_audit(df: DataFrame) -> DataFrame:
    """Null count of every feature column: rows (feature, nulls)."""
    features = [f for f in FEATURES if f in df.columns]
    counted = df.agg(*[F.count_if(F.col(f).isNull()).alias(f) for f in features])
    return counted.unpivot([], features, "feature", "nulls")


def require_nulls(df: DataFrame) -> int:
    """The gate before scoring: without any null the fusion has hidden missing telemetry."""
    total = null_audit(df).agg(F.sum("nulls").alias("n")).first()["n"] or 0
    if total == 0:
        raise ValueError("no null survived the fusion: missing telemetry is not visible")
    return total


def source_days(df: DataFrame) -> DataFrame:
    return require_key(df, "table").select(*KEY).distinct()


def coverage_counts(logon: DataFrame, http: DataFrame, email: DataFrame) -> DataFrame:
    """User-days per source: rows (source, user_days)."""
    parts = [
        source_days(df).agg(F.count("*").alias("user_days")).select(F.lit(n).alias("source"), "user_days")
        for n, df in (("logon", logon), ("http", http), ("email", email))
    ]
    return reduce(DataFrame.union, parts)


def coverage_gaps(logon: DataFrame, http: DataFrame, email: DataFrame) -> DataFrame:
    """User-days of one source that another lacks: rows (source, lacking, user_days)."""
    pairs = (
        ("http", http, "logon", logon),
        ("email", email, "logon", logon),
        ("logon", logon, "http", http),
        ("logon", logon, "email", email),
    )
    parts = [
        a.select(*KEY)
        .join(b.select(*KEY), list(KEY), "left_anti")
        .distinct()
        .agg(F.count("*").alias("user_days"))
        .select(F.lit(a_name).alias("source"), F.lit(b_name).alias("lacking"), "user_days")
        for a_name, a, b_name, b in pairs
    ]
    return reduce(DataFrame.union, parts)
