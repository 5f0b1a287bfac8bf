"""Text expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def like_any(col: Column, patterns: Sequence[str]) -> Column:
    """Case-insensitive match of any LIKE pattern."""
    return reduce(lambda a, b: a | b, (col.ilike(p) for p in patterns))


def list_size(col: Column, mode: str = "list") -> Column:
    """Entries of a ';'-separated field; mode "count" reads the field as a number."""
    if mode == "count":
        return F.coalesce(col.try_cast("int"), F.lit(0))
    commas = F.length(col) - F.length(F.replace(col, F.lit(";")))
    return F.when(col.isNotNull() & (col != ""), commas + 1).otherwise(0)


def quoted(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fixed(value: str, digits: int, missing: str = "nan") -> str:
    """SQL for fixed-point text, ties to even."""
    shown = f"format_string('%.{digits}f', bround({value}, {digits}))"
    return f"IF({value} IS NULL, {quoted(missing)}, {shown})"


def sentence(pattern: str, *values: str) -> str:
    """SQL that fills the %s places of `pattern` with SQL values."""
    return f"format_string({', '.join([quoted(pattern), *values])})"
