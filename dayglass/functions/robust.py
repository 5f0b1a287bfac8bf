"""Robust statistics as SQL expressions over column names."""

from __future__ import annotations

# Fixed values of the method.
NORMAL_QUARTILE = 0.6744897501960817  # divides a raw MAD to the normal scale
Z_FACTOR = 0.6745
NO_SCALE_SCORE = 10.0  # population mode: above the median of a column without spread


def sorted_quantile(values: str, p: float) -> str:
    """Linear-interpolation quantile of an ascending array; null when it is empty."""
    pos = f"((size({values}) - 1) * {p!r}D)"
    low = f"get({values}, int(floor({pos})))"
    high = f"get({values}, int(ceil({pos})))"
    return f"({low} + ({high} - {low}) * ({pos} - floor({pos})))"


def absolute_deviations(values: str, center: str) -> str:
    return f"array_sort(transform({values}, v -> abs(v - {center})))"


def self_score(x: str, threshold: float) -> str:
    """Robust z of column `x` against its <x>_median, _mad and _p95; null stays null.

    A zero MAD has no scale: if p95 equals the median every other value is an
    outlier, else only values above p95 are.
    """
    outlier = f"{float(threshold) + 1.0!r}D"
    return f"""CASE
        WHEN {x} IS NULL THEN NULL
        WHEN {x}_mad <> 0 THEN abs({Z_FACTOR}D * ({x} - {x}_median) / {x}_mad)
        WHEN {x}_p95 = {x}_median THEN IF({x} <> {x}_median, {outlier}, 0D)
        ELSE IF({x} > {x}_p95, {outlier}, 0D) END"""


def population_score(x: str, median: float, mad: float) -> str:
    """Robust z of the population mode; unobserved counts as zero."""
    value = f"coalesce({x}, 0D)"
    if mad != 0:
        return f"abs({Z_FACTOR}D * ({value} - {median!r}D) / {mad!r}D)"
    return f"IF({value} > {median!r}D, {NO_SCALE_SCORE}D, 0D)"
