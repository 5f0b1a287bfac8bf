"""Exact quantiles of a whole column without gathering it in one task.

Equal values are counted first, so a value that makes up a third of all rows is one
row after the map side. A logarithmic histogram of those counts (relative bin width
1e-5) is small whatever the data size; its running sum tells which bins hold the
wanted ranks, and only those bins are sorted, each in its own task. The counted
values feed both steps from the same shuffle, so the input is read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS_PER_E = 100_000
_ZERO = 75_000_000  # above |ln| of the smallest double times BINS_PER_E
_END = 2**62  # the bins of the infinities
_SIZE = f"IF(abs(same) = double('inf'), {_END}L, bigint(floor(ln(abs(same)) * {BINS_PER_E})) + {_ZERO}L)"
_BIN = f"CASE WHEN same > 0 THEN {_SIZE} WHEN same < 0 THEN -({_SIZE}) ELSE 0L END"


def even_grid(points: int) -> list[float]:
    return [i / (points - 1) for i in range(points)]


def _hits(probs: Sequence[float]) -> str:
    """SQL array of (i, upper): the wanted ranks inside [before, before + n).

    Every probability has two ranks, the floor and the ceiling of its position.
    """
    last = len(probs) - 1
    if len(probs) > 16 and list(probs) == even_grid(len(probs)):
        # evenly spaced: the indices that can fall here follow from the range
        scale = f"({last}D / greatest(total - 1, 1))"
        near = f"sequence(greatest(int(floor((before - 1) * {scale})), 0), least(int(ceil((before + n) * {scale})), {last}))"
        sides = [
            f"transform(filter({near}, i -> {side}(i / {last}D * (total - 1)) BETWEEN before AND before + n - 1), i -> struct(i AS i, {upper} AS upper))"
            for upper, side in enumerate(("floor", "ceil"))
        ]
        return f"concat({sides[0]}, {sides[1]})"
    wanted = [
        f"IF({side}({p!r}D * (total - 1)) BETWEEN before AND before + n - 1, struct({i} AS i, {upper} AS upper), NULL)"
        for i, p in enumerate(probs)
        for upper, side in enumerate(("floor", "ceil"))
    ]
    return f"array_compact(array({', '.join(wanted)}))"


def quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """Linear-interpolation quantiles per group: rows (by..., n, quantiles array<double>).

    Nulls and NaN are skipped; a group without values has no row. Infinities are the
    smallest and greatest values; between one and a finite value lies the infinity.
    With `weight`, a row stands for that many equal ones.
    """
    probs = [float(p) for p in probs]
    keys = list(by) or ["_all"]
    key_sql = ", ".join(keys)
    if not by:
        df = df.withColumn("_all", F.lit(0))
    hits = _hits(probs)
    number = f"nullif(double({value}) + 0D, double('NaN'))"
    counted = (
        df.groupBy(*keys, F.expr(number).alias("v"))
        # `same` is v again, but as an aggregate: conditions on it stay above the counting
        # and are not rewritten in terms of the input
        .agg((F.sum(weight) if weight else F.count("*")).alias("n"), F.max(F.expr(number)).alias("same"))
        .where("same IS NOT NULL")
        .select(*keys, "v", "n", F.expr(_BIN).alias("bin"))
        # stated here so that both uses below keep one plan and share its shuffle
        .where("bin IS NOT NULL")
    )
    in_order = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    bins = (
        counted.groupBy(*keys, "bin")
        .agg(F.sum("n").alias("n"))
        .selectExpr(
            "*",
            f"coalesce(sum(n) OVER (PARTITION BY {key_sql} ORDER BY bin {in_order}), 0) AS before",
            f"sum(n) OVER (PARTITION BY {key_sql}) AS total",
        )
        .where(f"size({hits}) > 0")
        .select(*keys, "bin", F.col("before").alias("bin_before"), "total")
    )
    picked = (
        counted.join(bins, [*keys, "bin"])
        .selectExpr(
            "*",
            f"bin_before + coalesce(sum(n) OVER (PARTITION BY {key_sql}, bin ORDER BY v {in_order}), 0) AS before",
        )
        .selectExpr(*keys, "total", "v", f"explode({hits}) AS hit")
        .groupBy(*keys, "total")
        # two entries per probability
        .agg(F.expr("array_sort(collect_list(struct(hit.i, hit.upper, v))).v").alias("e"))
    )
    p_sql = ", ".join(f"{p!r}D" for p in probs)
    low, high = "get(e, 2 * i)", "get(e, 2 * i + 1)"
    between = f"{low} + ({high} - {low}) * (p * (total - 1) - floor(p * (total - 1)))"
    value_at = f"IF({low} IN ({high}, double('-inf')), {low}, {between})"
    return picked.selectExpr(
        *by, "total AS n", f"transform(array({p_sql}), (p, i) -> {value_at}) AS quantiles"
    )
