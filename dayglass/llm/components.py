"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayglass.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node of it) of every node of edges (a, b).

    Alternates large and small stars: each round every node's neighbours are linked to the
    smallest of them, until the edges are stars. A node's neighbours are never gathered,
    only their minimum, which is aggregated before the shuffle.
    """
    greatest, least = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    stars = stored(edges.where("a <> b").select(greatest, least).distinct(), "edges")
    state = None
    while True:
        both = stars.select("u", "v").union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = stored(large.distinct(), "edges")
        lowest = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(lowest, "u").select("u", "v", "low")
        small = small.select("u", F.col("low").alias("v")).union(
            small.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        )
        stars = stored(small.distinct(), "edges")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
