"""Inputs the catalog queries share: logs, matrices and a model with a literal forest."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from catalog import ctes as C
from dayglass.contract import FEATURES, Params
from dayglass.functions.trees import Forest
from dayglass.operators import baseline, devices, files, flags
from dayglass.operators import forest as IF
from dayglass.plans import detect
from dayglass.plans.model import Model, Thresholds, score, self_scored
from dayglass.sources import activity
from dayglass.sources.store import materialize

PARAMS = Params(min_history_days=C.MIN_HISTORY)


def stump_rows(features: Sequence[str] = FEATURES) -> list[tuple]:
    """One small tree per feature: its cover counts follow a rule, so SQL can restate it."""
    rows = []
    for i, f in enumerate(features):
        left, middle, right = C.stump_counts(i)
        rows += [
            (i, 0, f, 0.5 + i / 10, 256),
            (i, 1, None, None, left),
            (i, 2, f, 2 + i / 10, middle + right),
            (i, 5, None, None, middle),
            (i, 6, None, None, right),
        ]
    return rows


class World:
    """Everything is derived from the tables in `sf_dir`, on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str, params: Params = PARAMS, feed: DataFrame | None = None, wide: bool = False):
        self.spark, self.dir, self.params, self.feed, self.wide = spark, sf_dir, params, feed, wide

    def table(self, name: str) -> DataFrame:
        return activity.read_table(self.spark, self.dir, name)

    @cached_property
    def logs(self):
        return activity.logs(self.spark, self.dir)

    def sources(self, window=(None, None)) -> dict[str, DataFrame]:
        return detect.source_features(self.logs, window, activity.KEYWORDS)

    def more(self, window) -> dict[str, DataFrame]:
        """The device and file features of a window."""
        return {
            "device": devices.device_features(activity.device_log(self.spark, self.dir), *window),
            "file": files.file_features(activity.file_log(self.spark, self.dir), *window),
        }

    def fused(self, window=(None, None), **options) -> DataFrame:
        if self.wide:
            options = {"more": self.more(window), "unknown": ["extension_entropy"], **options}
        return detect.matrix(self.logs, window, activity.KEYWORDS, self.feed, **options)

    @cached_property
    def history(self) -> DataFrame:
        """Written once: the baselines, the population and the training scores read it."""
        return materialize(self.fused(activity.HISTORY), "history")

    @cached_property
    def live(self) -> DataFrame:
        return self.fused(activity.LIVE)

    @cached_property
    def baseline(self) -> DataFrame:
        return baseline.user_baseline(self.history, self.params)

    @cached_property
    def population(self) -> dict:
        return baseline.fetch_global(baseline.global_baseline(self.history, self.params))

    def z(self, df: DataFrame) -> DataFrame:
        routed = baseline.routed(df, self.baseline, self.population, self.params)
        return baseline.with_self_scores(routed, self.params)

    def flagged(self, df: DataFrame) -> DataFrame:
        return flags.with_flags(self.z(df), self.params)

    @cached_property
    def model(self) -> Model:
        table = self.spark.createDataFrame(stump_rows(self.params.features), IF.FOREST_SCHEMA)
        forest = IF.load_forest(table, 256, self.params.features)
        return Model(
            params=self.params,
            baseline=self.baseline,
            population=self.population,
            scaling=None,
            forest=forest,
            forest_table=table,
            thresholds=Thresholds(C.CRITICAL, C.ISO_THRESHOLD, C.OFFSET, C.FILL),
            version="stump",
        )

    @cached_property
    def scores(self) -> DataFrame:
        return score(self.live, self.model)

    def raw(self, df: DataFrame) -> DataFrame:
        ready = self_scored(df, self.model)
        return ready.select(IF.raw_score(ready, self.model.forest).alias("raw"))

    def alerts(self, top_n: int = 5, direction: str = "signed") -> DataFrame:
        live = materialize(self.live, "live")  # scored and read again for the raw values
        scores = score(live, self.model)
        return detect.explain(scores, live, self.model, top_n=top_n, direction=direction)

    @property
    def labels(self) -> DataFrame:
        return activity.labels(self.spark, self.dir)
