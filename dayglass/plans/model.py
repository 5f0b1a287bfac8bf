"""Fit, score, store and reload the detector."""

from __future__ import annotations

import json
import logging
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayglass.contract import ALERT_COLUMNS, FEATURES, KEY, Params
from dayglass.functions.trees import Forest
from dayglass.operators import baseline as B
from dayglass.operators import flags
from dayglass.operators import forest as IF
from dayglass.operators.fusion import align
from dayglass.operators.gates import feature_drift, numeric_columns, require_unique, validate
from dayglass.operators.quantiles import quantiles
from dayglass.sources.store import existing, materialize

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Thresholds:
    critical_flag_ratio: float
    iso_threshold: float
    iso_offset: float
    fill_value: float


@dataclass(frozen=True)
class Model:
    """A fitted detector: tables for what grows with users, constants for the rest."""

    params: Params
    baseline: DataFrame  # user, history_days, stats
    population: dict[str, dict[str, float]]
    scaling: dict[str, tuple[float, float]] | None
    forest: Forest
    forest_table: DataFrame
    thresholds: Thresholds
    score_points: list[float] = field(default_factory=list)
    version: str = ""

    @property
    def features(self) -> tuple[str, ...]:
        """The features it was fitted on, in order."""
        return self.params.features

    def override(self, **changes: float) -> Model:
        """Other thresholds or missing_data_tolerance without a refit."""
        ours = {k: v for k, v in changes.items() if hasattr(self.thresholds, k)}
        rest = {k: v for k, v in changes.items() if k not in ours}
        return replace(
            self, thresholds=replace(self.thresholds, **ours), params=replace(self.params, **rest)
        )


def fit(history: DataFrame, params: Params = Params(), version: str = "1") -> Model:
    """Learn baselines, thresholds and the forest from the history matrix.

    With `features=None` in the parameters, the features are the numeric columns of the history.
    """
    if params.features is None:
        params = replace(params, features=tuple(numeric_columns(history)))
    names = params.features
    feature_drift(history, names)
    history = validate(materialize(align(history, names), "history"), "history")
    rows = history.count()
    base = materialize(B.user_baseline(history, params), "baseline")
    population = B.fetch_global(B.global_baseline(history, params))
    # every history row is its user's own: the batch rule and the history rule agree here
    own = replace(params, route_on="history")
    z = materialize(
        flags.with_flags(B.with_self_scores(B.routed(history, base, population, own), own), own).select(
            *KEY, *[F.col(f"z_{f}").alias(f) for f in names], "mad_flag_ratio"
        ),
        "self-scores",
    )
    critical = flags.critical_ratio(z, params).first()["critical_flag_ratio"]
    fill_row = B.fill_value(z, names).first()
    fill = fill_row["fill_value"] if fill_row else 0.0
    scaling = {r["feature"]: (r["center"], r["scale"]) for r in B.scaling(z, fill, names).collect()}
    x = IF.model_input(z, fill, scaling, "", names)
    table = materialize(IF.fit_forest(x, rows, params), "forest")
    forest = IF.load_forest(table, min(params.subsample, rows), names)
    raw = materialize(x.select(IF.raw_score(x, forest).alias("raw")), "training-scores")
    offset, threshold, points = fit_iso_thresholds(raw, params)
    return Model(
        params=params,
        baseline=base,
        population=population,
        scaling=scaling,
        forest=forest,
        forest_table=table,
        thresholds=Thresholds(critical, threshold, offset, fill),
        score_points=points,
        version=version,
    )


def fit_iso_thresholds(raw: DataFrame, params: Params) -> tuple[float, float, list[float]]:
    """Offset, flag threshold and the stored score table, from raw training scores."""
    share = params.iso_flag_percentile / 100.0
    asked = (share,) if params.contamination is None else (share, params.contamination)
    threshold, *rest = quantiles(raw, "raw", asked).first()["quantiles"]
    offset = rest[0] if rest else IF.AUTO_OFFSET
    points = IF.score_table(raw).first()["quantiles"]
    return offset, threshold - offset, [p - offset for p in points]


def score_columns(features: Sequence[str] = FEATURES) -> tuple[str, ...]:
    return (
        *KEY,
        "data_quality_risk",
        *[f"{f}_flag" for f in features],
        "mad_score_count",
        "observed_feature_count",
        "mad_flag_ratio",
        "mad_critical_flag",
        "iso_forest_raw_score",
        "iso_forest_flag",
        *ALERT_COLUMNS,
        "baseline_source",
    )


def self_scored(live: DataFrame, model: Model, drift: str = "warn") -> DataFrame:
    """Live rows with stats, z, flags, and the forest's x columns."""
    params = model.params
    feature_drift(live, model.features, drift)
    routed = B.routed(require_unique(align(live, model.features)), model.baseline, model.population, params)
    flagged = flags.with_flags(B.with_self_scores(routed, params), params)
    return IF.model_input(flagged, model.thresholds.fill_value, model.scaling, features=model.features)


def score(
    live: DataFrame, model: Model, iso_threshold: float | None = None, drift: str = "warn"
) -> DataFrame:
    """Score every user-day of `live`: one row per input row.

    A repeated user-day aborts the job; missing and unknown features are logged. With
    drift "raise", features that the model was fitted on must be there.
    """
    threshold = model.thresholds.iso_threshold if iso_threshold is None else iso_threshold
    ready = self_scored(live, model, drift)
    raw = IF.raw_score(ready, model.forest) - model.thresholds.iso_offset
    judged = ready.withColumns(
        {
            "mad_critical_flag": flags.critical_flag(model.thresholds.critical_flag_ratio),
            "iso_forest_raw_score": raw,
        }
    ).withColumn("iso_forest_flag", flags.iso_flag(threshold))
    return flags.with_verdict(judged).select(*score_columns(model.features))


# --- model tables -------------------------------------------------------------


def schema_hash(features: tuple[str, ...] = FEATURES) -> Column:
    names = F.array(*[F.lit(f) for f in features])
    return F.sha2(F.to_json(F.array_sort(names)), 256)


def _exact(value: Column) -> Column:
    return F.format_string("%.12f", F.bround(value, 12))


def checksum(summary: DataFrame, *extra: str) -> DataFrame:
    """SHA-256 of the compact, key-sorted JSON of a one-row model summary.

    Numbers enter as fixed-point text, so the sum does not depend on number printing.
    """
    names = sorted(
        ["critical_flag_ratio", "feature_schema_hash", "iso_threshold", "mad_threshold", "model_version", "n_users", *extra]
    )
    numeric = {"critical_flag_ratio", "iso_threshold", "mad_threshold"}
    parts = [(_exact(F.col(n)) if n in numeric else F.col(n)).alias(n) for n in names]
    return summary.select(F.sha2(F.to_json(F.struct(*parts)), 256).alias("checksum"))


def table_digest(df: DataFrame) -> DataFrame:
    """Order-independent digest of a table: one row (digest, n)."""
    row = F.xxhash64(*[F.to_json(F.struct("*"))])
    return df.select(row.alias("h")).agg(
        F.concat_ws(
            ":",
            F.count("*").cast("string"),
            F.coalesce(F.bit_xor("h"), F.lit(0)).cast("string"),
            F.coalesce(F.sum(F.pmod("h", F.lit(1_000_003))), F.lit(0)).cast("string"),
        ).alias("digest")
    )


_META = T.StructType(
    [
        T.StructField("model_version", T.StringType()),
        T.StructField("params", T.StringType()),
        T.StructField("population", T.StringType()),
        T.StructField("scaling", T.StringType()),
        T.StructField("subsample", T.IntegerType()),
        T.StructField("critical_flag_ratio", T.DoubleType()),
        T.StructField("iso_threshold", T.DoubleType()),
        T.StructField("iso_offset", T.DoubleType()),
        T.StructField("fill_value", T.DoubleType()),
        T.StructField("mad_threshold", T.DoubleType()),
        T.StructField("score_points", T.ArrayType(T.DoubleType())),
        T.StructField("n_users", T.LongType()),
        T.StructField("baseline_digest", T.StringType()),
        T.StructField("forest_digest", T.StringType()),
    ]
)


def _model_checksum(meta: DataFrame, features: tuple[str, ...]) -> str:
    with_hash = meta.withColumn("feature_schema_hash", schema_hash(features))
    constants = F.sha2(
        F.to_json(F.struct("params", "population", "scaling", "subsample", "iso_offset", "fill_value", "score_points")), 256
    )
    return checksum(
        with_hash.withColumn("constants_digest", constants), "baseline_digest", "forest_digest", "constants_digest"
    ).first()["checksum"]


def save_model(model: Model, path: str) -> str:
    """Write the model tables under `path`/`version`; returns the checksum."""
    if not model.forest.nodes or not model.population:
        raise ValueError("the model is not fitted")
    spark = model.baseline.sparkSession
    at = f"{path}/{model.version}"
    model.baseline.write.mode("errorifexists").parquet(f"{at}/baseline")
    model.forest_table.write.mode("errorifexists").parquet(f"{at}/forest")
    stored = spark.read.parquet(f"{at}/baseline")
    t = model.thresholds
    row = (
        model.version,
        json.dumps(asdict(model.params), sort_keys=True),
        json.dumps(model.population, sort_keys=True),
        json.dumps(model.scaling, sort_keys=True),
        model.forest.subsample,
        float(t.critical_flag_ratio),
        float(t.iso_threshold),
        float(t.iso_offset),
        float(t.fill_value),
        float(model.params.mad_threshold),
        [float(p) for p in model.score_points],
        stored.count(),
        table_digest(stored).first()["digest"],
        table_digest(spark.read.parquet(f"{at}/forest")).first()["digest"],
    )
    meta = spark.createDataFrame([row], _META)
    total = _model_checksum(meta, model.features)
    meta.coalesce(1).write.mode("errorifexists").parquet(f"{at}/meta")
    spark.createDataFrame([(total,)], "checksum string").coalesce(1).write.mode(
        "errorifexists"
    ).parquet(f"{at}/checksum")
    return total


def load_model(spark: SparkSession, path: str, version: str) -> Model:
    """Read the model tables back; a wrong or unreadable checksum raises, a missing one warns."""
    at = f"{path}/{version}"
    meta = spark.read.schema(_META).parquet(f"{at}/meta")
    base, table = spark.read.parquet(f"{at}/baseline"), spark.read.parquet(f"{at}/forest")
    found = meta.first()
    if found is None:
        raise ValueError(f"no fitted model at {at}")
    kept = existing(spark, f"{at}/checksum")
    if kept is None:
        log.warning("model %s has no checksum", at)
    stored = kept.first()["checksum"] if kept is not None else None
    params = Params(**json.loads(found["params"]))
    live = meta.withColumns(
        {
            "baseline_digest": F.lit(table_digest(base).first()["digest"]),
            "forest_digest": F.lit(table_digest(table).first()["digest"]),
        }
    )
    if stored is not None and _model_checksum(live, params.features) != stored:
        raise ValueError(f"model {at} does not match its checksum")
    scaling = json.loads(found["scaling"])
    return Model(
        params=params,
        baseline=base,
        population=json.loads(found["population"]),
        scaling={f: tuple(v) for f, v in scaling.items()} if scaling else None,
        forest=IF.load_forest(table, found["subsample"], params.features),
        forest_table=table,
        thresholds=Thresholds(
            found["critical_flag_ratio"], found["iso_threshold"], found["iso_offset"], found["fill_value"]
        ),
        score_points=list(found["score_points"]),
        version=found["model_version"],
    )
