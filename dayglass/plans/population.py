"""Population mode: one baseline for everybody, raw features in the forest."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayglass.contract import FEATURES, KEY, Params
from dayglass.functions.robust import population_score
from dayglass.functions.trees import Forest
from dayglass.operators import baseline, flags
from dayglass.operators import forest as IF
from dayglass.operators.fusion import align
from dayglass.operators.gates import validate
from dayglass.sources.store import materialize

# Fixed values of the mode.
CRITICAL_FLAGS = 2
MISSING_TOLERANCE = 0.2
PARAMS = Params(trees=100, contamination=None, missing_data_tolerance=MISSING_TOLERANCE)


@dataclass(frozen=True)
class PopulationModel:
    population: dict[str, dict[str, float]]
    forest: Forest
    iso_threshold: float
    params: Params = PARAMS
    forest_table: DataFrame | None = None


def mean_minus_std(raw: DataFrame, offset: float = IF.AUTO_OFFSET) -> DataFrame:
    """Flag threshold: mean minus population deviation of the training scores, one row."""
    score = F.col("raw") - offset
    return raw.agg((F.avg(score) - F.stddev_pop(score)).alias("iso_threshold"))


def fit_population(history: DataFrame, params: Params = PARAMS) -> PopulationModel:
    params = replace(params, features=FEATURES)  # this mode knows the fifteen
    history = validate(materialize(align(history), "history"), "history")
    rows = history.count()
    population = baseline.fetch_global(baseline.global_baseline(history, params))
    x = IF.model_input(history, 0.0, None, prefix="")
    table = materialize(IF.fit_forest(x, rows, params), "forest")
    forest = IF.load_forest(table, min(params.subsample, rows))
    threshold = mean_minus_std(x.select(IF.raw_score(x, forest).alias("raw"))).first()[0]
    return PopulationModel(population, forest, threshold, params, table)


def population_flags(live: DataFrame, population: dict, params: Params = PARAMS) -> DataFrame:
    """Key, features, flags, mad_score_count, mad_critical_flag and the data-quality gate."""
    threshold = f"{float(params.mad_threshold)!r}D"
    flag = lambda f: population_score(f, population[f]["median"], population[f]["mad"])
    return (
        align(live)
        .selectExpr(
            "*",
            *[f"int({flag(f)} > {threshold}) AS {f}_flag" for f in FEATURES],
            f"int({flags.MISSING_SHARE} > {params.missing_data_tolerance!r}D) AS data_quality_risk",
        )
        .selectExpr("*", f"{' + '.join(f'{f}_flag' for f in FEATURES)} AS mad_score_count")
        .selectExpr("*", f"int(mad_score_count >= {CRITICAL_FLAGS}) AS mad_critical_flag")
    )


def score_population(live: DataFrame, model: PopulationModel) -> DataFrame:
    """Scores of the population mode; the gap column is named data_loss_ioc."""
    flagged = population_flags(live, model.population, model.params)
    ready = IF.model_input(flagged, 0.0, None, prefix="")
    judged = ready.withColumn(
        "iso_forest_raw_score", IF.raw_score(ready, model.forest) - IF.AUTO_OFFSET
    ).withColumn("iso_forest_flag", flags.iso_flag(model.iso_threshold))
    return flags.with_verdict(judged, gap_name="data_loss_ioc").select(
        *KEY,
        "data_quality_risk",
        "mad_score_count",
        "mad_critical_flag",
        "iso_forest_raw_score",
        "iso_forest_flag",
        "confirmed_threat",
        "high_risk_review",
        "data_loss_ioc",
    )


def with_threshold(model: PopulationModel, iso_threshold: float) -> PopulationModel:
    return replace(model, iso_threshold=iso_threshold)


def save_population(model: PopulationModel, path: str) -> None:
    """Write the forest table and the constants under `path`, which must not exist."""
    if model.forest_table is None:
        raise ValueError("the model has no forest table")
    model.forest_table.write.mode("errorifexists").parquet(f"{path}/forest")
    constants = (json.dumps(model.population), json.dumps(asdict(model.params)), model.iso_threshold, model.forest.subsample)
    schema = "population string, params string, iso_threshold double, subsample int"
    model.forest_table.sparkSession.createDataFrame([constants], schema).coalesce(1).write.mode("errorifexists").parquet(f"{path}/meta")


def load_population(spark: SparkSession, path: str) -> PopulationModel:
    meta = spark.read.parquet(f"{path}/meta").first()
    table = spark.read.parquet(f"{path}/forest")
    return PopulationModel(
        json.loads(meta["population"]),
        IF.load_forest(table, meta["subsample"]),
        meta["iso_threshold"],
        Params(**json.loads(meta["params"])),
        table,
    )
