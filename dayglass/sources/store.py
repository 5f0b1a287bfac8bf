"""Tables on shared storage: scratch tables, feature runs, reports, model tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayglass.operators.fusion import require_key

_local_scratch: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only for an unconfigured local session."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="dayglass-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/dayglass/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several jobs read and continue from the written one."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(_nullable(df.schema)).parquet(path)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema])


def write_by_day(df: DataFrame, path: str, files_per_day: int = 8) -> None:
    """Keyed table partitioned by day; rewriting a day leaves the others alone.

    Users are hashed into `files_per_day` groups: a busy day is written by that many
    tasks, and a day never splits into one file per task.
    """
    group = F.pmod(F.xxhash64("user"), F.lit(files_per_day))
    (
        require_key(df, "table")
        .repartition("activity_date", group)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("activity_date")
        .parquet(path)
    )


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    return require_key(spark.read.parquet(path), path)


def read_sources(spark: SparkSession, **paths: str) -> dict[str, DataFrame]:
    """Read the named source tables and check the key of each."""
    return {name: require_key(spark.read.parquet(path), name) for name, path in paths.items()}


def write_run(df: DataFrame, path: str, window_name: str, run_id: str) -> None:
    """One run of a feature table; runs and windows never overwrite each other."""
    (
        df.withColumn("window_name", F.lit(window_name))
        .withColumn("run_id", F.lit(run_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("window_name", "run_id")
        .parquet(path)
    )


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs; the partition columns stay text whatever they look like."""
    found = spark.read.parquet(path)
    return found.withColumns({c: F.col(c).cast("string") for c in ("window_name", "run_id")})


def latest_runs(runs: DataFrame) -> DataFrame:
    """Rows of the newest run of every window.

    The newest run ids (one a window) are read first from the partition columns, so that
    the scan is filtered by literals and leaves the other runs' files alone.
    """
    newest = runs.groupBy("window_name").agg(F.max("run_id").alias("run_id")).collect()
    wanted = F.lit(False)
    for row in newest:
        wanted |= (F.col("window_name") == row["window_name"]) & (F.col("run_id") == row["run_id"])
    return runs.where(wanted)


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at `path`, or None where nothing is; any other failure raises."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_or_make(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at `path`; it is made and written first where nothing exists.

    What is there is never overwritten, with or without a success marker.
    """
    found = existing(spark, path)
    if found is None:
        make().write.mode("errorifexists").parquet(path)
        found = spark.read.parquet(path)
    return found


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").parquet(path)


def write_detail(alerts: DataFrame, path: str) -> None:
    """Nested alert records, one JSON object per line, nulls kept."""
    alerts.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_detail(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


IMPORTANCE = T.StructType(
    [
        T.StructField("feature", T.StringType()),
        T.StructField("mean_abs_shap", T.DoubleType()),
        T.StructField("rank", T.IntegerType()),
    ]
)


def write_importance(table: DataFrame, path: str) -> None:
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)  # one row per feature


def read_importance(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(IMPORTANCE).option("header", True).csv(path)
