"""Scores of closed days as they arrive, by a model that can be replaced meanwhile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayglass.plans.model import Model, load_model, save_model, score
from dayglass.sources.store import existing

POINTER = "version string, published bigint"


def publish(model: Model, path: str) -> str:
    """Save a model under `path`/`version` and make it the one that streams load next."""
    checksum = save_model(model, path)
    spark = model.baseline.sparkSession
    before = existing(spark, f"{path}/published")
    number = before.agg(F.max("published")).first()[0] + 1 if before is not None else 0
    spark.createDataFrame([(model.version, number)], POINTER).coalesce(1).write.mode("append").parquet(f"{path}/published")
    return checksum


def published_version(spark: SparkSession, path: str) -> str:
    known = existing(spark, f"{path}/published")
    if known is None:
        raise ValueError(f"no model is published at {path}")
    return known.agg(F.max_by("version", "published")).first()[0]


class PublishedModel:
    """The newest published model; read again only when another version is published."""

    def __init__(self, path: str) -> None:
        self.path, self.model = path, None

    def newest(self, spark: SparkSession) -> Model:
        version = published_version(spark, self.path)
        if self.model is None or self.model.version != version:
            self.model = load_model(spark, self.path, version)
        return self.model


def score_batch(days: DataFrame, batch_id: int, models: PublishedModel, path: str, query: str) -> None:
    """Score one micro-batch into its own folder: writing a batch again replaces it by the same rows."""
    model = models.newest(days.sparkSession)
    scored = score(days, model).withColumn("model_version", F.lit(model.version))
    scored.write.mode("overwrite").parquet(f"{path}/query={query}/batch={batch_id}")


def score_days(days: DataFrame, models: str, path: str, checkpoint: str, query: str = "scores", **trigger):
    """Score every closed day once with the model published at that time. Returns the query.

    The sink is idempotent by (query, batch): after a lost driver the last batch is written
    again over itself. A batch joins the stored baseline as any batch job does.
    """
    source = PublishedModel(models)
    return (
        days.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .queryName(query)
        .foreachBatch(lambda batch, batch_id: score_batch(batch, batch_id, source, path, query))
        .trigger(**trigger)
        .start()
    )


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """All batches of all queries, with the columns query and batch."""
    return spark.read.parquet(path)
