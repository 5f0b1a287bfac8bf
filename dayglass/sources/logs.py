"""Raw CSV logs to typed logs.

A typed log has `user`, `ts` (timestamp without zone) and the columns its feature
operator reads. Land large logs once as Parquet by event date: text files cannot be
pruned, and a file with multi-line fields cannot be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayglass.contract import DEVICE_LOG, EMAIL_LOG, FILE_LOG, HTTP_LOG, LOGON_LOG
from dayglass.functions.timing import event_time

BAD_ROW = "_corrupt_record"


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    multi_line: bool = False,
    strict: bool = True,
) -> DataFrame:
    """Positional read of a log with a header line; nothing is inferred.

    The header must name the columns of the schema in its order. strict aborts on a
    malformed row, otherwise such rows carry `_corrupt_record`.
    """
    reader = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("enforceSchema", False)
    )
    if strict:
        return reader.schema(schema).option("mode", "FAILFAST").csv(path)
    lenient = T.StructType([*schema.fields, T.StructField(BAD_ROW, T.StringType())])
    return (
        reader.schema(lenient)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD_ROW)
        .csv(path)
    )


def read_named_csv(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """Read a log by its header's names, in whatever order they stand."""
    found = spark.read.option("header", True).option("escape", '"').csv(path).columns
    missing = [f for f in schema.fieldNames() if f not in found]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    raw = read_csv(spark, path, T.StructType([T.StructField(n, T.StringType()) for n in found]), strict=strict)
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]
    return raw.select(*typed, *([] if strict else [BAD_ROW]))


def rejected(raw: DataFrame) -> DataFrame:
    """Rows of a lenient read that are malformed or carry an unreadable date."""
    return raw.where(F.col(BAD_ROW).isNotNull() | event_time(F.col("date"), strict=False).isNull())


def logon_log(raw: DataFrame, strict: bool = True) -> DataFrame:
    return raw.select("user", "pc", "activity", event_time(F.col("date"), strict).alias("ts"))


def http_log(raw: DataFrame, strict: bool = True) -> DataFrame:
    return raw.select("user", "url", "activity", event_time(F.col("date"), strict).alias("ts"))


def email_log(raw: DataFrame, strict: bool = True) -> DataFrame:
    return raw.select(
        "user",
        F.col("to").alias("recipient"),
        F.col("size").alias("email_size"),
        "attachment_count",
        event_time(F.col("date"), strict).alias("ts"),
    )


def device_log(raw: DataFrame, strict: bool = True) -> DataFrame:
    return raw.select("user", "pc", "activity", event_time(F.col("date"), strict).alias("ts"))


def file_log(raw: DataFrame, strict: bool = True) -> DataFrame:
    return raw.select("user", "filename", event_time(F.col("date"), strict).alias("ts"))


def read_logon_log(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return logon_log(read_named_csv(spark, path, LOGON_LOG, strict), strict)


def read_http_log(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return http_log(read_csv(spark, path, HTTP_LOG, strict=strict), strict)


def read_email_log(
    spark: SparkSession, path: str, strict: bool = True, multi_line: bool = True
) -> DataFrame:
    return email_log(read_csv(spark, path, EMAIL_LOG, multi_line, strict), strict)


def read_device_log(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return device_log(read_named_csv(spark, path, DEVICE_LOG, strict), strict)


def read_file_log(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return file_log(read_named_csv(spark, path, FILE_LOG, strict), strict)


def land_email_log(spark: SparkSession, path: str, landed: str, tasks: int = 200) -> None:
    """Write a mail log once as Parquet by event date.

    A CSV file with multi-line fields is read by one task; feature jobs read the landed
    table instead, in as many tasks as it has row groups and only for their days.
    """
    log = read_email_log(spark, path)
    day = F.to_date("ts")
    log.withColumn("event_date", day).repartition(tasks, "event_date", F.xxhash64("user") % 8).write.partitionBy(
        "event_date"
    ).parquet(landed)
