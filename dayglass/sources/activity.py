"""Sign-in, web and mail logs derived from the `events` and `pages` tables.

The rules are stated in README.md. Every event feeds at least one log.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayglass.operators.feeds import host

HISTORY = (dt.date(2024, 1, 1), dt.date(2024, 1, 21))
LIVE = (dt.date(2024, 1, 21), None)
KEYWORDS = ("%page=%", "%#top%")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        "event_type",
        "value",
        F.concat(F.lit("U"), F.lpad(F.col("user_id").cast("string"), 5, "0")).alias("user"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def logon_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return (
        _events(spark, sf_dir)
        .where(kind.isin("signup", "view", "error"))
        .select(
            "user",
            F.concat(F.lit("PC-"), F.floor(F.col("k") / 15).cast("string")).alias("pc"),
            F.when(kind == "signup", "Logon").when(kind == "view", "Logoff").otherwise("Login Failed").alias("activity"),
            "ts",
        )
    )


def http_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    kind = F.col("event_type")
    visits = (
        _events(spark, sf_dir)
        .where(kind.isin("click", "purchase"))
        .withColumn("page_id", F.pmod("event_id", pages.agg(F.count("*")).scalar()))
    )
    return visits.join(pages, "page_id").select(
        "user",
        "url",
        F.when(kind == "purchase", "WWW Upload").otherwise("WWW Visit").alias("activity"),
        "ts",
    )


def email_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    key = k.cast("string")
    return (
        _events(spark, sf_dir)
        .where(F.col("event_type").isin("signup", "click"))
        .select(
            "user",
            F.when(k < 5, None)
            .when(k < 40, F.concat(F.lit("a"), key, F.lit("@dtaa.com")))
            .when(k < 55, "a@dtaa.com;b@example.net")
            .otherwise(F.concat(F.lit("b"), key, F.lit("@example.net")))
            .alias("recipient"),
            F.floor(F.col("value") * 10000).cast("string").alias("email_size"),
            F.when(k < 20, "")
            .when(k < 25, None)
            .otherwise(F.concat(F.repeat(F.lit("f.doc;"), F.floor(k / 40).cast("int")), F.lit("f.doc")))
            .alias("attachment_count"),
            "ts",
        )
    )


def logs(spark: SparkSession, sf_dir: str) -> Mapping[str, DataFrame]:
    return {
        "logon": logon_log(spark, sf_dir),
        "http": http_log(spark, sf_dir),
        "email": email_log(spark, sf_dir),
    }


def device_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups, clicks and purchases connect a device, views and errors disconnect it."""
    return _events(spark, sf_dir).select(
        "user",
        F.concat(F.lit("PC-"), F.pmod("k", F.lit(3)).cast("string")).alias("pc"),
        F.when(F.col("event_type").isin("view", "error"), "Disconnect").otherwise("Connect").alias("activity"),
        "ts",
    )


def file_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event touches a file; its name follows from k."""
    k = F.col("k")
    ending = F.element_at(F.array(F.lit(".doc"), F.lit(".PDF"), F.lit(""), F.lit(".tar.gz")), k % 4 + 1)
    name = F.concat(F.lit("C:\\R"), (k % 5).cast("string"), F.lit("/f"), (k % 11).cast("string"), ending)
    return _events(spark, sf_dir).select("user", name.alias("filename"), "ts")


def threat_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily feed from all pages: domains of larger pages than usual are blocked for some
    days, hosts below a domain that have no larger page are allowed from 2024-01-10 on."""
    pages = read_table(spark, sf_dir, "pages").select(host(F.col("url")).alias("host"), F.length("html").alias("size"))
    labels = F.split("host", r"\.")
    domain = F.array_join(F.when(F.size(labels) > 3, F.slice(labels, -3, 3)).otherwise(labels), ".")
    named = pages.where("host IS NOT NULL").withColumn("domain", domain)
    usual = pages.agg(F.avg("size")).scalar()
    listed_from = "date_add(DATE '2024-01-01', int(sum(size) % 20))"
    blocked = named.groupBy("domain").agg(
        F.lit("block").alias("verdict"),
        F.expr(listed_from).alias("listed_from"),
        F.expr(f"IF(count(*) % 3 > 0, date_add({listed_from}, int(5 + count(*) % 15)), NULL)").alias("listed_to"),
        F.avg("size").alias("size"),
    )
    allowed = named.where("host <> domain").groupBy(F.col("host").alias("domain")).agg(F.max("size").alias("size"))
    entries = blocked.where(F.col("size") > usual).drop("size")
    open_end = F.lit(None).cast("date").alias("listed_to")
    return entries.unionByName(
        allowed.where(F.col("size") <= usual).select(
            "domain", F.lit("allow").alias("verdict"), F.lit(dt.date(2024, 1, 10)).alias("listed_from"), open_end
        )
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in ground truth: user-days with at least two error events are positive."""
    return (
        _events(spark, sf_dir)
        .where(F.col("event_type") == "error")
        .groupBy("user", F.to_date("ts").alias("activity_date"))
        .agg((F.count("*") >= 2).cast("int").alias("label"))
    )
