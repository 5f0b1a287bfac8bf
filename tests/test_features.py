"""Edge rows of the extractors, the fusion and the gates."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dayglass.contract import FEATURES, KEY, UNKNOWN_IF_SILENT
from dayglass.functions.timing import iso_date
from dayglass.operators import features, fusion, gates
from dayglass.operators.flags import MISSING_SHARE
from dayglass.sources import logs

MON = "2024-01-08"
SAT = "2024-01-06"


def logon(spark, rows):
    df = spark.createDataFrame(rows, "user string, pc string, activity string, at string")
    return df.select("user", "pc", "activity", F.col("at").cast("timestamp_ntz").alias("ts"))


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.mark.parametrize(
    "at, off", [(f"{MON} 05:59:59", 1.0), (f"{MON} 06:00:00", 0.0), (f"{MON} 17:59:59", 0.0), (f"{MON} 18:00:00", 1.0), (f"{SAT} 12:00:00", 1.0)]
)
def test_off_hours(spark, at, off):
    row = one(features.logon_features(logon(spark, [("u", "p", "Logon", at)])))
    assert row["off_hours_ratio"] == off


def test_logon_counts(spark):
    rows = [
        ("u", "p1", "Logon", f"{MON} 10:01:00"),
        ("u", "p1", "Logon", f"{MON} 10:04:59"),  # same bucket
        ("u", "p1", "Logoff", f"{MON} 10:02:00"),
        ("u", "p2", "Login FAILED", f"{MON} 10:02:00"),
        ("u", None, "Logoff", f"{MON} 11:02:00"),
        ("u", "p3", "Connect", f"{MON} 10:02:00"),  # other activity
        ("SYSTEM", "p1", "Logon", f"{MON} 10:02:00"),
        (None, "p1", "Logon", f"{MON} 10:02:00"),
    ]
    row = one(features.logon_features(logon(spark, rows)))
    assert row["total_event_buckets"] == 4
    assert row["unique_systems_accessed"] == 2
    assert row["failed_login_ratio"] == 0.25
    assert row["active_orphan_sessions"] == -1


def test_http_counts(spark):
    rows = [("u", "http://a/WikiLeaks", "WWW Upload", f"{SAT} 12:00:00"), ("u", "http://a", "POST", f"{SAT} 19:00:00"), ("u", None, "x", f"{SAT} 12:00:00")]
    df = spark.createDataFrame(rows, "user string, url string, activity string, at string")
    row = one(features.http_features(df.withColumn("ts", F.col("at").cast("timestamp_ntz"))))
    assert (row["url_visits"], row["upload_event_count"], row["keyword_match_indicator"]) == (2, 2, 1)
    assert (row["unique_external_domains"], row["after_hours_browsing"]) == (2, 1)  # no weekend rule


def email(spark, rows):
    df = spark.createDataFrame(rows, "user string, recipient string, email_size string, attachment_count string, at string")
    return df.withColumn("ts", F.col("at").cast("timestamp_ntz"))


def test_email_counts(spark):
    noon = f"{SAT} 12:00:00"
    rows = [
        ("u", None, "1000000", "", noon),
        ("u", "a@DTAA.com;b@x.org", "1000001", None, noon),
        ("u", "b@x.org", "oops", "a", noon),
        ("u", "c@x.org", None, "a;b", f"{SAT} 03:00:00"),
    ]
    row = one(features.email_features(email(spark, rows)))
    assert (row["emails_sent"], row["external_recipients"], row["after_hours_emails"]) == (4, 2, 1)
    assert (row["attachments_sent"], row["large_attachment_count"]) == (3, 1)


def test_attachment_count_mode(spark):
    rows = [("u", "x", "1", "3", f"{MON} 12:00:00"), ("u", "x", "1", "many", f"{MON} 12:00:00")]
    row = one(features.email_features(email(spark, rows), attachment_mode="count"))
    assert row["attachments_sent"] == 3


def test_window_is_half_open_and_typed(spark):
    rows = [("u", "p", "Logon", f"{d} 00:00:00") for d in ("2024-01-08", "2024-01-09")]
    df = features.logon_features(logon(spark, rows), dt.date(2024, 1, 8), dt.date(2024, 1, 9))
    assert [r["activity_date"] for r in df.collect()] == [dt.date(2024, 1, 8)]
    with pytest.raises(TypeError):
        features.logon_features(logon(spark, rows), "2024-01-08")
    with pytest.raises(ValueError):
        iso_date("20240108")
    with pytest.raises(ValueError):
        iso_date("2024-1-8' OR 1=1")


def sources(spark):
    """logon only, http only, email only, and all three."""
    users = {"logon": ["l", "all"], "http": ["h", "all"], "email": ["e", "all"]}
    out = {}
    for name, fs in (("logon", FEATURES[:5]), ("http", FEATURES[5:10]), ("email", FEATURES[10:])):
        rows = [(u, dt.date(2024, 1, 8), *([1.0] * 5)) for u in users[name]]
        out[name] = spark.createDataFrame(rows, f"user string, activity_date date, {', '.join(f'{f} double' for f in fs)}")
    return out


def test_fusion_null_policy(spark):
    rows = {r["user"]: r for r in fusion.fuse(**sources(spark)).collect()}
    assert set(rows) == {"l", "h", "e", "all"}
    present = {"l": {"logon"}, "h": {"http"}, "e": {"email"}, "all": {"logon", "http", "email"}}
    for user, row in rows.items():
        for f, source in UNKNOWN_IF_SILENT.items():
            assert (row[f] is None) == (source not in present[user]), (user, f)
        assert row["emails_sent"] == (1.0 if "email" in present[user] else 0.0)
    share = {r["user"]: r["s"] for r in fusion.fuse(**sources(spark)).selectExpr("user", f"{MISSING_SHARE} AS s").collect()}
    assert share == {"l": 3 / 15, "h": 4 / 15, "e": 3 / 15, "all": 0.0}
    assert fusion.require_nulls(fusion.fuse(**sources(spark))) == 10
    with pytest.raises(ValueError):
        fusion.require_nulls(fusion.fuse(**sources(spark), fill="blanket"))


def test_fusion_needs_no_shuffle_after_the_sources(spark):
    """Three aggregated sources share one partitioning: the union adds no exchange."""
    parts = [df.groupBy(*KEY).agg(*[F.max(c).alias(c) for c in df.columns[2:]]) for df in sources(spark).values()]
    plan = fusion.fuse(*parts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 3


def test_gates(spark):
    df = fusion.fuse(**sources(spark))
    assert gates.validate(df) is df
    with pytest.raises(ValueError, match="empty"):
        gates.validate(df.limit(0))
    with pytest.raises(ValueError, match="repeated"):
        gates.validate(df.union(df))
    with pytest.raises(ValueError, match="key"):
        gates.validate(df.drop("user"))
    with pytest.raises(ValueError, match="numeric"):
        gates.validate(df.select(*KEY))
    with pytest.raises(ValueError, match="missing"):
        gates.feature_drift(df.drop("emails_sent"), mode="raise")
    assert gates.feature_drift(df.drop("emails_sent"))["missing"] == ["emails_sent"]


def test_lenient_csv_keeps_bad_rows_apart(spark, tmp_path):
    path = tmp_path / "logon.csv"
    path.write_text("id,date,user,pc,activity\n1,1/2/2010 7:05:09,u,p,Logon\n2,not a date,u,p,Logon\n3,01/02/2010 08:00:00,u\n")
    raw = logs.read_csv(spark, str(path), logs.LOGON_LOG, strict=False).cache()
    assert [r["id"] for r in logs.rejected(raw).orderBy("id").collect()] == ["2", "3"]
    assert logs.logon_log(raw, strict=False).where("ts IS NULL").count() == 1
    with pytest.raises(Exception):
        logs.read_logon_log(spark, str(path)).collect()
