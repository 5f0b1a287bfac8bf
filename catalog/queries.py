"""One query per operator, each with the DuckDB statement that checks it.

"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from catalog import ctes as C
from catalog.world import PARAMS, World
from dayglass.contract import (
    ALERT_COLUMNS,
    EMAIL_FEATURES,
    FEATURES,
    HTTP_FEATURES,
    KEY,
    LOGON_FEATURES,
    STATUS_COLUMNS,
    Params,
)
from dayglass.functions import robust
from dayglass.operators import attribution, baseline, diagnostics, feeds, flags, fusion, gates, report, roles
from dayglass.operators import features as X
from dayglass.operators import forest as IF
from dayglass.operators.quantiles import quantiles
from dayglass.plans import detect, model, population
from dayglass.sources import activity, logs, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

UD = 'usr as "user", d as activity_date'


def query(key: str, sql: str | None = None):
    """Register a query on a World under `key`."""

    def add(make: Callable[[World], DataFrame]):
        QUERIES[key] = lambda spark, sf_dir: make(World(spark, sf_dir))
        if sql is not None:
            ORACLE[key] = C.with_ctes(sql)
        return make

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round the double columns: engines may differ in the last bit."""
    return df.select(
        *[F.round(n, digits).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes]
    )


def cols(names) -> str:
    return ", ".join(names)


def rnd(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) as {n}" for n in names)


def _as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.date_format("ts", "MM/dd/yyyy HH:mm:ss"))


# --- scans, sources, sinks ------------------------------------------------------


def _csv(w: World, kind: str) -> str:
    log = _as_text(w.logs[kind])
    path = store.scratch_path(w.spark, f"{kind}-csv")
    none = F.lit(None).cast("string")
    if kind == "logon":
        raw = log.select(none.alias("id"), "date", "user", "pc", "activity")
    elif kind == "http":
        raw = log.select(none.alias("id"), "date", "user", "url", F.lit("PC-1").alias("pc"), "activity")
    else:
        body = F.concat(F.lit('first line\nsecond "quoted", line '), "user")
        raw = log.select(
            none.alias("id"), "date", "user", F.lit("PC-1").alias("pc"), F.col("recipient").alias("to"),
            none.alias("cc"), none.alias("bcc"), none.alias("from"),
            F.col("email_size").alias("size"), "attachment_count", body.alias("content"),
        )
    raw.write.option("header", True).option("escape", '"').csv(path)
    return path


@query("s01_logon_csv", f"select {UD}, {cols(LOGON_FEATURES)} from logon_a")
def _(w):
    return X.logon_features(logs.read_logon_log(w.spark, _csv(w, "logon")))


@query("s02_http_csv", f"select {UD}, {cols(HTTP_FEATURES)} from http_a")
def _(w):
    return X.http_features(logs.read_http_log(w.spark, _csv(w, "http")), keywords=activity.KEYWORDS)


@query("s03_email_csv", f"select {UD}, {cols(EMAIL_FEATURES)} from email_a")
def _(w):
    return X.email_features(logs.read_email_log(w.spark, _csv(w, "email")))


@query("s04_feature_sink", f"select {UD}, {cols(LOGON_FEATURES)} from logon_a")
def _(w):
    path = store.scratch_path(w.spark, "sink")
    store.write_by_day(w.sources()["logon"], path)
    return w.spark.read.parquet(path).select(*KEY, *LOGON_FEATURES)


_http_aligned = cols(f"{f}::double as {f}" if f in HTTP_FEATURES else f"null::double as {f}" for f in FEATURES)


@query("s05_align_before_write", f"select {UD}, {_http_aligned} from http_a")
def _(w):
    path = store.scratch_path(w.spark, "aligned")
    store.write_by_day(fusion.align(w.sources()["http"]), path)
    return fusion.align(w.spark.read.parquet(path))


@query("s06_keyed_load", f"select {UD}, {cols(FEATURES)} from fused_a")
def _(w):
    path = store.scratch_path(w.spark, "master")
    store.write_by_day(w.fused(), path)
    return store.read_keyed(w.spark, path).select(*KEY, *FEATURES)


@query(
    "s07_load_three_sources",
    "select 'logon' as source, count(*) as n from logon_a union all select 'http', count(*) from http_a "
    "union all select 'email', count(*) from email_a",
)
def _(w):
    paths = {}
    for name, df in w.sources().items():
        paths[name] = store.scratch_path(w.spark, name)
        df.write.parquet(paths[name])
    return fusion.coverage_counts(**store.read_sources(w.spark, **paths)).withColumnRenamed("user_days", "n")


def _runs(w: World) -> DataFrame:
    path = store.scratch_path(w.spark, "runs")
    for name, window in (("history", activity.HISTORY), ("live", activity.LIVE)):
        features = w.sources(window)["logon"]
        for run in ("20240201_000000", "20240202_000000"):
            store.write_run(features, path, name, run)
    return store.read_runs(w.spark, path)


_run_rows = (
    "select 'history' as window_name, count(*) as n from logon_h union all select 'live', count(*) from logon_l"
)


@query(
    "s08_windowed_runs",
    f"select window_name, run_id, n from ({_run_rows}) cross join (values ('20240201_000000'), ('20240202_000000')) r(run_id)",
)
def _(w):
    return _runs(w).groupBy("window_name", "run_id").agg(F.count("*").alias("n"))


@query("s09_latest_run", f"select window_name, '20240202_000000' as run_id, n from ({_run_rows})")
def _(w):
    latest = store.latest_runs(_runs(w))
    return latest.groupBy("window_name", "run_id").agg(F.count("*").alias("n"))


_report_sql = (
    f"select {UD}, category as threat_category, round(iso, 6) as iso_raw_score, round(ratio, 6) as mad_flag_ratio, "
    "src as baseline_source, f1 as top1_feature, p1 as top1_shap, f2 as top2_feature, p2 as top2_shap from report"
)
_report_cols = (
    *KEY, "threat_category", "iso_raw_score", "mad_flag_ratio", "baseline_source",
    "top1_feature", "top1_shap", "top2_feature", "top2_shap",
)


def _flat(w: World) -> DataFrame:
    return attribution.flat_report(w.alerts()).select(*_report_cols)


@query("s10_report_sink", _report_sql)
def _(w):
    path = store.scratch_path(w.spark, "report")
    store.write_report(attribution.flat_report(w.alerts()), path)
    return rounded(w.spark.read.parquet(path).select(*_report_cols))


_detail_sql = (
    f"select {UD}, pos::int as position, feature as feature_name, phi as shap_value, mad_flagged, said as plain_english "
    "from contrib_said"
)


def _detail(w: World) -> DataFrame:
    path = store.scratch_path(w.spark, "detail")
    alerts = w.alerts()
    store.write_detail(alerts, path)
    return store.read_detail(w.spark, path, alerts.schema)


@query("s11_detail_json", _detail_sql)
def _(w):
    return attribution.contribution_rows(_detail(w)).select(
        *KEY, "position", "feature_name", "shap_value", "mad_flagged", "plain_english"
    )


_importance_sql = """
  select feature, round(avg(abs(p)), 6) as mean_abs_shap, rank() over (order by round(avg(abs(p)), 6) desc)::int as rank
  from (%s) group by feature""" % " union all ".join(
    f"select '{f}' as feature, {C._phi(i, f)} as p from raw_h" for i, f in enumerate(C.ALL)
)


def _importance(w: World) -> DataFrame:
    ready = model.self_scored(w.history, w.model)
    attributed = ready.withColumn("phi", IF.contributions(ready, w.model.forest))
    shares = attributed.select(F.transform("phi", lambda p: F.bround(p, 6)).alias("phi"))
    return IF.ranked(rounded(IF.importance(shares).select("feature", "mean_abs_shap")))


@query("s12_importance_csv", f"select feature, mean_abs_shap, rank from ({_importance_sql})")
def _(w):
    path = store.scratch_path(w.spark, "importance")
    store.write_importance(_importance(w), path)
    return store.read_importance(w.spark, path)


DETECTOR = Params(min_history_days=C.MIN_HISTORY)  # forest of the default size


@query("s13_model_tables")
def _(w):
    fitted = model.fit(w.fused(activity.HISTORY), DETECTOR, "v1")
    path = store.scratch_path(w.spark, "models")
    model.save_model(fitted, path)
    return model.score(w.live, model.load_model(w.spark, path, "v1"))


_names_json = "[" + ",".join(f'"{f}"' for f in sorted(FEATURES)) + "]"


@query(
    "s14_model_checksum",
    f"""select sha256('{{"critical_flag_ratio":"' || printf('%.12f', {C.CRITICAL}) || '","feature_schema_hash":"'
        || sha256('{_names_json}') || '","iso_threshold":"' || printf('%.12f', {C.ISO_THRESHOLD})
        || '","mad_threshold":"' || printf('%.12f', {C.THRESHOLD}) || '","model_version":"stump","n_users":' || count(*) || '}}') as checksum
        from ubase""",
)
def _(w):
    summary = baseline.user_baseline(w.fused(activity.HISTORY), PARAMS).agg(F.count("*").alias("n_users")).withColumns(
        {
            "critical_flag_ratio": F.lit(C.CRITICAL),
            "iso_threshold": F.lit(C.ISO_THRESHOLD),
            "mad_threshold": F.lit(C.THRESHOLD),
            "model_version": F.lit("stump"),
            "feature_schema_hash": model.schema_hash(),
        }
    )
    return model.checksum(summary)


AS_OF = dt.date(2024, 2, 1)
_typed = (
    "category = 'confirmed_threat' as confirmed_threat, category = 'high_risk_review' as high_risk_review, "
    "category in ('review', 'telemetry_gap_flag') as telemetry_gap_flag"
)


def _typed_report(w: World) -> DataFrame:
    return report.typed_report(attribution.flat_report(w.alerts()), AS_OF)


@query(
    "s15_report_loader",
    f"select {UD}, category as threat_category, round(iso, 6) as iso_raw_score, {_typed} from report",
)
def _(w):
    path = store.scratch_path(w.spark, "report")
    store.write_report(attribution.flat_report(w.alerts()), path)
    typed = report.typed_report(w.spark.read.parquet(path), AS_OF)
    return rounded(typed.select(*KEY, "threat_category", "iso_raw_score", *ALERT_COLUMNS))


@query("s16_detail_loader", f"select {UD}, category as threat_category, 2 as seq from report")
def _(w):
    detail = _detail(w).select(*KEY, "threat_category")
    twice = detail.withColumn("seq", F.lit(1)).union(detail.withColumn("seq", F.lit(2)))
    kept = report.latest_details(twice.withColumn("order", F.col("seq")), "order")
    return kept.select(*KEY, "threat_category", "seq")


@query("s17_importance_loader", f"select feature, rank from ({_importance_sql})")
def _(w):
    path = store.scratch_path(w.spark, "importance")
    store.write_importance(_importance(w), path)
    return store.read_importance(w.spark, path).select("feature", "rank")


@query("s18_reuse_scores", f"select {UD}, dq as data_quality_risk, confirmed as confirmed_threat from scores")
def _(w):
    path = store.scratch_path(w.spark, "scores")
    def unexpected():
        raise AssertionError("stored scores were not reused")

    store.read_or_make(w.spark, path, lambda: w.scores)
    again = store.read_or_make(w.spark, path, unexpected)
    return again.select(*KEY, "data_quality_risk", "confirmed_threat")


# --- projections, filters, predicates ---------------------------------------------


@query(
    "p01_drop_system_account",
    "select usr as \"user\", count(*) as n from (select case when event_type = 'error' then 'SYSTEM' else usr end as usr from ev) "
    "where usr <> 'SYSTEM' group by all",
)
def _(w):
    noisy = w.table("events").select(
        F.when(F.col("event_type") == "error", "SYSTEM")
        .otherwise(F.concat(F.lit("U"), F.lpad(F.col("user_id").cast("string"), 5, "0")))
        .alias("user")
    )
    return X.people(noisy).groupBy("user").agg(F.count("*").alias("n"))


@query(
    "p02_logon_activity_filter",
    "select activity, count(*) as n from buckets_a where activity in ('Logon', 'Logoff') or activity ilike '%fail%' group by all",
)
def _(w):
    return X.logon_buckets(w.logs["logon"]).groupBy("activity").agg(F.count("*").alias("n"))


@query(
    "p03_time_window",
    "select 'history' as part, count(*) as n from logon_log where ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-21' "
    "union all select 'live', count(*) from logon_log where ts >= timestamp '2024-01-21'",
)
def _(w):
    from dayglass.functions.timing import within

    parts = [
        within(w.logs["logon"], *window).agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        for name, window in (("history", activity.HISTORY), ("live", activity.LIVE))
    ]
    return parts[0].union(parts[1])


@query(
    "p04_typed_date_arguments",
    "select count(*) as n from ev where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-12'",
)
def _(w):
    from dayglass.functions.timing import iso_date

    return w.spark.sql(
        "SELECT count(*) AS n FROM {events} WHERE ts >= :first AND ts < :last",
        args={"first": iso_date("2024-01-05"), "last": iso_date("2024-01-12")},
        events=w.table("events"),
    )


@query(
    "p05_email_projection",
    "select usr as \"user\", strftime(ts, '%Y-%m-%d %H:%M:%S') as at, recipient, email_size, attachment_count from email_log",
)
def _(w):
    raw = _as_text(w.logs["email"]).select(
        "user", "date", F.col("recipient").alias("to"), F.col("email_size").alias("size"), "attachment_count"
    )
    return logs.email_log(raw).select(
        "user", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "recipient", "email_size", "attachment_count"
    )


_logon_aligned = cols(f"{f}::double as {f}" if f in LOGON_FEATURES else f"null::double as {f}" for f in FEATURES)


@query("p06_align_contract", f"select {UD}, {_logon_aligned} from logon_a")
def _(w):
    return fusion.align(w.sources()["logon"])


@query("p07_project_by_name", f"select {UD}, {cols(sorted(FEATURES))} from fused_a")
def _(w):
    shuffled = w.fused().select(*reversed(FEATURES), *KEY)
    return fusion.align(shuffled)


@query("p08_fail_on_empty", "select count(*) as n from fused_a")
def _(w):
    return gates.require_rows(w.fused(), "matrix").agg(F.count("*").alias("n"))


@query("p09_numeric_columns", " union all ".join(f"select '{f}' as feature, count({f}) as observed from fused_a" for f in FEATURES))
def _(w):
    matrix = w.fused()
    found = gates.numeric_columns(matrix)
    counted = matrix.agg(*[F.count(f).alias(f) for f in found])
    return counted.unpivot([], found, "feature", "observed")


@query(
    "p10_duplicate_keys",
    "select usr as \"user\", cast(ts as date) as activity_date, count(*) as n from logon_log group by all having count(*) > 1",
)
def _(w):
    return gates.duplicate_keys(
        w.logs["logon"].select("user", F.to_date("ts").alias("activity_date"))
    )


@query("p11_feature_drift", f"select {UD}, dq as data_quality_risk, obs as observed_feature_count from flag_l")
def _(w):
    drift = gates.feature_drift(w.live.withColumn("new_feature", F.lit(1.0)))
    assert drift == {"missing": [], "extra": ["new_feature"]}
    return w.flagged(w.live).select(*KEY, "data_quality_risk", "observed_feature_count")


@query("p12_alert_filter", f"select {UD} from scores where confirmed = 1 or review = 1 or gap = 1")
def _(w):
    return attribution.flagged_rows(w.scores).select(*KEY)


@query("p13_flag_column_check", f"select {UD} from scores where review = 1")
def _(w):
    try:
        attribution.require_columns(w.scores, ["no_such_flag"])
    except ValueError:
        return attribution.flagged_rows(w.scores, ["high_risk_review"]).select(*KEY)
    raise AssertionError("an absent flag column went unnoticed")


@query("p14a_report_dates", f"select {UD} from report where d between date '2024-01-23' and date '2024-01-26'")
def _(w):
    return report.by_dates(_typed_report(w), dt.date(2024, 1, 23), dt.date(2024, 1, 26)).select(*KEY)


@query("p14b_report_categories", f"select {UD} from report where category in ('confirmed_threat', 'high_risk_review')")
def _(w):
    return report.by_categories(_typed_report(w), ["confirmed_threat", "high_risk_review"]).select(*KEY)


@query("p14c_report_user", f"select {UD} from report where lower(usr) like '%u0001%' or regexp_matches(usr, '(?i)u.*7$')")
def _(w):
    typed = store.materialize(_typed_report(w).select(*KEY), "typed")
    return report.by_user(typed, " u0001 ").union(report.by_user(typed, "u.*7$", regex=True)).distinct()


@query("p14d_report_score", f"select {UD} from report where iso <= 0.0")
def _(w):
    return report.by_score(_typed_report(w), 0.0).select(*KEY)


@query("p15_category_booleans", f"select {UD}, {_typed} from report")
def _(w):
    padded = attribution.flat_report(w.alerts()).withColumn(
        "threat_category", F.concat(F.lit(" "), "threat_category", F.lit("  "))
    )
    return report.typed_report(padded, AS_OF).select(*KEY, *ALERT_COLUMNS)


@query(
    "p16_defaults",
    "select usr as \"user\", case when confirmed = 1 then date '2024-02-01' else d end as activity_date, "
    "round(case when gap = 1 then 0::double else iso end, 6) as iso_raw_score from scores",
)
def _(w):
    broken = w.scores.select(
        "user",
        F.when(F.col("confirmed_threat") == 1, "not a date").otherwise(F.col("activity_date").cast("string")).alias("activity_date"),
        F.when(F.col("telemetry_gap_flag") == 0, F.col("iso_forest_raw_score")).alias("iso_raw_score"),
        F.expr(attribution.ALERT_CATEGORY).alias("threat_category"),
    )
    return rounded(report.typed_report(broken, AS_OF).select(*KEY, "iso_raw_score"))


@query("p17_flag_columns", "select feature, n from (%s)" % " union all ".join(
    f"select '{f}_flag' as feature, sum(fl_{f})::bigint as n from flag_l" for f in C.ALL
))
def _(w):
    scores = w.flagged(w.live)
    found = diagnostics.flag_columns(scores)
    sums = scores.agg(*[F.sum(c).alias(c) for c in found])
    return sums.unpivot([], found, "feature", "n")


@query(
    "p18_alert_table",
    "select case when category = 'confirmed_threat' then '🔴 CONFIRMED' when category = 'high_risk_review' then '🟠 REVIEW' else '🟡 DATA GAP' end as severity, "
    f"{UD}, round_even(iso, 4) as iso_raw_score, round_even(ratio, 3) as mad_flag_ratio, f1 as top1_feature, f2 as top2_feature from report",
)
def _(w):
    return report.alert_table(_typed_report(w)).select(
        "severity", *KEY, "iso_raw_score", "mad_flag_ratio", "top1_feature", "top2_feature"
    )


# --- joins ------------------------------------------------------------------------


@query("j01_fuse_full_outer", f"select {UD}, {cols(FEATURES)} from fused_a")
def _(w):
    return w.fused()


@query("j02_source_presence", f"select {UD}, has_logon, has_http, has_email from stack_a")
def _(w):
    return fusion.stack_sources(**w.sources()).select(*KEY, "has_logon", "has_http", "has_email")


_med = cols(f"round(m_{f}, 6) as {f}" for f in FEATURES)


@query("j03_baseline_lookup", f"select {UD}, src as baseline_source, {_med} from z_l")
def _(w):
    routed = baseline.routed(w.live, w.baseline, w.population, w.params)
    return rounded(
        routed.select(*KEY, "baseline_source", *[F.col(f"{f}_median").alias(f) for f in FEATURES])
    )


@query(
    "j04_feature_default",
    f"select {UD}, round(case when x.emails_sent is null then null when u.usr is null then abs(0.6745::double * x.emails_sent) "
    "when u.emails_sent_mad = 0 and u.emails_sent_p95 = u.emails_sent_med then case when x.emails_sent <> u.emails_sent_med then 4.5::double else 0::double end "
    "when u.emails_sent_mad = 0 then case when x.emails_sent > u.emails_sent_p95 then 4.5::double else 0::double end "
    "else abs(0.6745::double * (x.emails_sent - u.emails_sent_med) / u.emails_sent_mad) end, 6) as z "
    "from (select usr as u0, d, emails_sent from fused_l) x left join ubase u on u.usr = x.u0".replace(UD, 'x.u0 as "user", x.d as activity_date'),
)
def _(w):
    partial = {f: s for f, s in w.population.items() if f != "emails_sent"}
    z = baseline.self_scores(w.live, w.baseline, partial, w.params)
    return rounded(z.select(*KEY, F.col("emails_sent").alias("z")))


@query("j05_flagged_with_features", f"select {UD}, {cols(FEATURES)} from scores where confirmed = 1 or review = 1 or gap = 1")
def _(w):
    live = store.materialize(w.live, "live")
    scores = model.score(live, w.model)
    return attribution.with_raw_features(scores, live).select(*KEY, *FEATURES)


@query("j06_labels_left_join", f"select s.usr as \"user\", s.d as activity_date, confirmed as confirmed_threat, coalesce(label, 0) as label from scores s left join labels_t l on l.usr = s.usr and l.d = s.d")
def _(w):
    return diagnostics.labelled(w.scores, w.labels).select(*KEY, "confirmed_threat", "label")


@query("j07_attribution_flag_cross", f"select {UD}, feature as feature_name, mad_flagged from contrib")
def _(w):
    return attribution.contribution_rows(w.alerts()).select(*KEY, "feature_name", "mad_flagged")


@query(
    "j08_detail_lookup",
    f"select {UD}, category = 'confirmed_threat' as found, case when category = 'confirmed_threat' then s1 end as first_reason from report",
)
def _(w):
    alerts = store.materialize(w.alerts(), "alerts")
    detail = alerts.where("threat_category = 'confirmed_threat'").select(
        *KEY, F.get("top_contributors", F.lit(0)).getField("plain_english").alias("first_reason")
    )
    return report.with_details(attribution.flat_report(alerts).select(*KEY), detail)


def _gap_sql(a: str, b: str) -> str:
    return (
        f"select '{a}' as source, '{b}' as lacking, count(*) as user_days from {a}_l a "
        f"where not exists (select 1 from {b}_l b where b.usr = a.usr and b.d = a.d)"
    )


@query(
    "j09_coverage_anti_join",
    " union all ".join(_gap_sql(a, b) for a, b in (("http", "logon"), ("email", "logon"), ("logon", "http"), ("logon", "email"))),
)
def _(w):
    return fusion.coverage_gaps(**w.sources(activity.LIVE))


@query("j10_known_users", 'select distinct usr as "user" from fused_l where usr in (select usr from ubase)')
def _(w):
    return baseline.known_users(w.live, w.baseline)


# --- aggregations -------------------------------------------------------------------


@query("a01_logon_buckets", 'select usr as "user", pc, activity, b as bucket from buckets_a')
def _(w):
    return X.logon_buckets(w.logs["logon"])


for _i, _f in enumerate(FEATURES):
    _source = next(s for s, fs in (("logon", LOGON_FEATURES), ("http", HTTP_FEATURES), ("email", EMAIL_FEATURES)) if _f in fs)
    query(f"a{_i + 2:02d}_{_f}", f"select {UD}, {_f} from {_source}_a")(
        lambda w, s=_source, f=_f: w.sources()[s].select(*KEY, f)
    )


def _stats_rows(table: str) -> str:
    return " union all ".join(
        f"select '{f}' as feature, round({f}_med, 6) as median, round({f}_mad, 6) as mad, round({f}_p95, 6) as p95 from {table}"
        for f in C.ALL
    )


@query("a17_global_baseline", _stats_rows("gbase"))
def _(w):
    return rounded(baseline.global_baseline(w.history, w.params))


_user_stats = cols(
    f"round({f}_{k}, 6) as {f}_{k}" for f in FEATURES for k in ("med", "mad", "p95")
)


def _user_table(df: DataFrame) -> DataFrame:
    names = {"med": "median", "mad": "mad", "p95": "p95"}
    return rounded(
        df.select(
            "user",
            "history_days",
            *[F.col(f"stats.{f}.{n}").alias(f"{f}_{k}") for f in FEATURES for k, n in names.items()],
        )
    )


@query("a18_user_baseline", f'select usr as "user", days as history_days, {_user_stats} from ubase')
def _(w):
    return _user_table(baseline.user_baseline(w.fused(activity.HISTORY), w.params))


@query("a19_min_history", f'select usr as "user", count(*) as history_days from fused_h group by usr having count(*) >= {C.MIN_HISTORY}')
def _(w):
    return baseline.user_baseline(w.fused(activity.HISTORY), w.params).select("user", "history_days")


_z_cells = " union all ".join(f"select z_{f} as z from z_h" for f in FEATURES)


@query("a20_fill_value", f"select round(quantile_cont(z, 0.5), 6) as fill_value from ({_z_cells})")
def _(w):
    return rounded(baseline.fill_value(baseline.self_scores(w.history, w.baseline, w.population, w.params)))


@query(
    "a21_critical_flag_ratio",
    "select count(*) as active_rows, round(case when count(*) < 30 then 0.15::double else quantile_cont(ratio, 0.9) end, 6) as critical_flag_ratio "
    "from ratio_h where ratio > 0",
)
def _(w):
    return rounded(flags.critical_ratio(w.flagged(w.history), w.params))


@query("a22_iso_threshold", "select round(quantile_cont(raw, 0.02), 6) as iso_offset, round(quantile_cont(raw, 0.01) - quantile_cont(raw, 0.02), 6) as iso_threshold from raw_h")
def _(w):
    found = quantiles(w.raw(w.history), "raw", (0.02, 0.01))
    offset, low = F.get("quantiles", F.lit(0)), F.get("quantiles", F.lit(1))
    return rounded(found.select(offset.alias("iso_offset"), (low - offset).alias("iso_threshold")))


@query(
    "a23_score_table",
    "select i::int as point, round(q[i + 1], 6) as score from (select quantile_cont(raw, [%s]) as q from raw_h), range(1000) t(i)"
    % cols(f"{i}/999.0::double" for i in range(1000)),
)
def _(w):
    table = IF.score_table(w.raw(w.history)).select(F.posexplode("quantiles").alias("point", "score"))
    return rounded(table)


@query("a24_null_audit", " union all ".join(f"select '{f}' as feature, count(*) filter ({f} is null) as nulls from fused_a" for f in FEATURES))
def _(w):
    return fusion.null_audit(w.fused())


@query(
    "a25_scaling",
    " union all ".join(
        f"select '{f}' as feature, round(m, 6) as center, round(a, 6) as q25, round(b, 6) as q75, round(case when a = b then 1::double else b - a end, 6) as scale from "
        f"(select quantile_cont(z, 0.5) as m, quantile_cont(z, 0.25) as a, quantile_cont(z, 0.75) as b from (select coalesce(z_{f}, {C.FILL}::double) as z from z_h))"
        for f in FEATURES
    ),
)
def _(w):
    z = baseline.self_scores(w.history, w.baseline, w.population, w.params)
    return rounded(baseline.scaling(z, C.FILL))


_pct = lambda part: f"round(100.0::double * {part} / count(*), 6)"


@query(
    "a26_score_summary",
    "select count(*) as n_total, "
    + cols(f"sum({c})::bigint as n_{c}, {_pct(f'sum({c})')} as pct_{c}" for c in ("confirmed", "review", "gap"))
    + " from scores",
)
def _(w):
    return rounded(diagnostics.score_summary(w.scores))


_evaluate_sql = """
  with m as (select coalesce(label, 0) as y, s.gap as p from scores s left join labels_t l on l.usr = s.usr and l.d = s.d),
  c as (select count(*) filter (p = 1 and y = 1)::bigint as tp, count(*) filter (p = 1 and y = 0)::bigint as fp,
               count(*) filter (p = 0 and y = 1)::bigint as fn, count(*) filter (p = 0 and y = 0)::bigint as tn from m),
  r as (select *, case when tp + fp > 0 then tp::double / (tp + fp) else 0 end as pr, case when tp + fn > 0 then tp::double / (tp + fn) else 0 end as re from c)
  select round(pr, 4) as precision, round(re, 4) as recall, round(case when pr + re > 0 then 2 * pr * re / (pr + re) else 0 end, 4) as f1,
         round(case when 4 * pr + re > 0 then 5 * pr * re / (4 * pr + re) else 0 end, 4) as f2,
         round(case when fp + tn > 0 then fp::double / (fp + tn) else 0 end, 4) as false_positive_rate,
         tp as true_positives, fp as false_positives, fn as false_negatives, tn as true_negatives,
         tp + fn as support_positive, fp + tn as support_negative from r where tp + fn > 0"""


@query("a27_evaluate")
def _(w):
    return diagnostics.evaluate(w.scores, w.labels, "telemetry_gap_flag")


ORACLE["a27_evaluate"] = C.with_ctes(_evaluate_sql).replace("\n\n  with m as", ",\n  m as", 1)

_status = dict(zip(STATUS_COLUMNS, ("dq", "crit", "isof", "confirmed", "review", "gap")))


@query("a28_flag_counts", " union all ".join(f"select '{c}' as flag, sum({s})::bigint as n, count(*) as total, {_pct(f'sum({s})')} as pct from scores" for c, s in _status.items()))
def _(w):
    return rounded(diagnostics.flag_counts(w.scores))


@query(
    "a29_fusion_breakdown",
    "select both_agree, clean, dirty, dirty_alone, case when both_agree = 0 then 'the models agree on no row' when dirty = 0 then 'the models agree only where telemetry is clean' else 'ok' end as diagnosis from "
    "(select count(*) filter (crit = 1 and isof = 1) as both_agree, count(*) filter (crit = 1 and isof = 1 and dq = 0) as clean, "
    "count(*) filter (crit = 1 and isof = 1 and dq = 1) as dirty, count(*) filter (dq = 1 and not (crit = 1 and isof = 1)) as dirty_alone from judged)",
)
def _(w):
    return diagnostics.fusion_breakdown(w.scores)


def _dist(name: str, c: str) -> str:
    qs = cols(f"round(quantile_cont({c}::double, {p}), 6) as {n}" for n, p in (("p1", 0.01), ("p5", 0.05), ("median", 0.5), ("p95", 0.95), ("p99", 0.99)))
    return f"select '{name}' as \"column\", round(min({c}), 6)::double as min, {qs}, round(max({c}), 6)::double as max from scores"


@query("a30_score_distribution", " union all ".join(_dist(n, c) for n, c in (("iso_forest_raw_score", "iso"), ("mad_flag_ratio", "ratio"), ("mad_score_count", "cnt"))))
def _(w):
    return rounded(diagnostics.score_distribution(w.scores))


@query(
    "a31_ratio_what_if",
    f"select g::double as ratio, g = {C.CRITICAL} as is_current, count(*) filter (ratio >= g and isof = 1 and dq = 0) as confirmed, "
    "count(*) filter (ratio >= g and isof = 1 and dq = 1) as high_risk, count(*) as total, "
    "round(100.0::double * count(*) filter (ratio >= g and isof = 1) / count(*), 6) as pct "
    f"from judged, (select unnest([0.01, 0.05, 0.10, {C.CRITICAL}, 0.15, 0.20, 0.25, 0.30, 0.50])::double as g) group by g",
)
def _(w):
    return rounded(diagnostics.ratio_what_if(w.scores, C.CRITICAL))


@query(
    "a32_iso_what_if",
    f"with t as (select distinct round_even(unnest(quantile_cont(iso, [0.01, 0.02, 0.05, 0.1, 0.2, 0.5]) || [{C.ISO_THRESHOLD}::double]), 6) as t from judged) "
    f"select t as threshold, t = {C.ISO_THRESHOLD} as is_current, count(*) filter (iso < t) as iso_flagged, count(*) filter (iso < t and crit = 1 and dq = 0) as confirmed, "
    "count(*) filter (iso < t and crit = 1 and dq = 1) as high_risk, count(*) as total from judged, t group by t",
)
def _(w):
    # the score is read by two jobs: thresholds first, then the counts
    return diagnostics.iso_what_if(store.materialize(w.scores, "scores"), C.ISO_THRESHOLD)


ORACLE["a32_iso_what_if"] = C.with_ctes(
    f"select t as threshold, t = {C.ISO_THRESHOLD} as is_current, count(*) filter (iso < t) as iso_flagged, count(*) filter (iso < t and crit = 1 and dq = 0) as confirmed, "
    "count(*) filter (iso < t and crit = 1 and dq = 1) as high_risk, count(*) as total from judged, "
    f"(select distinct round_even(unnest(quantile_cont(iso, [0.01, 0.02, 0.05, 0.1, 0.2, 0.5]) || [{C.ISO_THRESHOLD}::double]), 6) as t from judged) group by t"
)


@query(
    "a33_score_drift",
    "select round(a, 6) as train_median, round(b, 6) as live_median, round(b - a, 6) as shift, abs(b - a) > 0.05 as drifted from "
    f"(select quantile_cont(raw, 500/999.0::double) - ({C.OFFSET}::double) as a from raw_h), (select quantile_cont(iso, 0.5) as b from judged)",
)
def _(w):
    raw = store.materialize(w.raw(w.history), "training-scores")
    points = IF.score_table(raw).first()["quantiles"]
    return rounded(diagnostics.score_drift(w.scores, [p - C.OFFSET for p in points]))


_share_sql = f"(({' + '.join(f'({f} is null)::int' for f in FEATURES)}) / 15.0::double)"


@query(
    "a34_missingness",
    f"select round(min(s), 6) as share_min, round(quantile_cont(s, 0.5), 6) as share_median, round(avg(s), 6) as share_mean, round(max(s), 6) as share_max, "
    f"count(*) filter (s > 0) as rows_with_missing, count(*) filter (s > {C.TOLERANCE}) as rows_over_tolerance, count(*) filter (s > {C.TOLERANCE}) as dq_rows, 'ok' as diagnosis "
    f"from (select {_share_sql} as s from fused_l)",
)
def _(w):
    scored = w.flagged(w.live)
    return rounded(diagnostics.missingness(w.live, scored, C.TOLERANCE))


@query(
    "a35_tolerance_what_if",
    f"select g::double as tolerance, g = {C.TOLERANCE} as is_current, count(*) filter (s > g) as dq_rows, count(*) as total, round(100.0::double * count(*) filter (s > g) / count(*), 6) as pct "
    f"from (select {_share_sql} as s from fused_l), (select unnest([0.05, 0.10, 0.15, 0.18, 0.20, 0.25, 0.30])::double as g) group by g",
)
def _(w):
    return rounded(diagnostics.tolerance_what_if(w.live, C.TOLERANCE))


_rates = " union all ".join(f"select '{f}' as feature, sum(fl_{f})::bigint as n, count(*) as total, round(sum(fl_{f})::double / count(*), 6) as rate from flag_l" for f in FEATURES)


@query("a36_feature_flag_rates", f"select * from ({_rates}) order by rate desc, feature")
def _(w):
    return rounded(diagnostics.feature_flag_rates(w.flagged(w.live)))


@query("a36b_dead_features", f"select feature from ({_rates}) where n = 0")
def _(w):
    return diagnostics.dead_features(w.flagged(w.live))


@query(
    "a37_user_coverage",
    "select trained_users, live_users, known_users, live_users - known_users as cold_start_users, round(100.0::double * (live_users - known_users) / live_users, 6) as cold_start_pct, "
    "(live_users - known_users) > 0.3 * live_users as many_cold_starts from (select (select count(*) from ubase) as trained_users, count(distinct usr) as live_users, "
    "count(distinct usr) filter (usr in (select usr from ubase)) as known_users from fused_l)",
)
def _(w):
    return rounded(diagnostics.user_coverage(w.live, baseline.user_baseline(w.fused(activity.HISTORY), w.params)))


@query("a38_threat_days", 'select usr as "user", sum(confirmed)::bigint as threat_days from scores group by usr having sum(confirmed) > 0')
def _(w):
    return diagnostics.threat_days(w.scores)


@query("a39_global_importance", f"select feature, mean_abs_shap, rank from ({_importance_sql})")
def _(w):
    return _importance(w)


_shown = "iso <= 0.0 and d >= date '2024-01-24'"


@query(
    "a40_kpis",
    "select " + cols(f"count(*) filter (category = '{c}' and {_shown}) as {c}_shown" for c in ALERT_COLUMNS)
    + ", " + cols(f"count(*) filter (category = '{c}') as {c}_total" for c in ALERT_COLUMNS)
    + f", count(*) filter ({_shown}) as alerts_shown from report",
)
def _(w):
    shown = (F.col("iso_raw_score") <= 0.0) & (F.col("activity_date") >= F.lit(dt.date(2024, 1, 24)))
    return report.kpis(_typed_report(w), shown)


@query(
    "a41_timeline",
    "select d as activity_date, case category when 'confirmed_threat' then 'Confirmed Threat' when 'high_risk_review' then 'High Risk Review' else 'Telemetry Gap' end as category, count(*) as alerts from report group by all",
)
def _(w):
    return report.timeline(_typed_report(w))


@query("a42_score_range", "select round(min(iso), 6) as score_min, round(max(iso), 6) as score_max from report")
def _(w):
    return rounded(report.score_range(_typed_report(w)))


@query("a43_population_baseline", f"select feature, median, mad from ({_stats_rows('gbase0')})")
def _(w):
    blanket = w.fused(activity.HISTORY, fill="blanket")
    return rounded(baseline.global_baseline(blanket, w.params).select("feature", "median", "mad"))


@query("a44_mean_minus_std", "select round(avg(raw + 0.5) - stddev_pop(raw + 0.5), 6) as iso_threshold from raw_h")
def _(w):
    return rounded(population.mean_minus_std(w.raw(w.history)))


@query("a45_distinct_user_days", " union all ".join(f"select '{s}' as source, count(*) as user_days from {s}_l" for s in ("logon", "http", "email")))
def _(w):
    return fusion.coverage_counts(**w.sources(activity.LIVE))


@query(
    "a46_recommendations",
    f"""select row_number() over (order by o)::int as issue_no, issue, action from (
      select 1 as o, 'mad_critical_flag never fires' as issue, 'lower critical_flag_ratio or mad_threshold' as action where (select sum((ratio >= 0.99)::int) from judged) = 0
      union all select 2, 'iso_forest_flag never fires', 'raise iso_threshold, for example to the 5th percentile of the live scores' where (select sum(isof) from judged) = 0
      union all select 3, '{diagnostics.ISSUES["dq"]}', 'lower missing_data_tolerance or stop filling nulls before scoring' where (select sum(({_share_sql} > 0.9)::int) from judged) = 0)""",
)
def _(w):
    strict = w.model.override(critical_flag_ratio=0.99, missing_data_tolerance=0.9)
    return diagnostics.recommendations(model.score(w.live, strict))


# --- windows, sorts, limits, sampling, sets --------------------------------------------


@query("w01_importance_rank", f"select feature, rank from ({_importance_sql})")
def _(w):
    return _importance(w).select("feature", "rank")


@query("w02_contribution_order", f"select {UD}, pos::int as position, feature as feature_name, phi as shap_value from contrib_said")
def _(w):
    return attribution.contribution_rows(w.alerts()).select(*KEY, "position", "feature_name", "shap_value")


@query("w03_five_minute_bucket", "select time_bucket(interval '5 minutes', ts) as bucket, count(*) as n from events group by all")
def _(w):
    from dayglass.functions.timing import five_minutes

    return w.table("events").groupBy(five_minutes(F.col("ts")).alias("bucket")).agg(F.count("*").alias("n"))


@query("t01_top_contributions", f"select {UD}, pos::int as position, feature as feature_name from contrib_said where pos <= 3")
def _(w):
    top = w.alerts(top_n=3).select(*KEY, F.posexplode("top_contributors").alias("i", "c"))
    return top.select(*KEY, (F.col("i") + 1).alias("position"), F.col("c.feature_name").alias("feature_name"))


@query(
    "t02_top_threat_users",
    'select usr as "user", n as threat_days, usr not in (select usr from ubase) as cold_start from (select usr, sum(confirmed)::bigint as n from scores group by usr having sum(confirmed) > 0 order by n desc, usr limit 10)',
)
def _(w):
    return diagnostics.top_threat_users(w.scores, w.baseline)


@query("t03_sorted_rates", f"select feature, rate from ({_rates}) order by rate desc, feature")
def _(w):
    return rounded(diagnostics.feature_flag_rates(w.flagged(w.live)).select("feature", "rate"))


@query("t04_seeded_sample")
def _(w):
    history = w.history
    return IF.sample_rows(history.select(*KEY), 200, 42, history.count())


@query("t05_sorted_dates", "select distinct d as activity_date from fused_a order by 1")
def _(w):
    return report.dates(w.fused())


@query("t06_first_cold_start_users", 'select distinct usr as "user" from fused_l where usr not in (select usr from ubase) order by 1 limit 10')
def _(w):
    return baseline.first_unknown_users(w.live, baseline.user_baseline(w.fused(activity.HISTORY), w.params))


@query("u01_intersect_users", 'select usr as "user" from fused_l intersect select usr from ubase')
def _(w):
    trained = baseline.user_baseline(w.fused(activity.HISTORY), w.params)
    return w.live.select("user").intersect(trained.select("user"))


@query("u02_except_users", 'select usr as "user" from fused_l except select usr from ubase')
def _(w):
    trained = baseline.user_baseline(w.fused(activity.HISTORY), w.params)
    return w.live.select("user").subtract(trained.select("user"))


@query("u03_except_user_days", f"select {UD} from (select usr, d from logon_a except select usr, d from email_a)")
def _(w):
    s = w.sources()
    return fusion.source_days(s["logon"]).subtract(fusion.source_days(s["email"]))


@query("u04_distinct_thresholds", f"select distinct round_even(unnest(quantile_cont(iso, [0.01, 0.02, 0.05, 0.1, 0.2, 0.5]) || [{C.ISO_THRESHOLD}::double]), 6) as threshold from judged")
def _(w):
    return diagnostics.live_thresholds(w.scores, C.ISO_THRESHOLD)


@query("u05_keyed_union", f"select {UD}, {cols(f'{f}::double as {f}' for f in FEATURES)}, has_logon, has_http, has_email from stack_a")
def _(w):
    return fusion.stack_sources(**w.sources())


# --- scoring --------------------------------------------------------------------------


_zs = cols(f"round(z_{f}, 6) as {f}" for f in FEATURES)


@query("m01_self_score", f"select {UD}, {_zs} from z_l")
def _(w):
    return rounded(baseline.self_scores(w.live, w.baseline, w.population, w.params))


@query(
    "m02_zero_mad_fallback",
    f"select {UD}, round(z_keyword_match_indicator, 6) as z_keyword, round(z_large_attachment_count, 6) as z_large "
    "from z_l where usr in (select usr from ubase where keyword_match_indicator_mad = 0 or large_attachment_count_mad = 0)",
)
def _(w):
    flat = "keyword_match_indicator_mad = 0 OR large_attachment_count_mad = 0"
    z = w.z(w.live).where("baseline_source = 'personal'").where(flat)
    return rounded(
        z.select(
            *KEY,
            F.col("z_keyword_match_indicator").alias("z_keyword"),
            F.col("z_large_attachment_count").alias("z_large"),
        )
    )


@query("m03_routing", f"select {UD}, days as history_days, src as baseline_source from z_l")
def _(w):
    return baseline.routed(w.live, w.baseline, w.population, w.params).select(*KEY, "history_days", "baseline_source")


@query(
    "m03b_routing_on_batch",
    f"select {UD}, case when src = 'personal' and count(*) over (partition by usr) >= {C.MIN_HISTORY // 2} then 'personal' else 'global_cold_start' end as baseline_source from z_l",
)
def _(w):
    from dataclasses import replace

    trained = baseline.user_baseline(w.fused(activity.HISTORY), w.params)
    batch = replace(w.params, route_on="live", min_history_days=C.MIN_HISTORY // 2)
    return baseline.routed(w.live, trained, w.population, batch).select(*KEY, "baseline_source")


_fl = cols(f"fl_{f} as {f}_flag" for f in FEATURES)


@query("m04_feature_flags", f"select {UD}, {_fl} from flag_l")
def _(w):
    return w.flagged(w.live).select(*KEY, *[f"{f}_flag" for f in FEATURES])


@query("m05_flag_counts", f"select {UD}, cnt as mad_score_count, obs as observed_feature_count from ratio_l")
def _(w):
    return w.flagged(w.live).select(*KEY, "mad_score_count", "observed_feature_count")


@query("m06_flag_ratio", f"select {UD}, round(ratio, 6) as mad_flag_ratio from ratio_l")
def _(w):
    return rounded(w.flagged(w.live).select(*KEY, "mad_flag_ratio"))


@query("m07_critical_flag", f"select {UD}, crit as mad_critical_flag from judged")
def _(w):
    return w.flagged(w.live).select(*KEY, flags.critical_flag(C.CRITICAL).alias("mad_critical_flag"))


@query("m08_data_quality_risk", f"select {UD}, dq as data_quality_risk from flag_l")
def _(w):
    expr = f"int({flags.MISSING_SHARE} > {C.TOLERANCE}D)"
    return w.live.select(*KEY, F.expr(expr).alias("data_quality_risk"))


@query("m09_fill_unobserved", f"select {UD}, {cols(f'round(coalesce(z_{f}, {C.FILL}::double), 6) as x_{f}' for f in FEATURES)} from z_l")
def _(w):
    return rounded(IF.model_input(w.z(w.live), C.FILL, None).select(*KEY, *[f"x_{f}" for f in FEATURES]))


@query("m10_robust_scaling", f"select {UD}, {cols(f'round((coalesce(z_{f}, {C.FILL}::double) - {i}/10.0::double) / ({i} + 0.5::double), 6) as x_{f}' for i, f in enumerate(FEATURES))} from z_l")
def _(w):
    scale = {f: (i / 10, i + 0.5) for i, f in enumerate(FEATURES)}
    return rounded(IF.model_input(w.z(w.live), C.FILL, scale).select(*KEY, *[f"x_{f}" for f in FEATURES]))


def _tree_rows(table: DataFrame) -> DataFrame:
    """What every grown tree must keep to, one row a tree."""
    leaf = F.col("feature").isNull()
    roots = table.withColumn("root", F.col("node") == F.min("node").over(W.partitionBy("tree")))
    return roots.groupBy("tree").agg(
        F.max(F.when(F.col("root"), F.col("samples"))).alias("root_samples"),
        F.sum(F.when(leaf, F.col("samples"))).alias("leaf_samples"),
        (F.count("*") % 2 == 1).alias("odd_nodes"),
        (F.count_if(leaf) == F.count_if(~leaf) + 1).alias("binary"),
        F.every(leaf == F.col("cut").isNull()).alias("cuts_inside_only"),
    )


def _tree_sql(rows: str) -> str:
    n = f"(select least({DETECTOR.subsample}, count(*)) from {rows})"
    return (
        f"select i::int as tree, {n} as root_samples, {n} as leaf_samples, true as odd_nodes, true as \"binary\", "
        f"true as cuts_inside_only from range({DETECTOR.trees}) t(i)"
    )


@query("m11_fit_forest", _tree_sql("fused_h"))
def _(w):
    x = IF.model_input(fusion.align(w.history), 0.0, None, prefix="")
    return _tree_rows(IF.fit_forest(x, w.history.count(), DETECTOR))


@query("m12_decision_score", f"select {UD}, round(iso, 6) as iso_forest_raw_score from judged")
def _(w):
    return rounded(w.scores.select(*KEY, "iso_forest_raw_score"))


@query("m13_iso_flag", f"select {UD}, isof as iso_forest_flag from judged")
def _(w):
    return w.scores.select(*KEY, "iso_forest_flag")


@query("m14_verdict", f"select {UD}, confirmed as confirmed_threat, review as high_risk_review, gap as telemetry_gap_flag from scores")
def _(w):
    return w.scores.select(*KEY, *ALERT_COLUMNS)


@query(
    "m15_threshold_override",
    f"select {UD}, (ratio >= 0.05)::int as mad_critical_flag, (iso < 0.01)::int as iso_forest_flag, ({_share_sql} > 0.05)::int as data_quality_risk from judged",
)
def _(w):
    loose = w.model.override(critical_flag_ratio=0.05, iso_threshold=0.01, missing_data_tolerance=0.05)
    return model.score(w.live, loose).select(*KEY, "mad_critical_flag", "iso_forest_flag", "data_quality_risk")


@query(
    "m16_calibrated_percentile",
    f"select {UD}, round(len(list_filter([%s], lambda p: p <= iso)) / 101.0::double, 6) as score_percentile from judged"
    % cols(f"({i}::double - 90) / 1000" for i in range(101)),
)
def _(w):
    points = [(i - 90) / 1000 for i in range(101)]
    return rounded(
        w.scores.select(
            *KEY, IF.calibrated_percentile(F.col("iso_forest_raw_score"), points).alias("score_percentile")
        )
    )


@query("m17_attribution_background")
def _(w):
    return detect.background(w.history, w.model)


@query("m18_tree_attribution", f"select {UD}, feature, phi from contrib")
def _(w):
    flagged = attribution.flagged_rows(w.scores).select(*KEY)
    ready = model.self_scored(w.live, w.model).join(flagged, list(KEY), "left_semi")
    phi = ready.withColumn("phi", IF.contributions(ready, w.model.forest))
    pairs = phi.select(*KEY, F.posexplode("phi").alias("i", "phi"))
    return pairs.select(
        *KEY,
        F.element_at(F.array(*map(F.lit, FEATURES)), F.col("i") + 1).alias("feature"),
        F.bround("phi", 6).alias("phi"),
    )


@query("m19_flagged_self_score", f"select {UD}, feature as feature_name, round_even(z, 4) as self_z_score from contrib")
def _(w):
    return attribution.contribution_rows(w.alerts()).select(*KEY, "feature_name", "self_z_score")


@query("m20_baseline_label", f"select {UD}, src as baseline_source from report")
def _(w):
    return w.alerts().select(*KEY, "baseline_source")


@query("m21_direction", f"select {UD}, feature as feature_name, direction from contrib_text")
def _(w):
    return attribution.contribution_rows(w.alerts()).select(*KEY, "feature_name", "direction")


@query("m21b_direction_absolute", f"select {UD}, feature as feature_name, case when z > 3.5 then 'elevated' when z < 0 then 'suppressed' else 'normal' end as direction from contrib")
def _(w):
    return attribution.contribution_rows(w.alerts(direction="absolute")).select(*KEY, "feature_name", "direction")


@query("m22_reason", f"select {UD}, feature as feature_name, said as plain_english from contrib_said")
def _(w):
    return attribution.contribution_rows(w.alerts()).select(*KEY, "feature_name", "plain_english")


@query(
    "m23_contribution_record",
    f"select {UD}, pos::int as position, feature as feature_name, round_even(x, 4) as raw_value, round_even(med, 4) as user_baseline, round_even(z, 4) as self_z_score, "
    "phi as shap_value, mad_flagged, direction, said as plain_english from contrib_said",
)
def _(w):
    return attribution.contribution_rows(w.alerts())


@query("m24_alert_category", f"select {UD}, category as threat_category from report")
def _(w):
    return w.alerts().select(*KEY, "threat_category")


@query(
    "m25_narrative",
    f"""select {UD}, trim('User ''' || usr || ''' on ' || d || ' was flagged as ''' || category || ''' with an Isolation Forest anomaly score of ' || printf('%.4f', round_even(iso, 4))
      || ' (lower = more anomalous). The strongest driver was ''' || f1 || ''': ' || s1 || ' Investigate the top 5 features listed below in priority order. '
      || case when src = 'global_cold_start' then 'Note: This user has limited history — scored against company-wide baseline.' else '' end) as narrative from report""",
)
def _(w):
    return w.alerts().select(*KEY, "narrative")


@query("m26_explain_failures", f"select {UD}, category as threat_category, 'attribution failed' as explain_error from report where category = 'confirmed_threat'")
def _(w):
    ready = model.self_scored(w.live, w.model)
    judged = attribution.flagged_rows(w.scores).select(*KEY, *ALERT_COLUMNS, "iso_forest_raw_score", "mad_critical_flag")
    broken = ready.join(judged, list(KEY)).withColumn(
        "x_emails_sent", F.when(F.col("confirmed_threat") == 0, F.col("x_emails_sent"))
    )
    explained = attribution.alerts(
        broken.withColumn("phi", IF.contributions(broken, w.model.forest)), w.params, C.FILL
    )
    return attribution.failed_alerts(explained)


@query("m27_flat_report", _report_sql)
def _(w):
    return rounded(_flat(w))


@query(
    "m28_severity_badge",
    f"select {UD}, case when confirmed = 1 then '🔴 CONFIRMED' when review = 1 then '🟠 REVIEW' when gap = 1 then '🟡 DATA GAP' else '⚪ CLEAN' end as severity from scores",
)
def _(w):
    typed = w.scores.select(*KEY, *[(F.col(c) == 1).alias(c) for c in ALERT_COLUMNS])
    return typed.select(*KEY, report.badge().alias("severity"))


@query("m29_z_band", f"select {UD}, feature as feature_name, case when round_even(z, 4) > 3.5 then 'red' when round_even(z, 4) > 2 then 'orange' else 'green' end as band from contrib")
def _(w):
    rows = attribution.contribution_rows(w.alerts())
    return rows.select(*KEY, "feature_name", report.z_band(F.col("self_z_score")).alias("band"))


@query(
    "m30_flag_split",
    f"select {UD}, array_to_string(list_filter([%s], lambda f: f is not null), ',') as flagged, array_to_string(list_filter([%s], lambda f: f is not null), ',') as unflagged from flag_l"
    % (
        cols(f"case when fl_{f} = 1 then '{f}' end" for f in FEATURES),
        cols(f"case when fl_{f} = 0 then '{f}' end" for f in FEATURES),
    ),
)
def _(w):
    split = report.flag_split(w.flagged(w.live))
    return split.select(
        *KEY,
        F.array_join("flagged_features", ",").alias("flagged"),
        F.array_join("unflagged_features", ",").alias("unflagged"),
    )


def _z0(f: str) -> str:
    return (
        f"(case when g.{f}_mad <> 0 then abs(0.6745::double * (x.{f} - g.{f}_med) / g.{f}_mad) "
        f"when x.{f} > g.{f}_med then 10::double else 0::double end)"
    )


def _population(w: World) -> dict:
    blanket = w.fused(activity.HISTORY, fill="blanket")
    return baseline.fetch_global(baseline.global_baseline(blanket, w.params))


def _blanket_flags(w: World) -> DataFrame:
    return population.population_flags(w.fused(activity.LIVE, fill="blanket"), _population(w))


@query("m31_population_score", f"select {UD}, {cols(f'round({_z0(f)}, 6) as {f}' for f in FEATURES)} from blanket_l x cross join gbase0 g")
def _(w):
    stats = _population(w)
    live = w.fused(activity.LIVE, fill="blanket")
    z = [F.expr(robust.population_score(f, stats[f]["median"], stats[f]["mad"])).alias(f) for f in FEATURES]
    return rounded(live.select(*KEY, *z))


_cnt0 = " + ".join(f"({_z0(f)} > 3.5)::int" for f in FEATURES)


@query("m32_population_critical", f"select {UD}, {_cnt0} as mad_score_count, ({_cnt0} >= 2)::int as mad_critical_flag from blanket_l x cross join gbase0 g")
def _(w):
    return _blanket_flags(w).select(*KEY, "mad_score_count", "mad_critical_flag")


@query("m33_population_quality", f"select {UD}, ({_share_sql} > 0.2)::int as data_quality_risk from fused_l")
def _(w):
    return population.population_flags(w.live, _population(w)).select(*KEY, "data_quality_risk")


@query(
    "m34_population_verdict",
    f"select {UD}, (c >= 2 and x.url_visits >= 3 and s <= 0.2)::int as confirmed_threat, (c >= 2 and x.url_visits >= 3 and s > 0.2)::int as high_risk_review, "
    "(s > 0.2 and not (c >= 2 and x.url_visits >= 3))::int as data_loss_ioc from "
    f"(select x.*, {_cnt0.replace('x.', 'b.')} as c, ({_share_sql.replace('(((', '((((').replace(' is null', ' is null')}) as s from fused_l x join blanket_l b on b.usr = x.usr and b.d = x.d cross join gbase0 g) x",
)
def _(w):
    # the forest flag is replaced by a rule, so that SQL can restate the fusion
    flagged = population.population_flags(w.live, _population(w))
    return flags.with_verdict(
        flagged.withColumn("iso_forest_flag", (F.col("url_visits") >= 3).cast("int")), "data_loss_ioc"
    ).select(*KEY, "confirmed_threat", "high_risk_review", "data_loss_ioc")


ORACLE["m34_population_verdict"] = C.with_ctes(
    f"select {UD}, (c >= 2 and url_visits >= 3 and s <= 0.2)::int as confirmed_threat, (c >= 2 and url_visits >= 3 and s > 0.2)::int as high_risk_review, "
    "(s > 0.2 and not (c >= 2 and url_visits >= 3))::int as data_loss_ioc from "
    f"(select b.usr, b.d, b.url_visits, {_cnt0.replace('x.', 'b.')} as c, n.s from blanket_l b cross join gbase0 g "
    f"join (select usr, d, {_share_sql} as s from fused_l) n on n.usr = b.usr and n.d = b.d)"
)


@query("m35_population_forest")
def _(w):
    fitted = population.fit_population(w.fused(activity.HISTORY, fill="blanket"))
    return population.score_population(w.fused(activity.LIVE, fill="blanket"), fitted)


# --- pipelines ------------------------------------------------------------------------


@query("e01_extract_features", f"select {UD}, {cols(f'{f}::double as {f}' for f in FEATURES)} from stack_a")
def _(w):
    return fusion.stack_sources(**w.sources()).select(*KEY, *FEATURES)


@query("e02_fuse", f"select {UD}, {cols(FEATURES)} from fused_a")
def _(w):
    return w.fused()


@query("e03_fit_detector", _tree_sql("fused_h"))
def _(w):
    fitted = model.fit(w.fused(activity.HISTORY), DETECTOR)
    return _tree_rows(fitted.forest_table)


@query(
    "e04_score_live",
    f"select {UD}, dq as data_quality_risk, {_fl}, cnt as mad_score_count, obs as observed_feature_count, round(ratio, 6) as mad_flag_ratio, crit as mad_critical_flag, "
    "round(iso, 6) as iso_forest_raw_score, isof as iso_forest_flag, confirmed as confirmed_threat, review as high_risk_review, gap as telemetry_gap_flag, src as baseline_source from scores",
)
def _(w):
    return rounded(w.scores)


_consistent_sql = (
    f"select {UD}, true as one_verdict, true as flags_add_up, true as ratio_holds, true as verdict_holds, "
    f"({_share_sql} > {Params().missing_data_tolerance})::int as data_quality_risk from fused_l"
)


def _consistent(scores: DataFrame) -> DataFrame:
    """What every scored row must keep to, whatever the fitted thresholds are."""
    both = (F.col("mad_critical_flag") == 1) & (F.col("iso_forest_flag") == 1)
    dirty = F.col("data_quality_risk") == 1
    flagged = sum((F.col(f"{f}_flag") for f in FEATURES), F.lit(0))
    return scores.select(
        *KEY,
        (sum((F.col(c) for c in ALERT_COLUMNS), F.lit(0)) <= 1).alias("one_verdict"),
        (flagged == F.col("mad_score_count")).alias("flags_add_up"),
        (F.abs(F.col("mad_flag_ratio") * F.col("observed_feature_count") - F.col("mad_score_count")) < 1e-9).alias("ratio_holds"),
        (
            (F.col("confirmed_threat") == (both & ~dirty).cast("int"))
            & (F.col("high_risk_review") == (both & dirty).cast("int"))
            & (F.col("telemetry_gap_flag") == (dirty & ~both).cast("int"))
        ).alias("verdict_holds"),
        "data_quality_risk",
    )


@query("e04b_fit_and_score", _consistent_sql)
def _(w):
    fitted = model.fit(w.fused(activity.HISTORY), DETECTOR)
    return _consistent(model.score(w.live, fitted))


@query("e05_evaluate", ORACLE["a27_evaluate"].replace("s.gap as p", "s.confirmed as p"))
def _(w):
    return diagnostics.evaluate(w.scores, w.labels)


ORACLE["e05_evaluate"] = ORACLE["a27_evaluate"].replace("s.gap as p", "s.confirmed as p")


@query("e06_explain_report", f"select {UD}, category as threat_category, round(iso, 6) as iso_raw_score, round(ratio, 6) as mad_flag_ratio, src as baseline_source, f1 as top1_feature, s1 as top1_reason from report")
def _(w):
    alerts = w.alerts()
    return rounded(
        alerts.select(
            *KEY, "threat_category", "iso_raw_score", "mad_flag_ratio", "baseline_source",
            F.get("top_contributors", F.lit(0)).getField("feature_name").alias("top1_feature"),
            F.get("top_contributors", F.lit(0)).getField("plain_english").alias("top1_reason"),
        )
    )


@query("e07_full_diagnostic")
def _(w):
    job = detect.run(w.logs, activity.HISTORY, activity.LIVE, DETECTOR, activity.KEYWORDS)
    sections = detect.full_diagnostics(job["scores"], job["live"], job["model"])
    parts = [
        df.select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("row"))
        for name, df in sections.items()
    ]
    return reduce(DataFrame.union, parts)


@query("e08_run")
def _(w):
    result = detect.run(
        w.logs, activity.HISTORY, activity.LIVE, DETECTOR, activity.KEYWORDS
    )
    return result["report"]


# --- beyond the surveyed queries ----------------------------------------------------


@query(
    "x01_feed_hits",
    f"""select {UD}, count(*) as feed_visits, count(distinct host) as feed_hosts from (
        select usr, cast(ts as date) as d, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) as host
        from http_log where usr <> 'SYSTEM') v
    where host in (select lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) as host from pages
        group by all having avg(length(html)) > (select avg(length(html)) from pages))
      and host <> '' group by usr, d""",
)
def _(w):
    pages = w.table("pages").select(feeds.host(F.col("url")).alias("host"), F.length("html").alias("size"))
    usual = pages.agg(F.avg("size")).first()[0]
    feed = pages.groupBy("host").agg(F.avg("size").alias("size")).where(F.col("size") > usual).select("host")
    return feeds.feed_hits(w.logs["http"], feed)


_roles_sql = "(select 'U' || lpad(cast(c_custkey as varchar), 5, '0') as usr, c_mktsegment as role from customer)"


def _roles(w: World) -> DataFrame:
    user = F.concat(F.lit("U"), F.lpad(F.col("c_custkey").cast("string"), 5, "0"))
    return w.table("customer").select(user.alias("user"), F.col("c_mktsegment").alias("role"))


@query(
    "x02_role_baseline",
    " union all ".join(
        f"select role, '{f}' as feature, round(quantile_cont({f}, 0.5), 6) as median, "
        f"round(mad({f}) / 0.6744897501960817::double, 6) as mad, round(quantile_cont({f}, 0.95), 6) as p95 "
        f"from fused_h join {_roles_sql} r using (usr) group by role having count({f}) > 0"
        for f in FEATURES
    ),
)
def _(w):
    return rounded(roles.role_baseline(w.history, _roles(w), w.params))


@query(
    "x02b_role_route",
    f"""select x.usr as "user", x.d as activity_date, r.role, case when u.usr is not null then 'personal'
        when r.role in (select role from fused_h join {_roles_sql} using (usr)) then 'role' else 'global_cold_start' end as baseline_source
    from fused_l x left join {_roles_sql} r using (usr) left join ubase u using (usr)""",
)
def _(w):
    stats = roles.role_baseline(w.history, _roles(w), w.params)
    return roles.baseline_route(w.live, w.baseline, _roles(w), stats)
