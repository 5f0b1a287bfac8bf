"""Queries of what goes beyond the surveyed jobs: streams, drift, refits, bounded queues."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import ctes as C
from catalog.queries import ORACLE, UD, _user_stats, _user_table, cols, query, rnd, rounded
from catalog.world import World
from dayglass.contract import ALERT_COLUMNS, FEATURES, HTTP_FEATURES, KEY, LOGON_FEATURES
from dayglass.functions.timing import within
from dayglass.operators import attribution, baseline, devices, drift, explain_queue, files, gates
from dayglass.sources import activity, store
from dayglass.streaming import features as SF
from dayglass.streaming import scoring as SS

# --- X3: features and scores from streams -------------------------------------------

#: The logs arrive in these slices, one micro-batch each.
SLICES = [dt.date(2024, 1, d) for d in (1, 8, 15, 22)] + [dt.date(2024, 2, 1)]
FILES = 4
#: A larger log has a file a core in each slice, of at least so many of its rows in all.
FILE_ROWS = 100_000


def replayed(w: World, names, start: dt.date | None = None) -> dict[str, DataFrame]:
    """The logs written slice by slice and read as streams of one slice a micro-batch."""
    base = store.scratch_path(w.spark, "replay")
    streams = {}
    for name in names:
        log = store.materialize(within(w.logs[name], start, None), f"{name}-log")  # each slice reads it
        files = max(FILES, min(w.spark.sparkContext.defaultParallelism, log.count() // FILE_ROWS))
        for low, high in zip(SLICES, SLICES[1:]):
            within(log, low, high).repartition(files).write.mode("append").parquet(f"{base}/{name}")
        streams[name] = SF.read_log(w.spark, f"{base}/{name}", log.schema, files)
    return streams


def _closed(*logs: str) -> str:
    """Days that the watermark, a day behind the slowest log, has passed."""
    at = {"logon": "time_bucket(interval '5 minutes', ts)"}
    last = cols(f"(select max({at.get(log, 'ts')}) from {log}_log)" for log in logs)
    return f"d + interval 1 day <= least({last}) - interval 1 day"


def _days(w: World, days: DataFrame) -> DataFrame:
    path = store.scratch_path(w.spark, "days")
    SF.write_days(days, f"{path}/rows", f"{path}/checkpoint", availableNow=True).awaitTermination()
    return w.spark.read.schema(days.schema).parquet(f"{path}/rows")


@query("x03a_stream_logon", f"select {UD}, {cols(f'{f}::double as {f}' for f in LOGON_FEATURES)} from logon_a where {_closed('logon')}")
def _(w):
    return _days(w, SF.stacked_days(replayed(w, ["logon"]))).select(*KEY, *LOGON_FEATURES)


@query("x03b_stream_matrix", f"select {UD}, {cols(FEATURES)} from fused_a where {_closed('logon', 'http', 'email')}")
def _(w):
    return _days(w, SF.daily_matrix(replayed(w, w.logs), keywords=activity.KEYWORDS))


@query("x03c_stream_scores", f"{ORACLE['e04_score_live'][ORACLE['e04_score_live'].rindex('select ' + UD):]} where {_closed('logon', 'http', 'email')}")
def _(w):
    path = store.scratch_path(w.spark, "scoring")
    SS.publish(w.model, f"{path}/models")
    days = SF.daily_matrix(replayed(w, w.logs, activity.LIVE[0]), keywords=activity.KEYWORDS)
    SS.score_days(days, f"{path}/models", f"{path}/scores", f"{path}/checkpoint", availableNow=True).awaitTermination()
    return rounded(SS.read_scores(w.spark, f"{path}/scores").drop("query", "batch", "model_version"))


# --- X6: drift, retrain trigger, refit by one day ------------------------------------

_cuts = {f: f"list_distinct([{cols(f'quantile_cont({f}, {p})' for p in drift.DECILES)}])" for f in FEATURES}


def _bins(side: str) -> str:
    """Bins of each feature by the training deciles."""
    return " union all ".join(
        f"select '{f}' as measure, d, case when {f} is null then -1 else len(list_filter(c, lambda e: e < {f})) end as bin "
        f"from fused_{side}, (select {_cuts[f]} as c from fused_h)"
        for f in FEATURES
    )


_psi = f"""
with_sides as (
    select measure, bin, count(*) filter (side = 'h') as r, count(*) filter (side = 'l') as l
    from (select 'h' as side, * from ({_bins('h')}) union all select 'l', * from ({_bins('l')})) group by all
), totals as (
    select measure, sum(r)::bigint as n_reference, sum(l)::bigint as n_live,
           sum(r) filter (bin >= 0) as seen_r, sum(l) filter (bin >= 0) as seen_l
    from with_sides group by measure
), terms as (
    select measure, n_reference, n_live,
           greatest(r / n_reference, {drift.LEAST_SHARE}::double) as p, greatest(l / n_live, {drift.LEAST_SHARE}::double) as q,
           sum(case when bin >= 0 then r end) over w / seen_r as below_r, sum(case when bin >= 0 then l end) over w / seen_l as below_l
    from with_sides join totals using (measure) window w as (partition by measure order by bin)
), psi as (
    select measure, n_reference, n_live, sum((q - p) * ln(q / p)) as psi, max(abs(below_r - below_l)) as distance from terms group by all
)"""


def _with_psi(select: str) -> str:
    """The statement with the expressions above put behind the shared ones."""
    whole = C.with_ctes(f"select * from ({_bins('h')} union all {_bins('l')})")
    head = whole[: whole.rindex("\nselect * from (")]
    return f"{head}, {_psi}\n{select}"


def _sketches(w: World) -> tuple[DataFrame, DataFrame]:
    cuts = drift.training_cuts(w.history)
    path = store.scratch_path(w.spark, "sketches")
    for side, df in (("history", w.history), ("live", w.live)):
        drift.write_sketch(drift.sketch(df, cuts), f"{path}/{side}")
    return w.spark.read.parquet(f"{path}/history"), w.spark.read.parquet(f"{path}/live")


@query("x06a_day_sketches", f"select d as activity_date, measure, bin::int as bin, count(*) as n from ({_bins('l')}) group by all")
def _(w):
    return _sketches(w)[1].select("activity_date", "measure", "bin", "n")


@query("x06b_stability", "")
def _(w):
    history, live = _sketches(w)
    return rounded(drift.stability(drift.merged(history), drift.merged(live)))


ORACLE["x06b_stability"] = _with_psi("select measure, n_reference, n_live, round(psi, 6) as psi, round(distance, 6) as distance from psi")


@query("x06c_retrain_decision", "")
def _(w):
    history, live = _sketches(w)
    return drift.decisions(drift.stability(drift.merged(history), drift.merged(live))).select("measure", "verdict")


ORACLE["x06c_retrain_decision"] = _with_psi(
    f"select measure, case when n_live < 100 then 'too_few' when psi >= {drift.RETRAIN} then 'retrain' when psi >= {drift.WATCH} then 'watch' else 'stable' end as verdict from psi"
)


@query("x06d_refit_by_day", f'select usr as "user", days as history_days, {_user_stats} from ubase')
def _(w):
    last = activity.HISTORY[1] - dt.timedelta(1)
    path = store.scratch_path(w.spark, "matrix")
    store.write_by_day(w.history, path)
    days = w.spark.read.parquet(path)
    state = store.materialize(baseline.baseline_state(days.where(F.col("activity_date") < F.lit(last))), "state")
    day = baseline.baseline_state(days.where(F.col("activity_date") == F.lit(last)))
    return _user_table(baseline.baseline_from_state(baseline.merge_states(state, day), w.params))


# --- X1: a daily feed in the keywords' place ------------------------------------------


def _fed(w: World) -> World:
    """The same world with the web features of the feed."""
    feed = store.materialize(activity.threat_feed(w.spark, w.dir), "feed")
    return World(w.spark, w.dir, w.params, feed)


@query("x01b_feed_list", "select domain, verdict, listed_from::date as listed_from, listed_to::date as listed_to from feed_list")
def _(w):
    return activity.threat_feed(w.spark, w.dir)


@query("x01c_feed_feature", "")
def _(w):
    return _fed(w).fused().select(*KEY, *HTTP_FEATURES)


ORACLE["x01c_feed_feature"] = C.with_ctes(f"select {UD}, {cols(HTTP_FEATURES)} from fused_a", C.WITH_FEED)


@query("x01d_feed_scores", "")
def _(w):
    return rounded(_fed(w).scores)


_scores_sql = ORACLE["e04_score_live"]
ORACLE["x01d_feed_scores"] = C.with_ctes(_scores_sql[_scores_sql.rindex("select " + UD):], C.WITH_FEED)


# --- X4: devices and files ------------------------------------------------------------


@query("x04a_device_sessions", 'select usr as "user", pc, s as begins, e as ends, closed from device_held')
def _(w):
    return devices.device_sessions(activity.device_log(w.spark, w.dir))


@query("x04b_device_features", f"select {UD}, {cols(devices.DEVICE_FEATURES)} from device_days")
def _(w):
    return devices.device_features(activity.device_log(w.spark, w.dir))


@query("x04c_device_live", f"select {UD}, {cols(devices.DEVICE_FEATURES)} from device_days where d >= date '2024-01-21'")
def _(w):
    return devices.device_features(activity.device_log(w.spark, w.dir), *activity.LIVE)


@query("x04d_file_features", f"select {UD}, {cols(files.FILE_FEATURES)} from file_days")
def _(w):
    return rounded(files.file_features(activity.file_log(w.spark, w.dir)), files.ENTROPY_DIGITS)


@query("x04e_file_state", f"select {UD}, {cols(files.FILE_FEATURES)} from file_days where d >= date '2024-01-21'")
def _(w):
    log, start = activity.file_log(w.spark, w.dir), activity.LIVE[0]
    half = dt.date(2024, 1, 17)
    older, newer = files.item_days(within(log, None, half)), files.item_days(within(log, half, start))
    seen = files.merge_seen(files.last_seen(older), files.last_seen(newer), start)
    return rounded(files.file_features(log, start, seen=store.materialize(seen, "seen")), files.ENTROPY_DIGITS)


# --- features beside the fifteen ------------------------------------------------------


def _wide(w: World) -> World:
    """The same world with the device and file features, their names taken from the history."""
    found = gates.numeric_columns(World(w.spark, w.dir, w.params, wide=True).fused(activity.HISTORY))
    return World(w.spark, w.dir, replace(w.params, features=tuple(found)), wide=True)


def _wide_sql(select: str) -> str:
    return C.with_ctes(select, C.WITH_MORE)


@query("x07a_wide_matrix", "")
def _(w):
    return rounded(_wide(w).live)


ORACLE["x07a_wide_matrix"] = _wide_sql(f"select {UD}, {rnd(*C.WIDE)} from fused_l")


@query("x07b_wide_scores", "")
def _(w):
    return rounded(_wide(w).scores)


_wide_flags = cols(f"fl_{f} as {f}_flag" for f in C.WIDE)
ORACLE["x07b_wide_scores"] = _wide_sql(
    f"select {UD}, dq as data_quality_risk, {_wide_flags}, cnt as mad_score_count, obs as observed_feature_count, "
    "round(ratio, 6) as mad_flag_ratio, crit as mad_critical_flag, round(iso, 6) + 0.0::double as iso_forest_raw_score, isof as iso_forest_flag, "
    "confirmed as confirmed_threat, review as high_risk_review, gap as telemetry_gap_flag, src as baseline_source from scores"
)


@query("x07c_wide_explained", "")
def _(w):
    wide = _wide(w)
    return wide.alerts(top_n=3).select(*KEY, "threat_category", F.size("all_contributions").alias("features"))


ORACLE["x07c_wide_explained"] = _wide_sql(
    f"""select {UD}, case when review = 1 then 'high_risk_review' when confirmed = 1 then 'confirmed_threat' else 'telemetry_gap_flag' end as threat_category,
    {len(C.WIDE)} as features from scores where confirmed = 1 or review = 1 or gap = 1"""
)


# --- X5: a bounded number of explanations a run ---------------------------------------

#: Fewer than the flagged rows of the smallest table, so that every run overflows.
LIMIT = 12


@query(
    "x05_explain_queue",
    f"""select {UD}, case when place <= {LIMIT} then 1 when place <= {2 * LIMIT} then 2 else 3 end as run from (
        select usr, d, row_number() over (order by case when confirmed = 1 then 0 when review = 1 then 1 else 2 end,
            round(iso * 1000000)::bigint, md5(usr || '|' || cast(d as varchar)), usr, d) as place
        from scores where confirmed = 1 or review = 1 or gap = 1)""",
)
def _(w):
    flagged = store.materialize(attribution.flagged_rows(w.scores).select(*KEY, *ALERT_COLUMNS, "iso_forest_raw_score"), "flagged")
    first, rest = explain_queue.next_run(flagged, None, LIMIT)
    rest = store.materialize(rest, "overflow")
    second, rest = explain_queue.next_run(flagged.limit(0), rest, LIMIT)
    runs = [first.withColumn("run", F.lit(1)), second.withColumn("run", F.lit(2)), rest.withColumn("run", F.lit(3))]
    return runs[0].unionByName(runs[1]).unionByName(runs[2]).select(*KEY, "run")
