"""DuckDB common table expressions the checks are written on.

They restate the definitions independently of the Spark code: window functions and
aggregates of DuckDB, full outer joins, and a CASE expression for the stump forest.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

LOGON = ["total_event_buckets", "off_hours_ratio", "unique_systems_accessed", "failed_login_ratio", "active_orphan_sessions"]
HTTP = ["url_visits", "upload_event_count", "keyword_match_indicator", "unique_external_domains", "after_hours_browsing"]
EMAIL = ["emails_sent", "external_recipients", "after_hours_emails", "attachments_sent", "large_attachment_count"]
ALL = LOGON + HTTP + EMAIL
NULLABLE = {"off_hours_ratio", "failed_login_ratio", "after_hours_browsing", "after_hours_emails", "external_recipients"}

WINDOWS = {
    "a": "TRUE",
    "h": "ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-21'",
    "l": "ts >= TIMESTAMP '2024-01-21'",
}
MIN_HISTORY = 17
THRESHOLD = 3.5
TOLERANCE = 0.18
# thresholds of the stump model
CRITICAL = 0.12
FILL = 0.25
OFFSET = -0.5
ISO_THRESHOLD = -0.005

CTES: dict[str, str] = {}

CTES["ev"] = """
  select event_id, ts, event_type, value, 'U' || lpad(cast(user_id as varchar), 5, '0') as usr,
         cast(json_extract_string(props, '$.k') as int) as k
  from events"""
CTES["logon_log"] = """
  select usr, 'PC-' || cast(cast(floor(k / 15.0) as int) as varchar) as pc, ts,
         case event_type when 'signup' then 'Logon' when 'view' then 'Logoff' else 'Login Failed' end as activity
  from ev where event_type in ('signup', 'view', 'error')"""
CTES["http_log"] = """
  select e.usr, p.url, e.ts,
         case e.event_type when 'purchase' then 'WWW Upload' else 'WWW Visit' end as activity
  from ev e join pages p on p.page_id = e.event_id % (select count(*) from pages)
  where e.event_type in ('click', 'purchase')"""
CTES["feed_list"] = """
  with sized as (
    select lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) as host, length(html) as size from pages
  ), named as (
    select host, size, (select avg(size) from sized) as usual, list_aggregate(string_split(host, '.')[-3:], 'string_agg', '.') as domain
    from sized where host <> ''
  )
  select domain, 'block' as verdict, date '2024-01-01' + cast(sum(size) % 20 as int) as listed_from,
         case when count(*) % 3 > 0 then date '2024-01-01' + cast(sum(size) % 20 as int) + 5 + cast(count(*) % 15 as int) end as listed_to
  from named group by domain having avg(size) > any_value(usual)
  union all
  select host, 'allow', date '2024-01-10', null from named where host <> domain group by host having max(size) <= any_value(usual)"""
CTES["http_feed"] = """
  with seen as (
    select distinct lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) as host, cast(ts as date) as d from http_log
  ), judged_hosts as (
    select host, d, verdict
    from seen join feed_list on (host = domain or ends_with(host, '.' || domain))
      and listed_from <= d and (listed_to is null or d < listed_to)
    qualify row_number() over (partition by host, d order by length(domain) desc, listed_from desc, verdict desc) = 1
  )
  select l.*, coalesce(j.verdict = 'block', false) as blocked
  from http_log l left join judged_hosts j
    on j.host = lower(regexp_extract(l.url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) and j.d = cast(l.ts as date)"""
CTES["email_log"] = """
  select usr, ts,
         case when k < 5 then null when k < 40 then 'a' || k || '@dtaa.com'
              when k < 55 then 'a@dtaa.com;b@example.net' else 'b' || k || '@example.net' end as recipient,
         cast(cast(floor(value * 10000) as bigint) as varchar) as email_size,
         case when k < 20 then '' when k < 25 then null
              else repeat('f.doc;', cast(floor(k / 40.0) as int)) || 'f.doc' end as attachment_count
  from ev where event_type in ('signup', 'click')"""
CTES["device_log"] = """
  select usr, 'PC-' || (k % 3) as pc, event_type not in ('view', 'error') as opens, epoch(date_trunc('second', ts))::bigint as sec from ev"""
CTES["device_held"] = """
  select usr, pc, sec as s, least(sec + 43200, coalesce(next_sec, sec + 43200)) as e,
         coalesce(not next_opens and next_sec <= sec + 43200, false) as closed
  from (select *, lead(sec) over w as next_sec, lead(opens) over w as next_opens
        from (select distinct * from device_log) window w as (partition by usr, pc order by sec, opens))
  where opens"""
CTES["device_part"] = """
  select usr, pc, day, greatest(s, day * 86400) as s, least(e, (day + 1) * 86400) as e
  from (select *, unnest(generate_series(s // 86400, greatest(e - 1, s) // 86400)) as day from device_held)"""
CTES["device_days"] = """
  with point as (
    select distinct usr, day, s as p from device_part union select distinct usr, day, e from device_part
  ), piece as (
    select usr, day, p, lead(p) over (partition by usr, day order by p) as q from point
  ), covered as (
    select usr, day, q - p as lasts, count(*) as open
    from piece join device_part d using (usr, day) where d.s <= p and q <= d.e group by usr, day, p, q
  ), timed as (
    select usr, day, sum(lasts)::bigint as held, coalesce(sum(lasts) filter (open >= 2), 0)::bigint as twice from covered group by all
  ), begun as (
    select usr, s // 86400 as day, count(*) as n, count(*) filter (not closed) as unclosed from device_held group by all
  ), machine as (
    select usr, day, count(distinct pc) as machines from device_part group by all
  )
  select usr, date '1970-01-01' + cast(day as int) as d, coalesce(n, 0) as device_sessions, machines as device_machines,
         coalesce(held, 0) as device_seconds, coalesce(twice, 0) as device_overlap_seconds, coalesce(unclosed, 0) as device_unclosed_sessions
  from machine left join timed using (usr, day) left join begun using (usr, day)"""
CTES["file_log"] = r"""
  select usr, cast(ts as date) as d, lower('C:\R' || (k % 5) || '/f' || (k % 11) || (['.doc', '.PDF', '', '.tar.gz'])[k % 4 + 1]) as item,
         lower('C:\R' || (k % 5)) as folder, (['doc', 'pdf', '', 'gz'])[k % 4 + 1] as ext from ev"""
CTES["file_days"] = """
  with once as (select distinct usr, d, item from file_log), folders as (select distinct usr, d, folder from file_log),
  rolled as (
    select a.usr, a.d, count(distinct b.item) as rolling from (select distinct usr, d from once) a
    join once b on a.usr = b.usr and b.d between a.d - 6 and a.d group by all
  ), fresh as (
    select usr, d, count(*) as n from once a
    where not exists (select 1 from once b where b.usr = a.usr and b.item = a.item and b.d between a.d - 6 and a.d - 1) group by all
  ), fresh_folders as (
    select usr, d, count(*) as n from folders a
    where not exists (select 1 from folders b where b.usr = a.usr and b.folder = a.folder and b.d between a.d - 6 and a.d - 1) group by all
  )
  select l.usr, l.d, count(*) as file_events, count(distinct item) as distinct_files, coalesce(any_value(f.n), 0) as new_files,
         coalesce(any_value(g.n), 0) as new_folders, any_value(rolling) as rolling_files, round(entropy(ext), 9) as extension_entropy
  from file_log l left join fresh f using (usr, d) left join fresh_folders g using (usr, d) join rolled using (usr, d) group by l.usr, l.d"""
CTES["labels_t"] = """
  select usr, cast(ts as date) as d, cast(count(*) >= 2 as int) as label
  from ev where event_type = 'error' group by all"""

for w, where in WINDOWS.items():
    CTES[f"buckets_{w}"] = f"""
  select distinct usr, pc, activity, time_bucket(interval '5 minutes', ts) as b
  from logon_log where usr <> 'SYSTEM' and {where}"""
    CTES[f"logon_{w}"] = f"""
  select usr, cast(b as date) as d, count(*) as total_event_buckets,
         sum(case when dayofweek(b) in (0, 6) or hour(b) < 6 or hour(b) >= 18 then 1 else 0 end)::double / count(*) as off_hours_ratio,
         count(distinct pc) as unique_systems_accessed,
         sum(case when activity ilike '%fail%' then 1 else 0 end)::double / count(*) as failed_login_ratio,
         (count(*) filter (activity = 'Logon') - count(*) filter (activity = 'Logoff'))::bigint as active_orphan_sessions
  from buckets_{w} group by all"""
    CTES[f"http_{w}"] = f"""
  select usr, cast(ts as date) as d, count(url) as url_visits,
         count(*) filter (activity ilike '%upload%' or activity ilike '%post%') as upload_event_count,
         count(*) filter (url ilike '%page=%' or url ilike '%#top%') as keyword_match_indicator,
         count(distinct url) as unique_external_domains,
         count(*) filter (hour(ts) < 6 or hour(ts) >= 18) as after_hours_browsing
  from http_log where usr <> 'SYSTEM' and {where} group by all"""
    CTES[f"email_{w}"] = f"""
  select usr, cast(ts as date) as d, count(*) as emails_sent,
         count(*) filter (recipient not ilike '%@dtaa.com%') as external_recipients,
         count(*) filter (hour(ts) < 6 or hour(ts) >= 18) as after_hours_emails,
         sum(case when attachment_count is not null and attachment_count <> ''
             then length(attachment_count) - length(replace(attachment_count, ';', '')) + 1 else 0 end)::bigint as attachments_sent,
         count(*) filter (cast(email_size as integer) > 1000000) as large_attachment_count
  from email_log where usr <> 'SYSTEM' and {where} group by all"""
    CTES[f"stack_{w}"] = f"""
  select coalesce(l.usr, h.usr, e.usr) as usr, coalesce(l.d, h.d, e.d) as d,
         {', '.join(f'l.{f}' for f in LOGON)}, {', '.join(f'h.{f}' for f in HTTP)}, {', '.join(f'e.{f}' for f in EMAIL)},
         l.usr is not null as has_logon, h.usr is not null as has_http, e.usr is not null as has_email
  from logon_{w} l full join http_{w} h on l.usr = h.usr and l.d = h.d
       full join email_{w} e on coalesce(l.usr, h.usr) = e.usr and coalesce(l.d, h.d) = e.d"""
    CTES[f"fused_{w}"] = f"""
  select usr, d, {', '.join(f'{f}::double as {f}' if f in NULLABLE else f'coalesce({f}, 0)::double as {f}' for f in ALL)}
  from stack_{w}"""
    CTES[f"blanket_{w}"] = f"""
  select usr, d, {', '.join(f'coalesce({f}, 0)::double as {f}' for f in ALL)} from stack_{w}"""

#: The web features with the daily feed in the keywords' place.
WITH_FEED = {
    f"http_{w}": CTES[f"http_{w}"]
    .replace("url ilike '%page=%' or url ilike '%#top%'", "blocked")
    .replace("from http_log", "from http_feed")
    for w in WINDOWS
}

_stats = lambda f: (
    f"coalesce(quantile_cont({f}, 0.5), 0) as {f}_med, "
    f"coalesce(mad({f}), 0) / 0.6744897501960817::double as {f}_mad, "
    f"coalesce(quantile_cont({f}, 0.95), 0) as {f}_p95"
)
def _z(f: str) -> str:
    s = {k: f"case when u.usr is null then g.{f}_{k} else u.{f}_{k} end" for k in ("med", "mad", "p95")}
    x = f"x.{f}"
    return f"""case when {x} is null then null
      when ({s['mad']}) = 0 and ({s['p95']}) = ({s['med']}) then case when {x} <> ({s['med']}) then 4.5::double else 0::double end
      when ({s['mad']}) = 0 then case when {x} > ({s['p95']}) then 4.5::double else 0::double end
      else abs(0.6745::double * ({x} - ({s['med']})) / ({s['mad']})) end as z_{f},
      {s['med']} as m_{f}"""


CN = lambda n: f"(2 * (ln({n - 1}::double) + 0.5772156649::double) - 2 * {n - 1}::double / {n})"


def stump_counts(i: int) -> tuple[int, int, int]:
    """Samples left of the first cut, between the cuts, right of the second."""
    left, outer = (150 + 6 * i, 3 + i) if i < len(ALL) else (150, 16)
    return left, 256 - left - outer, outer


def _stump(i: int, f: str) -> str:
    a, b, c = stump_counts(i)
    x = f"coalesce(z_{f}, {FILL}::double)"
    return (
        f"case when {x} > {2 + i / 10}::double then 2 + {CN(c)} "
        f"when {x} > {0.5 + i / 10}::double then 2 + {CN(b)} else 1 + {CN(a)} end"
    )


def detector(names: list[str]) -> dict[str, str]:
    """Baselines, scores, flags and the stump forest over these features."""
    made = {
        "ubase": f"""
  select usr, count(*) as days, {', '.join(map(_stats, names))}
  from fused_h group by usr having count(*) >= {MIN_HISTORY}""",
        "gbase": f"select {', '.join(map(_stats, names))} from fused_h",
    }
    for w in ("h", "l"):
        made[f"z_{w}"] = f"""
  select x.*, coalesce(u.days, 0) as days,
         case when u.usr is null then 'global_cold_start' else 'personal' end as src, {', '.join(map(_z, names))}
  from fused_{w} x left join ubase u on u.usr = x.usr cross join gbase g"""
        made[f"flag_{w}"] = f"""
  select *, {', '.join(f'coalesce((z_{f} > {THRESHOLD})::int, 0) as fl_{f}' for f in names)},
         (({' + '.join(f'({f} is null)::int' for f in names)}) / {len(names)}.0::double > {TOLERANCE})::int as dq,
         ({' + '.join(f'({f} is not null)::int' for f in names)}) as obs
  from z_{w}"""
        made[f"ratio_{w}"] = f"""
  select *, ({' + '.join(f'fl_{f}' for f in names)}) as cnt,
         case when obs > 0 then ({' + '.join(f'fl_{f}' for f in names)})::double / obs else 0::double end as ratio
  from flag_{w}"""
        made[f"raw_{w}"] = f"""
  select *, -pow(2::double, -(({' + '.join(_stump(i, f) for i, f in enumerate(names))}) / {len(names)}) / {CN(256)}) as raw
  from ratio_{w}"""
    return made


_made = detector(ALL)
CTES.update({n: _made[n] for n in ("ubase", "gbase")})
CTES["gbase0"] = f"select {', '.join(map(_stats, ALL))} from blanket_h"
for w in ("h", "l"):
    CTES.update({f"{n}_{w}": _made[f"{n}_{w}"] for n in ("z", "flag", "ratio", "raw")})
CTES["judged"] = f"""
  select *, raw - ({OFFSET}::double) as iso, (ratio >= {CRITICAL})::int as crit,
         (raw - ({OFFSET}::double) < {ISO_THRESHOLD}::double)::int as isof
  from raw_l"""
CTES["scores"] = """
  select *, (crit = 1 and isof = 1 and dq = 0)::int as confirmed, (crit = 1 and isof = 1 and dq = 1)::int as review,
         (dq = 1 and not (crit = 1 and isof = 1))::int as gap
  from judged"""


def _phi(i: int, f: str) -> str:
    a, b, c = stump_counts(i)
    mean = f"(({a} * (1 + {CN(a)}) + {b} * (2 + {CN(b)}) + {c} * (2 + {CN(c)})) / 256)"
    return f"round_even(({_stump(i, f)} - {mean}) / 15, 6)"


_names = sorted(ALL)
CTES["contrib"] = "\n  union all\n".join(
    f"""  select usr, d, confirmed, review, gap, iso, ratio, src, '{f}' as feature, {_phi(ALL.index(f), f)} as phi, {f} as x,
         coalesce(z_{f}, {FILL}::double) as z, m_{f} as med, fl_{f} = 1 as mad_flagged
  from scores where confirmed = 1 or review = 1 or gap = 1"""
    for f in _names
)
CTES["contrib_text"] = f"""
  select *, case when z > {THRESHOLD} and x < med then 'suppressed' when z > {THRESHOLD} then 'elevated' else 'normal' end as direction
  from contrib"""
_two = lambda v: f"printf('%.2f', round_even({v}, 2))"
CTES["contrib_said"] = f"""
  select *, case direction
      when 'elevated' then '''' || feature || ''' was ' || {_two('x')} || ' — ' || printf('%.1f', round_even(z, 1)) || ' standard deviations above this user''s personal baseline of ' || {_two('med')} || '.'
      when 'suppressed' then '''' || feature || ''' was ' || {_two('x')} || ' — significantly below this user''s personal baseline of ' || {_two('med')} || '. Unusual suppression can indicate credential compromise or forced absence.'
      else '''' || feature || ''' was ' || coalesce({_two('x')}, 'nan') || ' (within normal range; baseline: ' || {_two('med')} || ').' end
      || case when mad_flagged then ' ⚠ Also flagged by the MAD statistical model.' else '' end as said,
      row_number() over (partition by usr, d order by abs(phi) desc, feature) as pos,
      case when review = 1 then 'high_risk_review' when confirmed = 1 then 'confirmed_threat' when gap = 1 then 'telemetry_gap_flag' else 'review' end as category
  from contrib_text"""
CTES["report"] = """
  select usr, d, any_value(category) as category, any_value(iso) as iso, any_value(ratio) as ratio, any_value(src) as src,
         max(case when pos = 1 then feature end) as f1, max(case when pos = 2 then feature end) as f2,
         max(case when pos = 1 then said end) as s1,
         max(case when pos = 1 then phi end) as p1, max(case when pos = 2 then phi end) as p2
  from contrib_said group by usr, d"""

DEVICE = ["device_sessions", "device_machines", "device_seconds", "device_overlap_seconds", "device_unclosed_sessions"]
FILE = ["file_events", "distinct_files", "new_files", "new_folders", "rolling_files", "extension_entropy"]


def _widened(w: str, when: str) -> str:
    """The fused matrix with the device and file features of its days."""
    kept = [f"f.{f}" if f in NULLABLE else f"coalesce(f.{f}, 0)::double as {f}" for f in ALL]
    more = [f"coalesce(m.{f}, 0)::double as {f}" for f in [*DEVICE, *FILE[:-1]]]
    return f"""
  select coalesce(f.usr, m.usr) as usr, coalesce(f.d, m.d) as d, {', '.join(kept + more)}, m.extension_entropy
  from ({CTES[f"fused_{w}"]}) f full join (select * from device_days full join file_days using (usr, d) where {when}) m
    on f.usr = m.usr and f.d = m.d"""


#: The chain with the device and file features beside the fifteen.
WIDE = [*ALL, *DEVICE, *FILE]
WITH_MORE = {
    **detector(WIDE),
    "fused_h": _widened("h", "d < date '2024-01-21'"),
    "fused_l": _widened("l", "d >= date '2024-01-21'"),
}

_ORDER = list(CTES)


def with_ctes(sql: str, changed: Mapping[str, str] = {}) -> str:
    """Prefix the expressions a query needs, in dependency order; `changed` ones stand in for ours."""
    ctes = {**CTES, **changed}
    needed: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in set(re.findall(r"\b[a-z]+(?:_[a-z]+|0)?\b", text)) & set(CTES) - needed:
            needed.add(name)
            todo.append(ctes[name])
    parts = [f"{n} as ({ctes[n]})" for n in _ORDER if n in needed]
    return f"with {', '.join(parts)}\n{sql}" if parts else sql
