import datetime as dt
import random
from collections import Counter
from math import log2

import pytest

from dayglass.operators import devices, files
from dayglass.sources import logs

DEVICES = "user string, pc string, activity string, ts timestamp_ntz"
FILES = "user string, filename string, ts timestamp_ntz"
ZERO = dt.datetime(2024, 1, 1)


def at(day, hour=0, minute=0, second=0):
    return dt.datetime(2024, 1, day, hour, minute, second)


def features(spark, rows, *window, **options):
    got = devices.device_features(spark.createDataFrame(rows, DEVICES), *window, **options).collect()
    return {(r["user"], r["activity_date"].day): tuple(r[f] for f in devices.DEVICE_FEATURES) for r in got}


def test_clashing_unclosed_and_stray_events(spark):
    rows = [
        ("a", "p1", "Disconnect", at(2, 1)),  # nothing is open
        ("a", "p1", "Connect", at(2, 8)),
        ("a", "p1", "Connect", at(2, 9)),  # clashes: the first ends here, unclosed
        ("a", "p1", "Disconnect", at(2, 10)),
        ("a", "p2", "Connect", at(2, 9, 30)),
        ("a", "p2", "Disconnect", at(2, 9, 40)),
        ("a", "p2", "Connect", at(2, 23)),  # never closed: ends at 11:00 of the next day
        ("a", "p3", "Connect", at(2, 11)),
        ("a", "p3", "Disconnect", at(2, 23, 0, 1)),  # a second too late
        ("b", "p1", "Connect", at(2, 11)),
        ("b", "p1", "Disconnect", at(2, 23)),  # just in time
        *[("b", "p1", "Connect", at(2, 11).replace(microsecond=m)) for m in (5, 999_999)],  # one second
        ("SYSTEM", "p1", "Connect", at(2)), (None, "p1", "Connect", at(2)), ("c", None, "Connect", at(2)),
        ("c", "p1", None, at(2)), ("c", "p1", "Connect", None), ("c", "p1", "other", at(2)),
    ]
    assert features(spark, rows) == {
        ("a", 2): (5, 3, 2 * 3600 + 12 * 3600 + 3600, 600, 3),
        ("a", 3): (0, 1, 11 * 3600, 0, 0),
        ("b", 2): (1, 1, 12 * 3600, 0, 0),
    }


def test_one_second_and_midnight(spark):
    rows = [
        ("a", "p", "Connect", at(2, 5)), ("a", "p", "Disconnect", at(2, 6)), ("a", "p", "Connect", at(2, 6)),
        ("a", "p", "Disconnect", at(3)),  # ends with the day
    ]
    assert features(spark, rows, cutoff=dt.timedelta(days=1)) == {("a", 2): (2, 1, 19 * 3600, 0, 0)}


def test_empty_log_and_bad_arguments(spark):
    assert features(spark, []) == {}
    for cutoff in (dt.timedelta(0), dt.timedelta(days=2), dt.timedelta(milliseconds=1500)):
        with pytest.raises(ValueError):
            features(spark, [], cutoff=cutoff)
    with pytest.raises(TypeError):
        features(spark, [], "2024-01-01")


def naive(rows, cutoff):
    """Second by second."""
    count, busy = Counter(), {}
    for user, pc in {(u, p) for u, p, _, _ in rows}:
        mine = sorted({(int((ts - ZERO).total_seconds()), kind == "Connect") for u, p, kind, ts in rows if (u, p) == (user, pc)})
        for i, (begin, opens) in enumerate(mine):
            if not opens:
                continue
            following = mine[i + 1] if i + 1 < len(mine) else (begin + cutoff + 1, True)
            end = min(begin + cutoff, following[0])
            closed = not following[1] and following[0] <= begin + cutoff
            count["n", user, begin // 86400] += 1
            count["unclosed", user, begin // 86400] += not closed
            for second in range(begin, end):
                busy.setdefault((user, second), set()).add(pc)
    days = {}
    for (user, second), pcs in busy.items():
        row = days.setdefault((user, second // 86400), [set(), 0, 0])
        row[0] |= pcs
        row[1] += 1
        row[2] += len(pcs) > 1
    return {
        (u, d + 1): (count["n", u, d], len(pcs), held, twice, count["unclosed", u, d]) for (u, d), (pcs, held, twice) in days.items()
    }


@pytest.mark.parametrize("seed", range(3))
def test_devices_like_second_by_second(spark, seed):
    rng = random.Random(seed)
    cutoff = rng.choice([600, 3600, 7000])
    rows = [
        # one user at one machine has most of the rows
        (*(("a", "p") if rng.random() < 0.6 else (rng.choice("ab"), rng.choice("pqr"))), rng.choice(["Connect", "Disconnect"]), ZERO + dt.timedelta(seconds=rng.randint(0, 200_000)))
        for _ in range(250)
    ]
    got = features(spark, rows, cutoff=dt.timedelta(seconds=cutoff))
    assert got == naive(rows, cutoff)
    assert features(spark, rows, dt.date(2024, 1, 2), dt.date(2024, 1, 3), cutoff=dt.timedelta(seconds=cutoff)) == {k: v for k, v in got.items() if k[1] == 2}


def activity(spark, rows, *window, **options):
    got = files.file_features(spark.createDataFrame(rows, FILES), *window, **options).collect()
    return {(r["user"], r["activity_date"].day): tuple(round(r[f], 9) for f in files.FILE_FEATURES) for r in got}


def test_names(spark):
    rows = [
        ("a", "C:\\x\\One.TXT", at(2)), ("a", "c:\\X\\one.txt", at(2)), ("a", "c:/x/y.d/none", at(2)), ("a", "", at(2)),
        ("a", "c:/x/y.d/t.tar.gz", at(2)), ("a", None, at(2)), ("a", "lost", None), ("SYSTEM", "s", at(2)), (None, "s", at(2)),
    ]
    # extensions txt twice, none twice, gz once
    assert activity(spark, rows) == {("a", 2): (5, 4, 4, 3, 4, round(-2 * 0.4 * log2(0.4) - 0.2 * log2(0.2), 9))}
    assert activity(spark, []) == {}


def naive_files(rows, days):
    sets, out = {}, {}
    for user, name, ts in rows:
        sets.setdefault((user, ts.day), []).append(name)
    for (user, day), names in sets.items():
        older = {n for (u, d), more in sets.items() if u == user and day - days < d < day for n in more}
        folder = lambda n: n.rpartition("/")[0]
        kinds = Counter(n.rpartition(".")[2] for n in names)
        entropy = -sum(c / len(names) * log2(c / len(names)) for c in kinds.values())
        out[user, day] = (
            len(names), len(set(names)), len(set(names) - older), len({folder(n) for n in names} - {folder(n) for n in older}),
            len(older | set(names)), entropy,
        )
    return out


@pytest.mark.parametrize("days", [1, 3, 7])
def test_files_like_sets_and_from_a_state(spark, days):
    rng = random.Random(days)
    rows = [(rng.choice("aab"), f"d{rng.randint(0, 4)}/f{rng.randint(0, 9)}.{rng.choice(['x', 'y', 'z'])}", at(rng.randint(1, 28))) for _ in range(250)]
    want = {k: tuple(pytest.approx(v, abs=1e-8) for v in row) for k, row in naive_files(rows, days).items()}
    assert activity(spark, rows, days=days) == want
    start, end = dt.date(2024, 1, 15), dt.date(2024, 1, 24)
    part = {k: v for k, v in want.items() if 15 <= k[1] < 24}
    assert activity(spark, rows, start, end, days=days) == part
    log = spark.createDataFrame(rows, FILES).where("ts < '2024-01-15'")
    states = [files.last_seen(files.item_days(log.where(w))) for w in ("day(ts) <= 9", "day(ts) > 7")]  # they may overlap
    seen = files.merge_seen(*states, today=start, days=days)
    assert activity(spark, [r for r in rows if r[2].day >= 15], start, end, days=days, seen=seen) == part


def test_file_arguments(spark):
    for bad in ({"days": 0}, {"seen": spark.createDataFrame([], "user string, kind string, item string, activity_date date")}):
        with pytest.raises(ValueError):
            activity(spark, [], **bad)


def test_csv_logs(spark, tmp_path):
    (tmp_path / "d.csv").write_text("date,id,pc,user,activity\n01/02/2024 07:00:00,1,p,a,Connect\n")
    (tmp_path / "f.csv").write_text('id,date,user,pc,filename,content\n1,01/02/2024 07:00:00,a,p,x.doc,"one, ""two"""\n')
    assert [tuple(r) for r in logs.read_device_log(spark, str(tmp_path / "d.csv")).collect()] == [("a", "p", "Connect", at(2, 7))]
    assert [tuple(r) for r in logs.read_file_log(spark, str(tmp_path / "f.csv")).collect()] == [("a", "x.doc", at(2, 7))]


def test_sessions_and_items_are_derived_once(spark, tmp_path):
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation ")
    spark.createDataFrame([("a", "p", "Connect", at(2, 5))], DEVICES).write.parquet(f"{tmp_path}/devices")
    spark.createDataFrame([("a", "x/f.doc", at(2, 5))], FILES).write.parquet(f"{tmp_path}/files")
    window = dt.date(2024, 1, 1), dt.date(2024, 1, 9)
    sessions = spark.read.parquet(f"{tmp_path}/devices")
    assert scans(devices.device_features(sessions, *window)) == scans(devices.device_sessions(sessions))
    assert scans(files.file_features(spark.read.parquet(f"{tmp_path}/files"), *window)) == 1
