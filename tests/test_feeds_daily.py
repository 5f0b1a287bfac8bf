import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dayglass.operators import feeds
from dayglass.operators.features import http_features

FEED = "domain string, verdict string, listed_from date, listed_to date"
LOG = "user string, url string, activity string, ts timestamp_ntz"


def day(n):
    return dt.date(2024, 1, n)


def at(n, hour=9):
    return dt.datetime(2024, 1, n, hour)


def indicator(spark, visits, entries):
    log = spark.createDataFrame([(u, url, "WWW Visit", ts) for u, url, ts in visits], LOG)
    got = http_features(log, feed=spark.createDataFrame(entries, FEED)).collect()
    return {(r["user"], r["activity_date"].day): r["keyword_match_indicator"] for r in got}


def test_longest_domain_and_days_decide(spark):
    entries = [
        ("Bad.example.", "block", day(3), day(6)),
        ("ok.bad.example", "allow", None, None),
        ("bad.example", "allow", day(4), day(5)),  # listed later than the first entry
        ("bad.example", "block", day(3), day(6)),  # the same once more
        ("tie.example", "allow", day(1), None),
        ("tie.example", None, day(1), None),  # blocks, and block goes first
        (None, "block", None, None),
        ("", "block", None, None),
    ]
    visits = [
        *[("a", "http://x.bad.example/p", at(d)) for d in (2, 3, 4, 5, 6)],
        ("b", "http://ok.bad.example", at(3)),
        ("b", "http://notbad.example", at(3)),
        ("b", "HTTP://BAD.example:8080/q", at(3)),
        ("c", "http://tie.example/", at(2)),
        ("c", "no url", at(2)),
        ("c", None, at(2)),
        ("SYSTEM", "http://tie.example/", at(2)),
    ]
    got = indicator(spark, visits, entries)
    assert got == {("a", 2): 0, ("a", 3): 1, ("a", 4): 0, ("a", 5): 1, ("a", 6): 0, ("b", 3): 1, ("c", 2): 1}


def test_empty_feed_and_empty_log(spark):
    assert indicator(spark, [("a", "http://x.example", at(2))], []) == {("a", 2): 0}
    assert indicator(spark, [], [("x.example", "block", None, None)]) == {}


def test_feed_does_not_add_rows_or_change_the_other_features(spark):
    log = spark.createDataFrame([("a", "http://x.example/1", "WWW Upload", at(2, 20)), ("b", None, "WWW Visit", at(2))], LOG)
    feed = spark.createDataFrame([("x.example", "block", None, None), ("example", "block", None, None)], FEED)
    rest = [c for c in http_features(log).columns if c != "keyword_match_indicator"]
    assert sorted(http_features(log, feed=feed).select(rest).collect(), key=str) == sorted(http_features(log).select(rest).collect(), key=str)


def verdict(host, on, entries):
    held = [
        (len(d), start or dt.date(1, 1, 1), v == "block")
        for d, v, start, end in entries
        if (host == d or host.endswith("." + d)) and (start is None or start <= on) and (end is None or on < end)
    ]
    return bool(held) and max(held)[2]


@pytest.mark.parametrize("seed", range(3))
def test_like_a_search_of_the_whole_feed(spark, seed):
    rng = random.Random(seed)
    labels = ["a", "b", "cc"]
    name = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    spans = [(rng.choice([None, day(rng.randint(1, 9))]), rng.choice([None, day(rng.randint(5, 14))])) for _ in range(40)]
    entries = [(name(), rng.choice(["block", "allow"]), *span) for span in spans]
    # one host holds a third of all rows
    visits = [(f"u{rng.randint(0, 3)}", "http://" + (name() if rng.random() < 0.7 else "a.b.cc") + "/", at(rng.randint(1, 14))) for _ in range(300)]
    want = {}
    for user, url, ts in visits:
        key = (user, ts.day)
        want[key] = want.get(key, 0) + verdict(url[7:-1], ts.date(), entries)
    assert indicator(spark, visits, entries) == want


def test_hosts_of_one_domain_are_dealt_to_many_keys(spark):
    visits = spark.range(2000).select(F.concat(F.lit("h"), F.col("id"), F.lit(".com")).alias("host"))
    assert visits.select(feeds._salt("host")).distinct().count() == feeds.SALTS
