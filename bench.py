"""Time the headline jobs; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) select the
data and the cores. Every query computes from the base tables.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalog.queries import QUERIES  # noqa: E402
from dayglass.session import local_session  # noqa: E402

HEADLINE = (
    "a01_logon_buckets",
    "e01_extract_features",
    "j01_fuse_full_outer",
    "j09_coverage_anti_join",
    "a18_user_baseline",
    "a17_global_baseline",
    "m01_self_score",
    "m06_flag_ratio",
    "a21_critical_flag_ratio",
    "m11_fit_forest",
    "e04_score_live",
    "a31_ratio_what_if",
    "a27_evaluate",
    "m27_flat_report",
    "e04b_fit_and_score",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(
        cpus, "dayglass-bench", **{"spark.python.sql.dataFrameDebugging.enabled": "false"}
    )
    QUERIES["j01_fuse_full_outer"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for key in HEADLINE:
        started = time.perf_counter()
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.perf_counter() - started, 3)
        print(key, seconds[key], file=sys.stderr, flush=True)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "user-day analytics headline jobs, total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
