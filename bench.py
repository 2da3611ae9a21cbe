"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import Observation  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from placehull.plans.queries import QUERIES, captured  # noqa: E402
from placehull.session import build_session  # noqa: E402

INPUTS = ("search_result", "search_response", "boundary_response")
HEADLINE = (
    "best_in_box",
    "best_aoi_full",
    "weighted_rank",
    "match_status",
    "match_result",
    "ring_area",
    "candidate_filter",
    "circular_search",
    "name_similarity",
    "crs_bd09_to_wgs84",
    "progress_changes",
    "retry_attempts",
    "first_good_response",
    "stream_throughput",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session(
        f"local[{cpus}]",
        app="bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in INPUTS:  # stored input to every job: written before the clock starts
        captured(spark, sf_dir, name).count()
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    seconds, rows = {}, {}
    for name in names:
        runs = []
        for _ in range(repeats):
            started = time.perf_counter()
            out = Observation(name)
            QUERIES[name](spark, sf_dir).observe(out, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
            rows[name] = out.get["n"]
        seconds[name] = round(min(runs), 3)
    print(json.dumps({
        "metric": "total time of the headline queries, the better of the runs each",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "rows_per_sec": {n: round(rows[n] / seconds[n]) for n in names},
        "runs": repeats,
        "sf": Path(sf_dir).name,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
