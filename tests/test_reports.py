import datetime as dt

from pyspark.sql import functions as F

from placehull.functions.text import duration_text, percent_text, remaining_text, speed_text
from placehull.operators import fetchlog, reports
from placehull.operators.status import poi_status
from placehull.sources.responses import decode_search


def test_duration_bounds(spark):
    values = [0.0, 59.4, 60.0, 61.0, 3600.0, 3661.0, 86400.0, 86401.0]
    df = spark.createDataFrame([(v,) for v in values], "s double")
    assert [r[0] for r in df.select(duration_text(F.col("s"))).collect()] == [
        "0s", "59s", "60s", "1min1s", "60min0s", "1h1min", "24h0min", ">24h"
    ]


def test_speed_and_rest(spark):
    df = spark.createDataFrame([(10, 20, 4.0), (0, 20, 4.0), (5, 20, 0.0)], "done int, todo int, s double")
    rows = df.select(speed_text(F.col("done"), F.col("s")), remaining_text(F.col("done"), F.col("todo"), F.col("s"))).collect()
    assert [tuple(r) for r in rows] == [
        ("2.50/s (9000/h)", "4s"), ("0.00/s (0/h)", "Inf"), ("nan/s (nan/h)", "nan")
    ]
    assert df.select(percent_text(F.col("done"), F.col("todo"))).first()[0] == "50.00%"


def test_histogram_and_finish(spark):
    rows = [("Matched",)] * 3 + [("No Uid",), ("No Geometry",), (None,)]
    df = spark.createDataFrame(rows, "status string")
    h = reports.histogram(df).first()
    assert (h.matched, h.no_uid, h.no_geometry, h.resolved, h.missing, h.total) == (3, 1, 1, 5, 1, 6)
    f = reports.finish_report(df).first()
    assert f.rerun and f.matched_text == "50.00%" and f.missing_text == "16.67%"
    assert reports.start_report(df).first().progress == "3/1/1/6 | 5 (83.33%)"
    assert not reports.finish_report(df.limit(0)).first().rerun


def test_progress_changes_only(spark):
    statuses = [None, "Matched", None, None, "No Uid", "Other", "No Geometry", "Matched"]
    df = spark.createDataFrame(list(enumerate(statuses)), "i int, status string")
    rows = reports.progress_changes(df, ["i"], len(statuses)).orderBy("i").collect()
    assert [(r.i, r.progress.split(" |")[0]) for r in rows] == [
        (1, "1/0/0/8"), (4, "1/1/0/8"), (6, "1/1/1/8"), (7, "2/1/1/8")
    ]


def test_status_derivation(spark):
    poi = spark.createDataFrame([(i, None) for i in range(1, 7)], "poi_id bigint, status string")
    bodies = [(1, '{"status":401}')] + [(i, '{"status":0,"results":[]}') for i in range(2, 6)]
    decoded = decode_search(spark.createDataFrame(bodies, "poi_id bigint, body string"))
    counts = spark.createDataFrame(
        [(3, 2, 1, 1), (4, 2, 2, 1), (5, 2, 2, 0)], "poi_id bigint, accepted bigint, called bigint, valid bigint"
    )
    got = {r.poi_id: r.status for r in poi_status(poi, decoded, counts).collect()}
    assert got == {1: None, 2: "No Uid", 3: None, 4: "Matched", 5: "No Geometry", 6: None}


def log(spark, rows):
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame(
        [(q, i, start + dt.timedelta(seconds=t), s) for i, (q, t, s) in enumerate(rows)],
        "request_id bigint, event_id bigint, ts timestamp, http_status int",
    )


def test_fetch_log(spark):
    rows = [(1, 0, 503), (1, 1, 403), (1, 2, 200), (1, 3, 200)]
    rows += [(2, t, 503) for t in range(4)] + [(3, 0, 404)]
    df = log(spark, rows)
    for hot in (1_000_000, 2):
        numbered = {(r.request_id, r.event_id): r.attempt for r in fetchlog.attempts(df, hot).collect()}
        assert numbered == {(1, 0): 1, (1, 1): 2, (1, 2): 3, (1, 3): 4, (2, 4): 1, (2, 5): 2, (2, 6): 3, (2, 7): 4, (3, 8): 1}
    assert {r.request_id: r.gave_up for r in fetchlog.gave_up(df).collect()} == {1: False, 2: True, 3: False}
    assert {r.request_id: r.event_id for r in fetchlog.first_good(df).collect()} == {1: 2, 3: 8}
    assert {r.reason: r.n for r in fetchlog.retry_reasons(df).collect()} == {
        "503": 5, "403": 1, "total": 6, "max_reached": 1
    }
