"""The matching job as a stream: order, repeats, replays, time limit, saved pairs and running figures."""

from dataclasses import replace
from datetime import datetime
from pathlib import Path
from types import SimpleNamespace

import pytest
from conftest import SMALL
from pyspark.sql import Row
from pyspark.sql import functions as F

from placehull.functions.rings import wkt_to_ring
from placehull.operators import reports
from placehull.plans import queries as q
from placehull.plans.match import MatchJob
from placehull.session import stage
from placehull.sources.poi import prepare_poi, unresolved
from placehull.streaming import ledger, matching

IDS = [1, 2, 4, 5, 6, 8, 9, 10, 11, 12, 14, 50]
FIELDS = ("answered", "accepted", "called", "valid", "status", "uid", "uid_name", "search_rank", "score")


@pytest.fixture(scope="module")
def inputs(spark):
    """Some POIs, their responses with times, and given-up requests."""
    mine = F.col("poi_id").isin(IDS)
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    at = lambda minutes: (start + F.make_dt_interval(mins=minutes.cast("int"))).alias("ts")
    poi = stage(unresolved(prepare_poi(q.poi_table(spark, SMALL), q.NO_NAMES)).filter(mine), "poi")
    searches = q.captured(spark, SMALL, "search_response").filter(mine).select("poi_id", at(F.col("poi_id")), "body")
    answers = q.captured(spark, SMALL, "boundary_response").filter(mine).select("poi_id", "uid", at(F.col("poi_id") + F.col("search_rank")), "body")
    given_up = q._given_up(spark, SMALL).filter(mine).select("poi_id", "uid", at(F.col("poi_id") + 30))
    return poi, *(stage(df, "in") for df in (searches, answers, given_up))


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def run(spark, inputs, folder, parts, options=q.NO_NAMES, wait="24 hours", late="24 hours", interval=20):
    """Drain the sources after each part of the arrivals: (searches, boundaries, given up) each."""
    poi = inputs[0]
    schemas = (matching.SEARCH_SCHEMA, matching.BOUNDARY_SCHEMA, matching.GIVEN_UP_SCHEMA)
    for part in parts:
        for k, (rows, schema) in enumerate(zip(part, schemas)):
            empty = spark.createDataFrame([], schema)
            (empty if rows is None else rows).coalesce(1).write.mode("append").parquet(f"{folder}/in{k}")
        sources = [matching.read_stream(spark, f"{folder}/in{k}", s, 1) for k, s in enumerate(schemas)]
        changes = matching.changes(poi, sources[0], sources[1], options, sources[2], wait, late)
        ledger.start(changes, poi, f"{folder}/out", interval).awaitTermination()
    return f"{folder}/out"


def state_of(df):
    return {r.poi_id: tuple(r[c] for c in FIELDS) for r in df.collect()}


def batch_result(spark, inputs, options=q.NO_NAMES):
    poi, searches, answers, given_up = inputs
    job = MatchJob(poi, searches, answers, options, gave_up=given_up)
    best = job.best().select("poi_id", "uid", "uid_name", "search_rank", "score")
    rows = job.status().drop("uid", "uid_name").join(best, "poi_id", "left")
    matched = F.col("status") == "Matched"
    rows = rows.withColumns({c: F.when(matched, F.col(c)) for c in ("uid", "uid_name", "search_rank", "score")})
    return {k: v for k, v in state_of(rows).items()}


def test_any_order_repeats_and_restarts_give_the_batch_result(spark, inputs, tmp_path):
    _, searches, answers, given_up = inputs
    want = batch_result(spark, inputs)
    assert {v[4] for v in want.values()} >= {"Matched", None}
    broken = answers.withColumn("body", F.lit('{"content":{}}'))
    early = F.pmod(F.crc32("uid"), F.lit(2)) == 0
    parts = [(None, broken.filter(early), None), (searches, answers.filter(~early), given_up), (searches, answers, None)]
    folder = run(spark, inputs, str(tmp_path), parts)
    assert state_of(ledger.results(spark, folder)) == want


def test_first_result_only(spark, inputs, tmp_path):
    options = replace(q.NO_NAMES, use_first_uid=True)
    folder = run(spark, inputs, str(tmp_path), [inputs[1:]], options)
    assert state_of(ledger.results(spark, folder)) == batch_result(spark, inputs, options)


def test_time_limit_ends_the_state(spark, inputs, tmp_path):
    """A POI that is not finished in time is told of once, leaves the state, and later answers change nothing."""
    _, searches, answers, _ = inputs
    want = batch_result(spark, inputs)
    held_back = next(k for k, v in want.items() if v[4] == "Matched")
    mine = F.col("poi_id") == held_back
    last = F.to_timestamp(F.lit("2024-01-03 00:00:00"))
    clock = [df.filter("poi_id = 50").limit(1).withColumn("ts", last) for df in (searches, searches.withColumn("uid", F.lit("none")))]
    clock = (clock[0].select("poi_id", "ts", "body"), clock[1].select("poi_id", "uid", "ts", "body"), None)
    later = tuple(df if df is None else df.withColumn("ts", last + F.expr("interval '1' day")) for df in clock)
    first = answers.filter(~mine | (F.col("ts") == answers.filter(mine).agg(F.min("ts")).first()[0]))
    folder = run(spark, inputs, str(tmp_path), [(searches, first, None), clock, later, (None, answers.filter(mine), None)], wait="2 hours", late="10 minutes")
    rows = ledger.read_changes(spark, ledger.read_entries(spark, folder)).filter(mine).orderBy("batch_id").collect()
    assert [r.expired for r in rows][-1] and sum(r.expired for r in rows) == 1
    assert rows[-1].status is None and rows[-1].called < rows[-1].accepted == want[held_back][1]
    finished = {k: v for k, v in state_of(ledger.results(spark, folder)).items() if v[4]}
    alone = batch_result(spark, (*inputs[:3], inputs[3].limit(0)))
    assert finished == {k: v for k, v in alone.items() if v[4] and k != held_back}


def test_pairs_and_figures(spark, inputs, tmp_path):
    """A replayed batch adds nothing; each line equals the figures of the changes so far; pairs hold each change once."""
    poi = inputs[0]
    folder = run(spark, inputs, str(tmp_path), [inputs[1:]])
    entries = read = ledger.read_entries(spark, folder).orderBy("batch_id").collect()
    again = ledger.read_changes(spark, ledger.read_entries(spark, folder)).filter(F.col("batch_id") == read[-1].batch_id).drop("batch_id")
    ledger.commit_batch(again, read[-1].batch_id, poi, folder, 20)
    ledger.close(spark, poi, folder)
    ledger.close(spark, poi, folder)
    after = ledger.read_entries(spark, folder).orderBy("saves").collect()
    assert len(after) <= len(entries) + 1 and after[-1].saved is not None
    calls = [r.calls for r in entries]
    for before, now in zip([None, *entries], entries):
        passed = now.calls // 20 > (before.calls if before else 0) // 20
        assert passed == (now.saved is not None)
    changes = stage(ledger.read_changes(spark, ledger.read_entries(spark, folder)), "changes")
    for line in ledger.progress(spark, folder, len(IDS), len(IDS)).collect():
        so_far = ledger.newest(changes.filter(F.col("batch_id") <= line.batch_id))
        h = reports.histogram(so_far).first()
        assert (line.matched, line.no_uid, line.no_geometry, line.resolved) == (h.matched, h.no_uid, h.no_geometry, h.resolved)
        assert line.calls == so_far.agg(F.coalesce(F.sum("called"), F.lit(0))).first()[0] and line.progress.startswith(f"{h.matched}/")
    assert calls == sorted(calls)
    saved = {}
    for pair in ledger.saved_folders(spark, folder):
        rows = spark.read.csv(f"{pair}/poi_csv", header=True, quote='"', escape='"')
        saved |= {int(r.poi_id): (r.status, r.uid_name, r.ring) for r in rows.withColumn("ring", wkt_to_ring(F.col("geometry"))).collect()}
        features = spark.read.text(f"{pair}/aoi_geojson").count() if rows.filter("geometry is not null").count() else 0
        assert features == rows.filter("geometry is not null").count()
    want = batch_result(spark, inputs)
    heard = {k for k, v in want.items() if v[0] is not None}
    assert {k: v[:2] for k, v in saved.items()} == {k: (want[k][4], want[k][6]) for k in heard}
    assert all((v[2] is not None) == (v[0] == "Matched") for v in saved.values())


def test_plan_keeps_state_and_joins_in_time(spark, inputs, tmp_path):
    """The stream reads neither its own log nor all candidates: a time-bounded join and keyed state only."""
    _, searches, answers, given_up = inputs
    for k, df in enumerate((searches, answers, given_up)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{k}")
    schemas = (matching.SEARCH_SCHEMA, matching.BOUNDARY_SCHEMA, matching.GIVEN_UP_SCHEMA)
    sources = [matching.read_stream(spark, f"{tmp_path}/{k}", s) for k, s in enumerate(schemas)]
    plan = matching.changes(inputs[0], sources[0], sources[1], q.NO_NAMES, sources[2])._jdf.queryExecution().analyzed().toString()
    assert "LeftOuter" in plan and "TransformWithState" in plan and "Aggregate" not in plan


def test_state_of_a_poi_is_read_and_written_once_per_batch():
    """Not once per event: a POI with many candidates costs one read and one write of the store."""
    calls = []

    class Value:
        row = None

        def exists(self):
            return self.row is not None

        def get(self):
            calls.append("get")
            return self.row

        def update(self, row):
            calls.append("update")
            self.row = row

    class Handle:
        value = Value()

        def getValueState(self, name, schema):
            return self.value

        def registerTimer(self, at):
            calls.append("timer")

    matcher = matching.PoiMatcher(1000, False)
    matcher.init(Handle())
    ts = datetime(2024, 1, 1)
    fields = {"ts": ts, "answered": True, "n_results": 30, "valid": None, "pick": None, "keys": None, "geo": None, "called": None, "accepted": True}
    results = [Row(result=True, uid=f"u{i}", uid_name="n", search_rank=i + 1, **fields) for i in range(30)]
    answers = [Row(**{**fields, "result": False, "uid": f"u{i}", "called": True, "valid": i == 7, "pick": "a", "keys": [1.0], "geo": "g"}) for i in range(30)]
    first = list(matcher.handleInputRows((1,), iter(results), None))
    assert [(r.status, r.accepted, r.called) for r in first] == [(None, 30, 0)] and calls == ["timer", "update"]
    calls.clear()
    rows = list(matcher.handleInputRows((1,), iter(answers), None))
    assert [(r.status, r.uid, r.called, r.new_calls, r.geo) for r in rows] == [("Matched", "u7", 30, 30, "g")] and calls == ["get", "update"]


def test_answers_are_kept_once(spark, inputs, tmp_path):
    """One store of one operator: answers do not lie in the sides of a join as well."""
    folder = run(spark, inputs, str(tmp_path), [inputs[1:]])
    stores = {p.relative_to(f"{folder}/checkpoint/state").parts[0] for p in Path(f"{folder}/checkpoint/state").rglob("*.changelog")}
    assert stores == {"0"} and not list(Path(folder).rglob("*keyWithIndex*"))


def _matcher(wait_ms, late_ms):
    """A matcher over a store in memory, with the list of its timers."""

    class Value:
        row = None

        def exists(self):
            return self.row is not None

        def get(self):
            return self.row

        def update(self, row):
            self.row = row

        def clear(self):
            self.row = None

    value, timers = Value(), []
    matcher = matching.PoiMatcher(wait_ms, False, late_ms)
    matcher.init(SimpleNamespace(getValueState=lambda name, schema: value, registerTimer=timers.append))
    return matcher, value, timers


def _event(minute, result, uid, pick=None, valid=True, rank=1):
    ts = datetime(2024, 1, 1, 10, minute)
    return Row(ts=ts, result=result, answered=True, uid=uid, uid_name="n", search_rank=rank, accepted=result, valid=valid, keys=[1.0], called=True, pick=pick, geo=pick)


def test_answers_count_in_time_whatever_came_first():
    """Answers before their search, repeats, a better one too late, and a candidate that a second search names."""
    ten = 10 * 60_000
    matcher, value, timers = _matcher(wait_ms=2 * ten, late_ms=ten)
    assert not list(matcher.handleInputRows((1,), iter([_event(0, False, "a", "c"), _event(40, False, "a", "a"), _event(20, False, "b", "x", False)]), None))
    assert timers == [int(datetime(2024, 1, 1, 10, 50).timestamp() * 1000)] and value.exists()
    first = list(matcher.handleInputRows((1,), iter([_event(10, True, "a")]), None))
    assert [(r.status, r.called, r.valid, r.geo, r.ts.minute) for r in first] == [("Matched", 1, 1, "c", 10)]  # "a" came 30 minutes after the search
    again = list(matcher.handleInputRows((1,), iter([_event(10, False, "a", "d"), _event(30, False, "a", "b")]), None))
    assert [(r.status, r.called, r.new_calls, r.geo) for r in again] == [("Matched", 1, 0, "b")]
    assert not list(matcher.handleInputRows((1,), iter([_event(30, False, "a", "b")]), None))
    more = list(matcher.handleInputRows((1,), iter([_event(20, True, "b", rank=2), _event(20, True, "a")]), None))
    assert [(r.status, r.accepted, r.called, r.valid, r.geo) for r in more] == [("Matched", 2, 2, 1, "a")]


def test_answers_without_a_search_leave_the_state():
    matcher, value, timers = _matcher(wait_ms=1000, late_ms=60_000)
    for minute in (0, 5):
        assert not list(matcher.handleInputRows((1,), iter([_event(minute, False, "a", f"p{minute}")]), None))
    for at, left in zip(timers, (True, False)):
        assert not list(matcher.handleExpiredTimer((1,), None, SimpleNamespace(getExpiryTimeInMs=lambda at=at: at)))
        assert value.exists() == left
