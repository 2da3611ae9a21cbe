"""The matching job as one streaming query: search and boundary responses in, the state of each POI out.

    searches   -> parsed, judged -> an event per accepted candidate, one at least per response
    boundaries (and requests that were given up) -> left outer join with the POI table -> measured -> an event per answer
    both       -> state per POI (``PoiMatcher``), where answers meet candidates in time -> a row each time a POI's state changes

Outlines are measured against their POI before anything is kept, so one store holds all: per POI what its search found and the answers that came,
packed. An answer counts if it came at most ``late`` before and ``wait`` after a search answer with its candidate; it may arrive
first. Only POIs with new events are read. An event-time timer ends the state: ``wait`` after the search answer the POI leaves it, finished or
not, and a POI that is not stays open for the next run; answers no search answer can meet any more leave it as well.

Order of arrival, repeats and replays do not change the newest row of a POI: of several answers to one request the least by ``response_order``
counts, as in the batch job. A row tells how the POI stood before as well, so that sums of changes give running totals (``ledger``).

Known limits: each trigger joins the micro-batch's responses with the POI table; the candidates of one POI are ranked in one task (a
search service returns some tens).
"""

from __future__ import annotations

import json
import sys
import zlib
from collections import namedtuple
from collections.abc import Iterator
from dataclasses import replace
from datetime import datetime

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from placehull.functions.text import name_similarity
from placehull.operators.candidates import judge_candidates
from placehull.operators.outlines import aoi_metrics, response_order
from placehull.operators.ranking import rank_keys
from placehull.operators.status import MATCHED, NO_GEOMETRY, NO_UID
from placehull.operators.validity import judge_aois
from placehull.options import MatchOptions
from placehull.sources.responses import decode_boundaries, decode_search, without_answer

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SEARCH_SCHEMA = "poi_id bigint, ts timestamp, body string"
BOUNDARY_SCHEMA = "poi_id bigint, uid string, ts timestamp, body string"
GIVEN_UP_SCHEMA = "poi_id bigint, uid string, ts timestamp"
STATE_SCHEMA = "deadline bigint, status string, calls bigint, packed binary"
#: Fields of an event besides poi_id; those that are null are left out of its text.
EVENT_FIELDS = ("ts", "result", "answered", "uid", "uid_name", "search_rank", "accepted", "called", "valid", "pick", "keys", "geo")
Event = namedtuple("Event", EVENT_FIELDS, defaults=(None,) * len(EVENT_FIELDS))
CHANGE_SCHEMA = (
    "poi_id bigint, answered boolean, accepted bigint, called bigint, valid bigint, status string, uid string, uid_name string, "
    "search_rank int, score double, geo string, old_status string, new_calls bigint, ts timestamp, expired boolean"
)


def read_stream(spark, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Stream of captured rows from parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def search_events(poi: DataFrame, searches: DataFrame, options: MatchOptions) -> DataFrame:
    """Judged search results of the stream, one row at least per response of a POI."""
    decoded = decode_search(searches, carry=("ts",)).withColumn("answered", F.col("status_class") == "ok")
    return judge_candidates(poi, decoded, options, keep=("ts", "answered"), outer=True)


def _kept(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet the condition, by a generator as in ``candidates.passed``: a filter would be pushed below the steps with copies of them."""
    return rows.select("*", F.explode(F.when(condition, F.array(F.lit(True)))).alias("__keep")).drop("__keep")


def _sort_keys(options: MatchOptions, *names: str) -> Column:
    keys = rank_keys(options)
    return F.array(*[keys[f"rank_{n}"].cast("double") for n in names if f"rank_{n}" in keys]).cast("array<double>").alias("keys")


def result_events(judged: DataFrame, options: MatchOptions) -> DataFrame:
    """An event per accepted candidate, and the first row of each response, which tells that it came.

    ``valid`` and ``keys`` are what the candidate's name and place in the search say; without that sort all names will do.
    """
    accepted = F.col("search_rank").isNotNull() & F.col("reason").isNull()
    rows = _kept(judged, accepted | (F.coalesce("search_rank", F.lit(1)) == 1)).withColumn("accepted", accepted)
    alike = F.lit(True)
    if options.sort_by_similarity:
        rows = rows.withColumn("similarity", name_similarity(F.when(accepted, F.col("uid_name")), F.col("p_name")))
        alike = F.coalesce(F.col("similarity") >= options.min_similarity, F.lit(False))
    return rows.select(
        "poi_id", "ts", F.lit(True).alias("result"), "answered", *[F.when(F.col("accepted"), F.col(c)).alias(c) for c in ("uid", "uid_name")],
        "search_rank", "accepted", alike.alias("valid"), _sort_keys(options, "search_rank", "similarity"),
    )


def answer_events(poi: DataFrame, boundaries: DataFrame, given_up: DataFrame | None, options: MatchOptions, late: str) -> DataFrame:
    """Boundary answers measured against their POI; ``valid``: the outline fits. Whether they answer a candidate is found in the state.

    Left outer, so that only the table may become the side that is broadcast, whose size is known, and never a micro-batch.
    """
    answers = decode_boundaries(boundaries, carry=("ts",))
    if given_up is not None:
        answers = answers.unionByName(without_answer(given_up, carry=("ts",)))
    side = poi.select("poi_id", F.col("name").alias("p_name"), F.col("lng_wgs84").alias("p_lng"), F.col("lat_wgs84").alias("p_lat"), F.lit(True).alias("open"))
    joined = _kept(answers.withWatermark("ts", late).join(side, "poi_id", "leftOuter"), F.col("open") & F.col("uid").isNotNull()).withColumns({
        "aoi_key": F.struct("poi_id", "uid"), "called": F.lit(True), "search_rank": F.lit(None).cast("int"), "uid_name": F.lit(None).cast("string"),
    })
    shape = replace(options, sort_by_similarity=0, sort_by_search_rank=1)  # names are compared on the other side
    rows = judge_aois(aoi_metrics(joined, shape, keep=("geo", "ts")), shape)
    pick = response_order()
    return rows.select(
        "poi_id", "ts", F.lit(False).alias("result"), "uid", "called", "valid",
        F.concat(pick["none"].cast("string"), F.coalesce(pick["digest"], F.lit(""))).alias("pick"),
        F.when(F.col("valid"), _sort_keys(options, "area", "distance")).alias("keys"), F.when(F.col("valid"), F.col("geo")).alias("geo"),
    )


def changes(
    poi: DataFrame, searches: DataFrame, boundaries: DataFrame, options: MatchOptions, given_up: DataFrame | None = None,
    wait: str = "1 hours", late: str = "10 minutes",
) -> DataFrame:
    """Stream of ``CHANGE_SCHEMA`` rows: each POI with new events as it now stands.

    ``poi``: prepared, unresolved POIs (a table). ``wait``: how long after the search answer boundary answers count; ``late``: how much
    later than others a row may arrive. The newest row of a POI is its result.
    """
    judged = search_events(poi, searches.withWatermark("ts", late), options)
    events = result_events(judged, options).unionByName(answer_events(poi, boundaries, given_up, options, late), allowMissingColumns=True)
    events = events.select("poi_id", "ts", F.to_json(F.struct(*EVENT_FIELDS[1:])).alias("event"))
    spans = [F.expr(f"cast(interval {t} as interval second)").cast("decimal(18,3)") * 1000 for t in (wait, late)]
    wait_ms, late_ms = (int(ms) for ms in poi.sparkSession.range(1).select(*spans).first())
    return events.groupBy("poi_id").transformWithState(EventTextMatcher(wait_ms, options.use_first_uid, late_ms), CHANGE_SCHEMA, "Append", "EventTime")


def _micros(ts: datetime) -> int:
    return round(ts.timestamp() * 1_000_000)


class PoiMatcher(StatefulProcessor):
    """State of one POI: one value with its search answers, accepted candidates and all answers, and a timer.

    Judging a POI reads all of it anyway, so the whole state is read once and written once per micro-batch that tells of the POI. Candidates and
    answers are one compressed text in it (``_packed``): outlines are most of the state, and much of one recurs in itself and in others nearby.

    ``found``: uid -> [search rank, name, alike, keys, times of its search answers]; ``answers``: uid -> pick -> [valid, keys, geo, times]. Times are in
    microseconds. Answers to what no search answer has named are kept too, since another search answer may name it.
    """

    def __init__(self, wait_ms: int, first_only: bool, late_ms: int = 0):
        self.wait_ms, self.first_only, self.late_ms = wait_ms, first_only, late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        deadline, status, calls, searched, found, answers = self._open(self.state.get() if self.state.exists() else None)
        refused, searching, changed, newest = None, False, False, None
        for row in rows:
            if row.result:
                if not row.answered:
                    refused = row.ts if refused is None else max(refused, row.ts)
                    continue
                searching, at = True, _micros(row.ts)
                if at not in searched:
                    searched.append(at)
                    changed = True
                if deadline is None:
                    deadline = at // 1000 + self.wait_ms
                    self.handle.registerTimer(deadline)
                if row.accepted:
                    changed |= self._find(found, row, at)
            elif row.called:
                at = _micros(row.ts)
                newest = at if newest is None else max(newest, at)
                times = answers.setdefault(row.uid, {}).setdefault(row.pick, [row.valid, row.keys, row.geo, []])[3]
                if at not in times:
                    times.append(at)
                    changed = True
        if not searched:
            if changed:  # answers to a search whose own answer is on its way
                self.handle.registerTimer(newest // 1000 + self.late_ms)
                self.state.update(self._packed(deadline, status, calls, searched, found, answers))
            if refused is not None:  # a better answer may come; nothing to remember
                yield self._row(key[0], refused, answered=False)
            return
        if changed or searching:
            now = self._judge(found, answers)
            yield self._row(key[0], datetime.fromtimestamp(max(searched) / 1_000_000), answered=True, old_status=status, new_calls=now["called"] - calls, **now)
            if changed:
                self.state.update(self._packed(deadline, now["status"], now["called"], searched, found, answers))

    @staticmethod
    def _find(found: dict, row: Row, at: int) -> bool:
        """Enter an accepted candidate, of several with one uid that of the lowest rank; whether that is news."""
        had = found.get(row.uid)
        if had is None or row.search_rank < had[0]:
            alike = row.valid is None or row.valid
            found[row.uid] = [row.search_rank, row.uid_name, alike, list(row.keys or ()), sorted({at, *(had[4] if had else ())})]
            return True
        if at in had[4]:
            return False
        had[4].append(at)
        return True

    @staticmethod
    def _open(state: Row | None) -> tuple:
        if state is None:
            return None, None, 0, [], {}, {}
        *head, packed = state
        return *head, *json.loads(zlib.decompress(packed))

    @staticmethod
    def _packed(deadline, status, calls, *lists) -> tuple:
        return deadline, status, calls, zlib.compress(json.dumps(lists, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass"), 3)

    def _in_time(self, found: dict, answers: dict) -> dict:
        """For each candidate with answers in time the least of them: uid -> [valid, keys, geo]."""
        out = {}
        for uid in found.keys() & answers.keys():
            spans = [(t - self.late_ms * 1000, t + self.wait_ms * 1000) for t in found[uid][4]]
            picks = [p for p, a in answers[uid].items() if any(low <= t <= high for t in a[3] for low, high in spans)]
            if picks:
                out[uid] = answers[uid][min(picks)][:3]
        return out

    def _judge(self, found: dict, answers: dict) -> dict:
        """Counts, status and best area of what has come in so far."""
        if self.first_only and found:
            first = min(found, key=lambda u: (found[u][0], u))
            found = {first: found[first]}
        answers = self._in_time(found, answers)
        valid = {u: a for u, a in answers.items() if a[0] and found[u][2]}
        out = {"accepted": len(found), "called": len(answers), "valid": len(valid), "status": None}
        if not found:
            out["status"] = NO_UID
        elif len(answers) == len(found):
            out["status"] = MATCHED if valid else NO_GEOMETRY
        if out["status"] == MATCHED:
            tie = {u: (found[u][0], u) for u in valid}
            keys = {u: [*found[u][3], *a[1]] for u, a in valid.items()}
            scores = dict.fromkeys(valid, 0)
            kinds = len(next(iter(keys.values())))
            for k in range(kinds):
                for place, u in enumerate(sorted(valid, key=lambda u: (keys[u][k], *tie[u]))):
                    scores[u] += place
            best = min(valid, key=lambda u: (scores[u] / kinds, *tie[u]))
            out |= {"uid": best, "uid_name": found[best][1], "search_rank": found[best][0], "score": scores[best] / kinds, "geo": valid[best][2]}
        return out

    def _row(self, poi_id: int, ts, expired: bool = False, **values) -> Row:
        empty = dict.fromkeys(("answered", "accepted", "called", "valid", "status", "uid", "uid_name", "search_rank", "score", "geo", "old_status"))
        values = {"poi_id": poi_id, **empty, "new_calls": 0, "ts": ts, "expired": expired, **values}
        if not values["accepted"]:  # as in the batch job, where a POI without candidates has no counts
            values |= {"accepted": None, "called": None, "valid": None}
        return Row(**values)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The POI leaves the state; a row tells of it if it is not finished. Answers without a search leave it in silence."""
        if not self.state.exists():
            return
        deadline, status, _, searched, found, answers = self._open(self.state.get())
        if not searched:
            deadline = max(t for a in answers.values() for p in a.values() for t in p[3]) // 1000 + self.late_ms
        if expiredTimerInfo.getExpiryTimeInMs() < deadline:
            return  # set by answers that came before later ones or before the search
        if searched and status is None:
            yield self._row(key[0], datetime.fromtimestamp(deadline / 1000), answered=True, expired=True, **self._judge(found, answers))
        self.state.clear()

    def close(self) -> None:
        pass


class EventTextMatcher(PoiMatcher):
    """The matcher over events of three columns: each value of a row is converted on its own, so a text costs less than its fields."""

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        return super().handleInputRows(key, (Event(ts=ts, **json.loads(text)) for _, ts, text in rows), timerValues)
