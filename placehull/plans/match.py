"""The batch matching job: POIs and captured responses in, statuses and best areas out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placehull.functions.rings import rings_wgs84
from placehull.operators.candidates import accept, judge_candidates
from placehull.operators.ordered import HOT_ROWS
from placehull.operators.outlines import aoi_metrics, attach_answers
from placehull.operators.ranking import best_per_poi, score_aois
from placehull.operators.status import completion, poi_status, write_back
from placehull.operators.validity import JUDGED_BY, judge_aois
from placehull.options import MatchOptions
from placehull.session import stage
from placehull.sources.poi import prepare_poi, unresolved
from placehull.sources.responses import decode_boundaries, decode_search, without_answer


@dataclass
class MatchJob:
    """Lazily chained steps of one run; ``aois`` and ``winners`` are its staged tables.

    ``gave_up`` (poi_id, uid): boundary requests that will get no answer. They count as called, so that their POI can be
    finished; a search that was given up leaves its POI open and needs no row.
    """

    poi: DataFrame
    search: DataFrame
    boundaries: DataFrame
    options: MatchOptions
    hot_rows: int = HOT_ROWS
    gave_up: DataFrame | None = None

    def __post_init__(self):
        self.prepared = unresolved(prepare_poi(self.poi, self.options))
        self.decoded = decode_search(self.search)
        self.judged = judge_candidates(self.prepared, self.decoded, self.options)
        self.accepted = accept(self.judged, self.options)
        self.outlines = decode_boundaries(self.boundaries)
        if self.gave_up is not None:
            self.outlines = self.outlines.unionByName(without_answer(self.gave_up))
        self.attached = attach_answers(self.accepted, self.outlines).drop("pick")
        judged = judge_aois(aoi_metrics(self.attached, self.options, keep=("geo",)), self.options)
        self.measured = judged.withColumn("geo", F.when(F.col("valid"), F.col("geo")))
        self._aois: DataFrame | None = None
        self._winners: DataFrame | None = None

    @property
    def aois(self) -> DataFrame:
        """Measured candidates, written once: counts, hot groups, ranks and winners read it."""
        return self._aois if self._aois is not None else self._staged(rings=False)

    def _staged(self, rings: bool) -> DataFrame:
        """Writes ``aois`` with what later steps read; with ``rings`` valid ones keep their encoded outline."""
        rows = self.measured.drop(*JUDGED_BY, *(() if rings else ("geo",)))
        self._aois = stage(rows, "aois")
        return self._aois

    def valid(self) -> DataFrame:
        return self.aois.where("valid").drop("geo")

    def scored(self) -> DataFrame:
        return score_aois(self.valid(), self.options, self.hot_rows)

    def best(self) -> DataFrame:
        return best_per_poi(self.scored(), "uid_name")

    @property
    def winners(self) -> DataFrame:
        """``best``, ranked and written once: outlines and the written-back result read it."""
        if self._winners is None:
            self._winners = stage(self.best(), "winners")
        return self._winners

    def status(self) -> DataFrame:
        return poi_status(self.prepared, self.decoded, completion(self.aois))

    def winners_with_rings(self) -> DataFrame:
        """Best areas with their outline, which is decoded for the winners alone.

        Encoded outlines of the winners are looked up among the staged valid candidates instead of being carried through
        the ranking, and instead of moving all responses once more.
        """
        aois = self.aois if "geo" in self.aois.columns else self._staged(rings=True)
        valid = aois.where("valid").select("poi_id", "uid", "geo")
        rows = valid.join(self.winners.select("poi_id", "uid"), ["poi_id", "uid"])
        rings = rings_wgs84(rows, ["poi_id", "uid"]).select("poi_id", F.col("ring").alias("geometry"))
        return self.winners.join(rings, "poi_id")

    def result(self, with_geometry: bool = True) -> DataFrame:
        if with_geometry and self._aois is None:
            self._staged(rings=True)
        best = self.winners_with_rings() if with_geometry else self.winners
        return write_back(self.status(), best)
