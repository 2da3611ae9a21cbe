"""One named query per operator, run over the views derived from the test tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placehull.functions import coords, text
from placehull.functions.rings import (
    ring_to_wkt,
    rings_wgs84,
    vertices_wgs84,
    with_ring_numbers,
    wkt_to_ring,
)
from placehull.functions.utm import to_utm
from placehull.operators import fetchlog, gazetteer, nearby, ranking, reports, status
from placehull.operators.candidates import accept, judge_candidates, passed
from placehull.operators.outlines import aoi_metrics, measure_rings
from placehull.operators.validity import box_contains, judge_aois
from placehull.options import PRESETS, VAR, MatchOptions
from placehull.plans.derived import from_groups, search_groups, view
from placehull.plans.match import MatchJob
from placehull.session import scratch_path, stage, write_parquet
from placehull.sources import manifests, resulttable, sinks, spatial
from placehull.sources.poi import prepare_poi, read_poi_csv, unresolved, without_resolved
from placehull.sources.responses import (
    decode_boundaries,
    decode_search,
    flatten_results,
    status_class,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BY_ROW = MatchOptions(prim_ind=VAR, sec_ind=VAR)
NO_NAMES = replace(BY_ROW, sort_by_similarity=0)
SEARCH_ONLY = replace(NO_NAMES, sort_by_distance=0)
WITH_AREA = replace(NO_NAMES, sort_by_area=-1)
PRESET_1 = replace(PRESETS["residential"], prim_ind="BUILDING", sec_ind="CHINA")
PRESET_2 = PRESETS["mixed_large"]
SEARCH_RADIUS_M = 500
FLUSH_INTERVAL = BY_ROW.update_interval
DEGREES, METRES = 6, 3  # decimals kept in compared results


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(column: str | Column, digits: int = DEGREES, name: str | None = None) -> Column:
    label = name or column
    return F.round(column, digits).alias(label)


GROUPS_PER_FILE = 2048
_CAPTURED: dict[tuple[str, str, str], DataFrame] = {}


def captured(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A derived response view, made row by row of one table of grouped keys that is written once per session.

    Only the keys are stored: their texts are several times as many bytes, which every query would write and read.
    Spark would take a view for as small as the keys, so it is told not to broadcast it, and the files of the keys are kept
    small so that one task does not get more rows than it can shuffle in memory.
    """
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _CAPTURED:
        if name == "groups":
            _CAPTURED[key] = stage(search_groups(spark, sf), name, rows_per_file=GROUPS_PER_FILE)
        else:
            _CAPTURED[key] = from_groups(captured(spark, sf, "groups"), name).hint("merge")
    return _CAPTURED[key]


def poi_table(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "poi").withColumnRenamed("prior_status", "status")


def match_job(spark: SparkSession, sf: str, options: MatchOptions = NO_NAMES) -> MatchJob:
    """The job over the derived views, whose wgs84 points are first put into the input system."""
    poi = poi_table(spark, sf)
    if options.crs != "wgs84":
        poi = coords.convert(poi, "wgs84", options.crs)
    return MatchJob(
        poi,
        captured(spark, sf, "search_response"),
        captured(spark, sf, "boundary_response"),
        options,
    )


# --- coordinate systems ---------------------------------------------------------------------


def _crs_query(source: str, target: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = coords.convert(view(spark, sf, "poi"), source, target)
        return out.select("poi_id", rounded("lng"), rounded("lat"))

    run.__name__ = f"crs_{source}_to_{target}"
    return run


for _pair in (
    ("wgs84", "gcj02"), ("gcj02", "wgs84"), ("gcj02", "bd09"), ("bd09", "gcj02"),
    ("wgs84", "bd09"), ("bd09", "wgs84"),
):
    query(_crs_query(*_pair))


@query
def crs_bd09mc_to_bd09(spark, sf):
    out = coords.convert(captured(spark, sf, "search_result"), "bd09mc", "bd09", "cx", "cy")
    return out.select("poi_id", "uid", rounded("lng"), rounded("lat"))


@query
def crs_bd09mc_to_wgs84(spark, sf):
    out = coords.convert(captured(spark, sf, "search_result"), "bd09mc", "wgs84", "cx", "cy")
    return out.select("poi_id", "uid", rounded("lng"), rounded("lat"))


@query
def utm_project(spark, sf):
    out = to_utm(view(spark, sf, "poi"), [(("lng", "lat"), ("easting", "northing"))])
    return out.select("poi_id", rounded("easting", METRES), rounded("northing", METRES))


@query
def haversine_km(spark, sf):
    rows = captured(spark, sf, "search_result").join(
        view(spark, sf, "poi").select("poi_id", "lng", "lat"), "poi_id"
    )
    away = coords.haversine_km(
        F.col("u_lng").cast("double"), F.col("u_lat").cast("double"), F.col("lng"), F.col("lat")
    )
    return rows.select("poi_id", "uid", rounded(away, name="distance_km"))


@query
def outside_china(spark, sf):
    # points spread over a wider box than the POIs so that both answers occur
    wide = view(spark, sf, "poi").select(
        "poi_id",
        (F.col("lng") + F.col("poi_id") % 60 - 45).alias("lng"),
        (F.col("lat") + F.col("poi_id") % 70 - 45).alias("lat"),
    )
    return wide.select("poi_id", F.expr(coords.outside_china("lng", "lat")).alias("outside"))


@query
def poi_prepare(spark, sf):
    options = replace(BY_ROW, crs="gcj02", prim_ind="FIXED")
    out = prepare_poi(poi_table(spark, sf), options)
    return out.select(
        "poi_id", rounded("lng_wgs84"), rounded("lat_wgs84"), "prim_ind", "sec_ind", "status",
        "uid_name",
    )


@query
def poi_custom_transform(spark, sf):
    def mirror(lng, lat):
        return F.lit(240.0) - lng, lat

    from placehull.sources.poi import unify_crs

    out = unify_crs(poi_table(spark, sf), "wgs84", transform=mirror)
    return out.select("poi_id", rounded("lng_wgs84"), rounded("lat_wgs84"))


# --- search results and candidates ----------------------------------------------------------


@query
def flatten_search_results(spark, sf):
    rows = flatten_results(decode_search(captured(spark, sf, "search_response")))
    return rows.select(
        "poi_id", "uid", "uid_name", "search_rank", rounded("u_lng"), rounded("u_lat"), "u_tag"
    )


def _judged(spark, sf, options=BY_ROW) -> DataFrame:
    poi = unresolved(prepare_poi(poi_table(spark, sf), options))
    return judge_candidates(poi, decode_search(captured(spark, sf, "search_response")), options)


@query
def candidate_filter(spark, sf):
    rows = passed(_judged(spark, sf))
    return rows.select("poi_id", "uid", "uid_name", "search_rank", rounded("distance_km"))


@query
def candidate_reject_reason(spark, sf):
    return _judged(spark, sf).select("poi_id", "uid", "search_rank", "reason")


@query
def first_accepted(spark, sf):
    options = replace(BY_ROW, use_first_uid=True)
    return accept(_judged(spark, sf, options), options).select(
        "poi_id", "uid", "uid_name", "search_rank"
    )


@query
def service_status(spark, sf):
    return decode_search(captured(spark, sf, "search_response")).select(
        "poi_id", "service_status", "status_class"
    )


@query
def status_class_of_codes(spark, sf):
    log = view(spark, sf, "fetch_log")
    return log.select("event_id", "http_status", status_class(F.col("http_status")).alias("status_class"))


@query
def search_manifest(spark, sf):
    poi = prepare_poi(poi_table(spark, sf), BY_ROW)
    return manifests.search_manifest(poi, BY_ROW, key_slots=7)


@query
def boundary_manifest(spark, sf):
    return manifests.boundary_manifest(accept(_judged(spark, sf), BY_ROW))


@query
def resume_antijoin(spark, sf):
    poi = poi_table(spark, sf)
    return without_resolved(poi, poi.select("poi_id", "status")).select("poi_id", "name")


# --- rings ----------------------------------------------------------------------------------


def _outlines(spark, sf) -> DataFrame:
    return decode_boundaries(captured(spark, sf, "boundary_response"))


@query
def ring_decode(spark, sf):
    rows = vertices_wgs84(with_ring_numbers(_outlines(spark, sf)), keep=["poi_id", "uid"])
    return rows.select("poi_id", "uid", "pos", rounded("lng"), rounded("lat"))


def _measured_rings(spark, sf) -> DataFrame:
    points = to_utm(
        view(spark, sf, "poi").select("poi_id", "lng", "lat"), [(("lng", "lat"), ("p_e", "p_n"))]
    )
    rows = with_ring_numbers(_outlines(spark, sf)).drop("geo").join(points, "poi_id")
    rows = rows.withColumn("aoi_key", F.struct("poi_id", "uid"))
    rings = measure_rings(rows, "aoi_key", ["poi_id", "uid"], ("p_e", "p_n"), 50)
    return rings.where("edges is not null")


@query
def ring_bbox(spark, sf):
    box = ("min_lng", "min_lat", "max_lng", "max_lat")
    return _measured_rings(spark, sf).select("poi_id", "uid", *[rounded(c) for c in box])


@query
def ring_area(spark, sf):
    return _measured_rings(spark, sf).select("poi_id", "uid", "edges", rounded("area_km2"))


@query
def point_polygon_distance(spark, sf):
    return _measured_rings(spark, sf).select("poi_id", "uid", rounded("distance_m", METRES))


def _rounded_rings(spark, sf) -> DataFrame:
    rings = rings_wgs84(_outlines(spark, sf), ["poi_id", "uid"]).where("ring is not null")
    return rings.withColumn("ring", F.transform("ring", lambda v: F.struct(
        F.round(v["lng"], DEGREES).alias("lng"), F.round(v["lat"], DEGREES).alias("lat")
    )))


@query
def ring_wkt(spark, sf):
    return _rounded_rings(spark, sf).select("poi_id", "uid", ring_to_wkt(F.col("ring")).alias("wkt"))


@query
def wkt_decode(spark, sf):
    texts = _rounded_rings(spark, sf).select("poi_id", "uid", ring_to_wkt(F.col("ring")).alias("wkt"))
    rings = texts.select("poi_id", "uid", wkt_to_ring(F.col("wkt")).alias("ring"))
    # outer, and rows without a vertex dropped after it: else a filter with copies of all steps is put below them
    rows = rings.select("poi_id", "uid", F.posexplode_outer("ring").alias("pos", "v")).where("pos is not null")
    return rows.select("poi_id", "uid", "pos", F.col("v.lng").alias("lng"), F.col("v.lat").alias("lat"))


@query
def geojson_features(spark, sf):
    rows = _rounded_rings(spark, sf).withColumnRenamed("ring", "geometry")
    return sinks.geojson_features(rows.select("poi_id", "uid", "geometry"))


# --- validity, ranks, best area -------------------------------------------------------------


@query
def aoi_validity(spark, sf):
    attached = match_job(spark, sf).attached
    rows = judge_aois(aoi_metrics(attached, NO_NAMES, prune=False), NO_NAMES)
    return rows.select(
        "poi_id", "uid", "search_rank", "called", rounded("area_km2"),
        rounded("distance_m", METRES), "valid",
    )


@query
def name_similarity(spark, sf):
    rows = captured(spark, sf, "search_result").select("poi_id", "uid", "uid_name").join(
        view(spark, sf, "poi").select("poi_id", "name"), "poi_id"
    )
    ratio = text.name_similarity(F.col("uid_name"), F.col("name"))
    return rows.select("poi_id", "uid", ratio.alias("similarity")).select(
        "poi_id", "uid", rounded("similarity")
    )


def _rank_query(sort: str, options: MatchOptions) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        name = f"rank_{sort}"
        key = {name: ranking.rank_keys(options)[name]}
        ranked = ranking.ordinal_ranks(match_job(spark, sf, options).valid(), key)
        return ranked.select("poi_id", "uid", name)

    return run


QUERIES["rank_by_search"] = _rank_query("search_rank", NO_NAMES)
QUERIES["rank_by_area"] = _rank_query("area", WITH_AREA)
QUERIES["rank_by_distance"] = _rank_query("distance", NO_NAMES)
QUERIES["rank_by_similarity"] = _rank_query("similarity", BY_ROW)


@query
def weighted_rank(spark, sf):
    scored = match_job(spark, sf, WITH_AREA).scored()
    return scored.select(
        "poi_id", "uid", "rank_search_rank", "rank_area", "rank_distance", rounded("score")
    )


@query
def weighted_rank_split(spark, sf):
    """The same ranks with groups above 20 rows taking the range-partitioned way."""
    scored = ranking.score_aois(match_job(spark, sf, WITH_AREA).valid(), WITH_AREA, hot_rows=20)
    return scored.select(
        "poi_id", "uid", "rank_search_rank", "rank_area", "rank_distance", rounded("score")
    )


def _best_query(options: MatchOptions) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        best = match_job(spark, sf, options).best()
        return best.select("poi_id", "uid", "uid_name", "search_rank", rounded("score"))

    return run


QUERIES["best_aoi"] = _best_query(NO_NAMES)
QUERIES["best_aoi_full"] = _best_query(BY_ROW)
QUERIES["best_aoi_preset1"] = _best_query(PRESET_1)
QUERIES["best_aoi_preset2"] = _best_query(PRESET_2)


@query
def best_aoi_first_uid(spark, sf):
    best = match_job(spark, sf, replace(NO_NAMES, use_first_uid=True)).best()
    return best.select("poi_id", "uid", "uid_name", "search_rank", rounded("score"))


@query
def candidate_lists(spark, sf):
    pages = ranking.candidate_lists(match_job(spark, sf).valid(), ["uid", "uid_name"])
    return pages.select(
        "poi_id", "page", F.size("aois").alias("n"), F.array_join("aois.uid", ",").alias("uids")
    )


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Best-ranked candidate per POI whose outline box holds the point, straight through.

    With one sort on, the lowest key is the answer itself and no ranks are needed.
    """
    job = match_job(spark, sf, SEARCH_ONLY)
    metrics = aoi_metrics(job.attached, SEARCH_ONLY)
    inside = metrics.where(box_contains(F.col("p_lng"), F.col("p_lat")))
    pick = F.min(F.struct("search_rank", "uid", "uid_name")).alias("b")
    return inside.groupBy("poi_id").agg(pick).select(
        "poi_id", F.col("b.uid").alias("uid"), F.col("b.uid_name").alias("uid_name"),
        F.col("b.search_rank").alias("search_rank"),
    )


QUERIES["best_in_box"] = flagship


# --- status and reports ---------------------------------------------------------------------


@query
def completion(spark, sf):
    counts = status.completion(match_job(spark, sf).measured)
    return counts.withColumn("complete", status.is_complete())


def _given_up(spark, sf) -> DataFrame:
    """Boundary requests that failed more than three times within five days of being issued."""
    requests = captured(spark, sf, "boundary_request")
    window = F.expr("interval '5' day")
    return fetchlog.gave_up_requests(requests, view(spark, sf, "fetch_log"), window)


@query
def gave_up_requests(spark, sf):
    return _given_up(spark, sf)


def _job_with_given_up(spark, sf) -> MatchJob:
    return replace(match_job(spark, sf), gave_up=_given_up(spark, sf))


@query
def completion_given_up(spark, sf):
    """Completion where a request that was given up counts as called."""
    counts = status.completion(_job_with_given_up(spark, sf).measured)
    return counts.withColumn("complete", status.is_complete())


@query
def match_status_given_up(spark, sf):
    return _job_with_given_up(spark, sf).status().select(
        "poi_id", "answered", "accepted", "called", "valid", "status"
    )


@query
def match_status(spark, sf):
    return match_job(spark, sf).status().select(
        "poi_id", "answered", "accepted", "called", "valid", "status"
    )


@query
def match_result(spark, sf):
    rows = match_job(spark, sf).result()
    ring = F.transform("geometry", lambda v: F.struct(
        F.round(v["lng"], DEGREES).alias("lng"), F.round(v["lat"], DEGREES).alias("lat")
    ))
    return rows.select("poi_id", "status", "uid_name", ring_to_wkt(ring).alias("geometry"))


def _final_statuses(spark, sf) -> DataFrame:
    """Every POI: the status it came with, or the one this run gives it."""
    now = match_job(spark, sf).status().select("poi_id", F.col("status").alias("new_status"))
    both = poi_table(spark, sf).join(now, "poi_id", "left")
    return both.select("poi_id", F.coalesce("status", "new_status").alias("status"))


@query
def status_histogram(spark, sf):
    return reports.histogram(_final_statuses(spark, sf))


@query
def start_report(spark, sf):
    return reports.start_report(poi_table(spark, sf))


@query
def finish_report(spark, sf):
    out = reports.finish_report(_final_statuses(spark, sf))
    return out.withColumns({c: F.round(c, DEGREES) for c in ("matched_share", "missing_share")})


def _resolved_log(spark, sf) -> DataFrame:
    """Fetch log rows as resolution events: 200 matched, 404 no geometry, the rest still open."""
    log = view(spark, sf, "fetch_log")
    return log.select(
        "event_id", "request_id", "ts",
        F.when(F.col("http_status") == 200, status.MATCHED)
        .when(F.col("http_status") == 404, status.NO_GEOMETRY).alias("status"),
    )


@query
def throughput(spark, sf):
    log = _resolved_log(spark, sf)
    done = log.where(F.col("status").isNotNull())
    rows = log.agg(F.count("*").alias("n")).first()["n"]
    return reports.throughput(done, rows)


@query
def format_duration(spark, sf):
    log = view(spark, sf, "fetch_log")
    return log.select(
        "event_id", text.duration_text((F.col("event_id") * 37) % 100000 / 1.0).alias("duration")
    )


@query
def progress_changes(spark, sf):
    log = _resolved_log(spark, sf)
    total = log.count()
    out = reports.progress_changes(log, ["ts", "event_id"], total)
    return out.drop("ts")


@query
def flush_points(spark, sf):
    log = view(spark, sf, "fetch_log").select("event_id", "ts")
    return reports.flush_points(log, ["ts", "event_id"], FLUSH_INTERVAL).select("event_id", "calls")


# --- circular search, fetch log -------------------------------------------------------------


@query
def circular_search(spark, sf):
    poi = prepare_poi(poi_table(spark, sf), BY_ROW)
    places = captured(spark, sf, "search_result").select(
        F.concat_ws("/", F.col("poi_id").cast("string"), "uid").alias("place_id"),
        F.col("u_lng").cast("double").alias("lng"),
        F.col("u_lat").cast("double").alias("lat"),
    )
    pairs = nearby.circular_search(poi, places, SEARCH_RADIUS_M)
    return pairs.select("poi_id", "place_id", rounded("distance_km"))


@query
def circular_search_stored(spark, sf):
    """The same search over a stored gazetteer in tiles of at most 500 places."""
    folder = scratch_path(spark, "gazetteer")
    places = captured(spark, sf, "search_result").select(
        F.concat_ws("/", F.col("poi_id").cast("string"), "uid").alias("place_id"),
        F.col("u_lng").cast("double").alias("lng"),
        F.col("u_lat").cast("double").alias("lat"),
    )
    gazetteer.write_gazetteer(places, folder, tile_rows=500)
    poi = prepare_poi(poi_table(spark, sf), BY_ROW)
    pairs = gazetteer.search_stored(spark, folder, poi, SEARCH_RADIUS_M)
    return pairs.select("poi_id", "place_id", rounded("distance_km"))


@query
def retry_attempts(spark, sf):
    return fetchlog.attempts(view(spark, sf, "fetch_log")).select(
        "request_id", "event_id", "attempt", "http_status", "retryable"
    )


@query
def gave_up(spark, sf):
    return fetchlog.gave_up(view(spark, sf, "fetch_log"))


@query
def first_good_response(spark, sf):
    return fetchlog.first_good(view(spark, sf, "fetch_log")).select(
        "request_id", "event_id", "http_status"
    )


@query
def retry_reasons(spark, sf):
    return fetchlog.retry_reasons(view(spark, sf, "fetch_log"))


@query
def parse_failures(spark, sf):
    job = match_job(spark, sf)
    return fetchlog.parse_failures(job.decoded, with_ring_numbers(job.attached))


# --- sinks ----------------------------------------------------------------------------------


@query
def csv_roundtrip(spark, sf):
    """Matched rows through the CSV sink and the CSV scan, geometry decoded again."""
    folder = scratch_path(spark, "csv_roundtrip")
    rows = match_job(spark, sf).result().select(
        "poi_id", "name", "lng", "lat", "status", "uid_name", "lng_wgs84", "lat_wgs84", "geometry"
    )
    sinks.write_csv(rows, folder)
    back = prepare_poi(read_poi_csv(spark, folder, header=rows.columns), MatchOptions())
    return back.select(
        "poi_id", "name", rounded("lng"), rounded("lat"), "status", "uid_name",
        F.size("geometry").alias("points"),
    )


@query
def rings_in_box(spark, sf):
    """Outlines through the clustered parquet sink, read back by a box around the middle of the points."""
    folder = scratch_path(spark, "outlines")
    spatial.write_outlines(_rounded_rings(spark, sf).withColumnRenamed("ring", "geometry"), folder, row_group=1 << 16)
    rows = spatial.outlines_in_box(spark, folder, 116.30, 39.80, 116.45, 39.95)
    return rows.select("poi_id", "uid", *spatial.BOX)


@query
def numbered_csv(spark, sf):
    """POIs through CSV files without ids: a dense number by file and line, whatever the splits."""
    folder = scratch_path(spark, "numbered_csv")
    poi = view(spark, sf, "poi").select("poi_id", "name", "lng", "lat")
    poi.repartitionByRange(3, "poi_id").sortWithinPartitions("poi_id").drop("poi_id").write.csv(folder, header=True)
    return read_poi_csv(spark, folder).select("poi_id", "name")


@query
def resumed_results(spark, sf):
    """Two runs into one result table: first with the answers of the first five ranks, then the POIs left open."""
    folder = scratch_path(spark, "result_table")
    job = match_job(spark, sf)
    few = captured(spark, sf, "boundary_response").where("search_rank <= 5")
    first = replace(job, boundaries=few).result(with_geometry=False).select("poi_id", "status", "uid_name")
    resulttable.create(first, folder, buckets=16)
    rest = resulttable.still_open(poi_table(spark, sf), resulttable.read(spark, folder))
    second = replace(job, poi=rest).result(with_geometry=False).select("poi_id", "status", "uid_name")
    resulttable.upsert(second.where("status is not null"), folder, buckets=16)
    return resulttable.read(spark, folder)


# --- streaming ------------------------------------------------------------------------------


@query
def stream_completion(spark, sf):
    """All boundary responses through the two streaming queries, in several micro-batches.

    An empty response to every request arrives as well, in files of its own.
    """
    from placehull.streaming import completion as stream

    folder = scratch_path(spark, "stream_completion")
    source = f"{folder}/responses"
    groups = captured(spark, sf, "groups")
    responses = from_groups(groups, "boundary_response", by_uid=4).select("poi_id", "uid", "body")
    broken = from_groups(groups, "boundary_response", by_uid=2).select("poi_id", "uid", F.lit('{"content":{}}').alias("body"))
    write_parquet(broken, source)
    write_parquet(responses, source, mode="append")
    accepted = accept(_judged(spark, sf, NO_NAMES), NO_NAMES)
    arriving = stream.read_responses(spark, source, files_per_trigger=2)
    stream.measure(arriving, accepted, NO_NAMES, folder).awaitTermination()
    stream.finish(spark, NO_NAMES, folder).awaitTermination()
    return stream.read_results(spark, folder).select(
        "poi_id", "status", "uid", "uid_name", "search_rank", rounded("score")
    )


@query
def stream_throughput(spark, sf):
    """Fetch log as a stream, counted per hour; the window start is given as text."""
    from placehull.streaming import throughput as stream

    folder = scratch_path(spark, "stream_throughput")
    source = f"{folder}/log"
    view(spark, sf, "fetch_log").select("event_id", "ts").repartitionByRange(4, "ts").write.parquet(source)
    events = (
        spark.readStream.schema(spark.read.parquet(source).schema)
        .option("maxFilesPerTrigger", 2).parquet(source)
    )
    counts = stream.window_counts(events, late="30 days")
    stream.start(counts, folder).awaitTermination()
    rows = stream.latest(spark.read.parquet(f"{folder}/windows"))
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "n")


_RUNS: dict[tuple[str, str], str] = {}


def captured_streams(spark: SparkSession, sf: str, folder: str) -> dict[str, DataFrame]:
    """The response views with arrival times, as streams over files; given-up requests are told an hour after the search.

    A search answer of POI p comes in minute p % 600, its boundary answers a minute apart after it.
    """
    from placehull.streaming import matching as stream

    minute = F.col("poi_id") % 600
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))

    def at(minutes: Column) -> Column:
        return (start + F.make_dt_interval(mins=minutes.cast("int"))).alias("ts")

    # dealt out as narrow keys; the texts are made of them after that
    groups = captured(spark, sf, "groups").repartition(4, "poi_id")
    search, boundary = (from_groups(groups, name) for name in ("search_response", "boundary_response"))
    tables = {
        "searches": (search.select("poi_id", at(minute), "body"), stream.SEARCH_SCHEMA),
        "boundaries": (boundary.select("poi_id", "uid", at(minute + F.col("search_rank")), "body"), stream.BOUNDARY_SCHEMA),
        "given_up": (_given_up(spark, sf).select("poi_id", "uid", at(minute + 60)).repartition(4, "poi_id"), stream.GIVEN_UP_SCHEMA),
    }
    out = {}
    for name, (rows, schema) in tables.items():
        write_parquet(rows, f"{folder}/{name}")
        out[name] = stream.read_stream(spark, f"{folder}/{name}", schema, files_per_trigger=2)
    return out


def _streamed(spark: SparkSession, sf: str) -> str:
    """Folder of one drained run of the streaming job; the queries below read what it left."""
    from placehull.streaming import ledger
    from placehull.streaming import matching as stream

    key = (spark.sparkContext.applicationId, sf)
    if key not in _RUNS:
        folder = scratch_path(spark, "stream_match")
        sources = captured_streams(spark, sf, folder)
        poi = unresolved(prepare_poi(poi_table(spark, sf), NO_NAMES))
        changes = stream.changes(poi, options=NO_NAMES, wait="24 hours", late="24 hours", **sources)
        ledger.start(changes, poi, folder, FLUSH_INTERVAL).awaitTermination()
        ledger.close(spark, poi, folder)
        _RUNS[key] = folder
    return _RUNS[key]


@query
def stream_match(spark, sf):
    """Search and boundary responses and given-up requests as streams: the state of every open POI."""
    from placehull.streaming import ledger

    found = ledger.results(spark, _streamed(spark, sf)).drop("geo", "ts", "batch_id")
    poi = unresolved(prepare_poi(poi_table(spark, sf), NO_NAMES)).select("poi_id")
    return poi.join(found, "poi_id", "left").select(
        "poi_id", "answered", "accepted", "called", "valid", "status", "uid", "uid_name", "search_rank", rounded("score")
    )


@query
def stream_saved(spark, sf):
    """The CSV files of all saved pairs, newest row per POI, geometry decoded."""
    from placehull.streaming import ledger

    folders = ledger.saved_folders(spark, _streamed(spark, sf))
    header = ["poi_id", "status", "uid_name", "geometry", "save"]
    parts = None
    for k, folder in enumerate(folders):
        rows = spark.read.csv(f"{folder}/poi_csv", header=True, quote='"', escape='"')
        rows = rows.select(F.col("poi_id").cast("long"), "status", "uid_name", "geometry", F.lit(k).alias("save"))
        parts = rows if parts is None else parts.unionByName(rows)
    last = parts.groupBy("poi_id").agg(F.max("save").alias("save"))
    rows = parts.select(*header).join(last, ["poi_id", "save"]).filter("status is not null")
    return rows.select("poi_id", "status", "uid_name", F.size(wkt_to_ring(F.col("geometry"))).alias("points"))


@query
def stream_progress(spark, sf):
    """The last line the running job reports: calls, counts and progress text."""
    from placehull.streaming import ledger

    folder = _streamed(spark, sf)
    poi = unresolved(prepare_poi(poi_table(spark, sf), NO_NAMES))
    n = poi.count()
    lines = ledger.progress(spark, folder, n, n)
    last = lines.agg(F.max("saves").alias("saves"))
    return lines.join(last, "saves").select("calls", "matched", "no_uid", "no_geometry", "resolved", "progress", "elapsed")
