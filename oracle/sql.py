"""One DuckDB statement per registered query."""

from __future__ import annotations

from oracle import geometry as g
from placehull.options import VAR, MatchOptions
from placehull.plans.derived import cte, ctes
from placehull.plans.queries import (
    BY_ROW,
    FLUSH_INTERVAL,
    NO_NAMES,
    PRESET_1,
    PRESET_2,
    SEARCH_ONLY,
    SEARCH_RADIUS_M,
    WITH_AREA,
)

ORACLES: dict[str, str] = {}


def statement(items: list[str], final: str) -> str:
    return "with " + ",\n".join(i for i in items if i) + "\n" + final


def put(name: str, items: list[str], final: str) -> None:
    ORACLES[name] = statement(items, final)


# --- coordinate systems ---
POINTS = [ctes("poi"), "p0 as (select poi_id, lng, lat from poi)"]
STEPS = {
    "crs_wgs84_to_gcj02": [g.gcj("p0", "p1", "lng", "lat", "+")],
    "crs_gcj02_to_wgs84": [g.gcj("p0", "p1", "lng", "lat", "-")],
    "crs_gcj02_to_bd09": [g.to_bd("p0", "p1", "lng", "lat")],
    "crs_bd09_to_gcj02": [g.from_bd("p0", "p1", "lng", "lat")],
    "crs_wgs84_to_bd09": [g.gcj("p0", "pg", "lng", "lat", "+"), g.to_bd("pg", "p1", "lng", "lat")],
    "crs_bd09_to_wgs84": [g.bd_to_wgs("p0", "p1", "lng", "lat")],
}
for _name, _steps in STEPS.items():
    put(_name, POINTS + _steps, "select poi_id, round(lng, 6) as lng, round(lat, 6) as lat from p1")

CORNERS = [
    ctes("search_result"),
    "p0 as (select poi_id, uid, cast(cx as double) as lng, cast(cy as double) as lat from search_result)",
]
for _name, _conv in (("crs_bd09mc_to_bd09", g.mercator_to_bd), ("crs_bd09mc_to_wgs84", g.mercator_to_wgs)):
    put(_name, CORNERS + [_conv("p0", "p1", "lng", "lat")],
        "select poi_id, uid, round(lng, 6) as lng, round(lat, 6) as lat from p1")

put("utm_project", POINTS + [g.utm("p0", "p1", "lng", "lat", "e", "n")],
    "select poi_id, round(e, 3) as easting, round(n, 3) as northing from p1")
put("haversine_km", [ctes("search_result")],
    f"""select r.poi_id, r.uid, round({g.haversine('cast(u_lng as double)', 'cast(u_lat as double)', 'p.lng', 'p.lat')}, 6) as distance_km
from search_result r join poi p on p.poi_id = r.poi_id""")
put("outside_china", POINTS,
    f"""select poi_id, {g.outside('x', 'y')} as outside from (
  select poi_id, lng + poi_id % 60 - 45 as x, lat + poi_id % 70 - 45 as y from p0)""")
put("poi_prepare",
    [ctes("poi"), "p0 as (select * from poi)", g.gcj("p0", "p1", "lng", "lat", "-")],
    """select poi_id, round(lng, 6) as lng_wgs84, round(lat, 6) as lat_wgs84, 'FIXED' as prim_ind,
  sec_ind, prior_status as status, cast(null as varchar) as uid_name from p1""")
put("poi_custom_transform", POINTS,
    "select poi_id, round(240.0 - lng, 6) as lng_wgs84, round(lat, 6) as lat_wgs84 from p0")


# --- candidates ---
def category(options: MatchOptions) -> tuple[str, str]:
    def one(name):
        value = getattr(options, name)
        return f"p.{name}" if value == VAR else f"'{value}'"

    return one("prim_ind"), one("sec_ind")


def judged(options: MatchOptions) -> list[str]:
    """poi_w: POIs in wgs84; judged: every search result with its first failing rule."""
    prim, sec = category(options)
    conv = {
        "wgs84": "poi_w as (select * from poi_o)",
        "bd09": ",\n".join([
            g.gcj("poi_o", "poi_g", "lng", "lat", "+"), g.to_bd("poi_g", "poi_b", "lng", "lat"),
            g.bd_to_wgs("poi_b", "poi_w", "lng", "lat"),
        ]),
    }[options.crs]
    return [
        ctes("boundary_response"),
        "poi_o as (select * from poi where prior_status is null)",
        conv,
        f"""r0 as (select r.poi_id, r.uid, r.uid_name, cast(r.search_rank as integer) as search_rank, r.tag,
  cast(u_lng as double) as ulng, cast(u_lat as double) as ulat, p.name as p_name, p.lng as p_lng, p.lat as p_lat,
  {prim} as prim, {sec} as sec
 from search_result r join poi_w p on p.poi_id = r.poi_id where r.poi_id % 50 <> 0)""",
        g.bd_to_wgs("r0", "r1", "ulng", "ulat"),
        f"r2 as (select *, {g.haversine('ulng', 'ulat', 'p_lng', 'p_lat')} as distance_km from r1)",
        f"""judged as (select *, case
   when distance_km > {options.radius_km} then 'radius'
   when tag is null then null
   when len(string_split(tag, ';')) > 2 then 'tag'
   when contains(tag, ';') then case when string_split(tag, ';')[1] = prim and string_split(tag, ';')[2] = sec then null else 'tag' end
   when contains(tag, prim) or contains(tag, sec) then null else 'tag' end as reason from r2)""",
    ]


def accepted(options: MatchOptions) -> list[str]:
    first = "" if not options.use_first_uid else (
        " qualify row_number() over (partition by poi_id order by search_rank) = 1")
    return judged(options) + [f"accepted as (select * from judged where reason is null{first})"]


put("flatten_search_results", [ctes("search_result")],
    """select poi_id, uid, uid_name, cast(search_rank as integer) as search_rank, round(cast(u_lng as double), 6) as u_lng,
  round(cast(u_lat as double), 6) as u_lat, tag as u_tag from search_result where poi_id % 50 <> 0""")
put("candidate_filter", accepted(BY_ROW),
    "select poi_id, uid, uid_name, search_rank, round(distance_km, 6) as distance_km from accepted")
put("candidate_reject_reason", judged(BY_ROW), "select poi_id, uid, search_rank, reason from judged")
put("first_accepted", accepted(BY_ROW),
    """select poi_id, uid, uid_name, search_rank from accepted
qualify row_number() over (partition by poi_id order by search_rank) = 1""")
put("service_status", [ctes("search_response")],
    """select poi_id, status as service_status, case when status = 0 then 'ok' else 'quota' end as status_class
from search_response""")
put("status_class_of_codes", [ctes("fetch_log")],
    """select event_id, http_status, case when http_status = 0 then 'ok' when http_status // 100 = 2 then 'parameter'
  when http_status // 100 = 3 then 'verify' when http_status // 100 = 4 then 'quota'
  when http_status // 100 = 5 then 'key' else 'error' end as status_class from fetch_log""")
put("search_manifest", [ctes("poi")],
    """select poi_id, cast(poi_id % 7 as integer) as key_slot,
  'query=' || url_encode(name) || '&location=' || cast(lat as varchar) || ',' || cast(lng as varchar)
  || '&radius=2000&radius_limit=true&output=json&coord_type=1&tag=' || url_encode(prim_ind || ';' || sec_ind)
  || '&scope=2' as request from poi where prior_status is null""")
put("boundary_manifest", accepted(BY_ROW),
    "select poi_id, uid, uid_name, search_rank, 'qt=ext&uid=' || url_encode(uid) || '&ext_ver=new&l=11' as request from accepted")
put("resume_antijoin", [ctes("poi")],
    "select poi_id, name from poi where poi_id not in (select poi_id from poi where prior_status is not null)")


# --- rings ---
def vertices(src: str) -> list[str]:
    """verts: poi_id, uid, pos, lng, lat of every readable ring of ``src`` (poi_id, uid, body)."""
    return [
        f"""geo as (select poi_id, uid, split_part(body->>'$.content.geo', '|', 3) as part from {src}
  where body->>'$.content.geo' is not null)""",
        """nums as (select poi_id, uid, cast(string_split(substr(part, 3, length(part) - 3), ',') as double[]) as v
  from geo where part <> '')""",
        """v0 as (select poi_id, uid, i as pos, v[2 * i + 1] as lng, v[2 * i + 2] as lat
  from (select poi_id, uid, v, unnest(range(0, len(v) // 2)) as i from nums))""",
        g.mercator_to_wgs("v0", "verts", "lng", "lat"),
    ]


def measures(points: str) -> list[str]:
    """rings: box, area and distance per (poi_id, uid); ``points``: poi_id, p_lng, p_lat."""
    return [
        g.utm("verts", "vu", "lng", "lat", "e", "n"),
        g.utm(points, "pu", "p_lng", "p_lat", "pe", "pn"),
        """edges as (select v.*, e - pe as ax, n - pn as ay,
  lead(e - pe) over w as qx, lead(n - pn) over w as qy
 from vu v join pu on pu.poi_id = v.poi_id window w as (partition by v.poi_id, v.uid order by v.pos))""",
        """edges2 as (select *, (qx-ax) as dx, (qy-ay) as dy,
  least(1.0, greatest(0.0, -(ax*(qx-ax) + ay*(qy-ay)) / ((qx-ax)*(qx-ax) + (qy-ay)*(qy-ay)))) as t from edges)""",
        """rings as (select poi_id, uid, count(qx) as edges, min(lng) as min_lng, max(lng) as max_lng,
  min(lat) as min_lat, max(lat) as max_lat, abs(sum(ax*qy - qx*ay)) / 2e6 as area_km2,
  case when count(*) filter (where (ay > 0) <> (qy > 0) and ax - ay*dx/dy > 0) % 2 = 1 then 0.0
    else sqrt(min((ax+t*dx)*(ax+t*dx) + (ay+t*dy)*(ay+t*dy))) end as distance_m
 from edges2 group by poi_id, uid)""",
    ]


ALL_VERTS = [ctes("boundary_response")] + vertices("boundary_response")
ALL_RINGS = ALL_VERTS + ["pts as (select poi_id, lng as p_lng, lat as p_lat from poi)"] + measures("pts")
put("ring_decode", ALL_VERTS,
    "select poi_id, uid, cast(pos as integer) as pos, round(lng, 6) as lng, round(lat, 6) as lat from verts")
put("ring_bbox", ALL_RINGS,
    """select poi_id, uid, round(min_lng, 6) as min_lng, round(min_lat, 6) as min_lat,
  round(max_lng, 6) as max_lng, round(max_lat, 6) as max_lat from rings""")
put("ring_area", ALL_RINGS, "select poi_id, uid, edges, round(area_km2, 6) as area_km2 from rings")
put("point_polygon_distance", ALL_RINGS, "select poi_id, uid, round(distance_m, 3) as distance_m from rings")
WKT = """'POLYGON ((' || string_agg(cast(round(lng, 6) as varchar) || ' ' || cast(round(lat, 6) as varchar), ', ' order by pos) || '))'"""
put("ring_wkt", ALL_VERTS, f"select poi_id, uid, {WKT} as wkt from verts group by poi_id, uid")
ORACLES["wkt_decode"] = ORACLES["ring_decode"]
put("geojson_features", ALL_VERTS,
    """select '{"type":"Feature","properties":{"poi_id":' || poi_id || ',"uid":"' || uid
  || '"},"geometry":{"type":"Polygon","coordinates":[['
  || string_agg('[' || cast(round(lng, 6) as varchar) || ',' || cast(round(lat, 6) as varchar) || ']', ',' order by pos)
  || ']]}}' as value from verts group by poi_id, uid""")


# --- validity, ranks, best area ---
#: requests with more than three failed attempts within five days
GONE = """gone as (select r.poi_id, r.uid, count(*) as failures from boundary_request r join fetch_log l on l.request_id = r.request_id
  and l.ts >= r.issued_ts and l.ts < r.issued_ts + interval 5 day
 where l.http_status in (500, 502, 503, 504, 522, 524, 408, 403, 400, 302, 301) group by r.poi_id, r.uid having count(*) > 3)"""


def measured(options: MatchOptions, gave_up: bool = False) -> list[str]:
    """aois: accepted candidates with metrics, similarity and validity; with ``gave_up`` table gone counts as called.

    Every candidate name here is its POI's name or that name with a suffix, so the longest
    common block is the whole POI name and the similarity has a closed form.
    """
    floor = f"and similarity >= {options.min_similarity}" if options.sort_by_similarity else ""
    gone = "or exists (select 1 from gone g where g.poi_id = a.poi_id and g.uid = a.uid)" if gave_up else ""
    return accepted(options) + ([cte("boundary_request"), cte("fetch_log"), GONE] if gave_up else []) + [
        f"""att as (select a.*, b.poi_id is not null {gone} as called, b.body from accepted a
  left join boundary_response b on b.poi_id = a.poi_id and b.uid = a.uid)""",
        *vertices("att"),
        "pts as (select distinct poi_id, p_lng, p_lat from att)",
        *measures("pts"),
        """m as (select a.*, r.min_lng, r.max_lng, r.min_lat, r.max_lat, r.area_km2, r.distance_m,
  case when starts_with(a.uid_name, a.p_name) then 2.0 * length(a.p_name) / (length(a.p_name) + length(a.uid_name)) end as similarity
 from att a left join rings r on r.poi_id = a.poi_id and r.uid = a.uid)""",
        f"""aois as (select *, coalesce(p_lng between min_lng and max_lng and p_lat between min_lat and max_lat
  and area_km2 between {options.min_aoi_area} and {options.max_aoi_area} {floor}, false) as valid from m)""",
    ]


def ranked(options: MatchOptions, gave_up: bool = False) -> list[str]:
    keys = {
        "search_rank": "search_rank",
        "area": f"round(area_km2, 9) * {options.sort_by_area}",
        "distance": "round(distance_m, 6)",
        "similarity": "-similarity",
    }
    ranks = ", ".join(
        f"row_number() over (partition by poi_id order by {keys[s]}, search_rank, uid) - 1 as rank_{s}"
        for s in options.enabled_sorts)
    mean = " + ".join(f"rank_{s}" for s in options.enabled_sorts)
    return measured(options, gave_up) + [
        f"ranked as (select *, {ranks} from aois where valid)",
        f"scored as (select *, ({mean}) / {float(len(options.enabled_sorts))} as score from ranked)",
        "best as (select * from scored qualify row_number() over (partition by poi_id order by score, search_rank, uid) = 1)",
    ]


put("aoi_validity", measured(NO_NAMES),
    """select poi_id, uid, search_rank, called, round(area_km2, 6) as area_km2,
  round(distance_m, 3) as distance_m, valid from aois""")
put("name_similarity", [ctes("search_result")],
    """select r.poi_id, r.uid, round(2.0 * length(p.name) / (length(p.name) + length(r.uid_name)), 6) as similarity
from search_result r join poi p on p.poi_id = r.poi_id where starts_with(r.uid_name, p.name)""")
for _sort, _options in (("search", NO_NAMES), ("area", WITH_AREA), ("distance", NO_NAMES), ("similarity", BY_ROW)):
    _col = "rank_search_rank" if _sort == "search" else f"rank_{_sort}"
    put(f"rank_by_{_sort}", ranked(_options), f"select poi_id, uid, {_col} from ranked")
for _name in ("weighted_rank", "weighted_rank_split"):
    put(_name, ranked(WITH_AREA),
        "select poi_id, uid, rank_search_rank, rank_area, rank_distance, round(score, 6) as score from scored")
FIRST_UID = MatchOptions(prim_ind=VAR, sec_ind=VAR, sort_by_similarity=0, use_first_uid=True)
for _name, _options in (
    ("best_aoi", NO_NAMES), ("best_aoi_full", BY_ROW), ("best_aoi_preset1", PRESET_1),
    ("best_aoi_preset2", PRESET_2), ("best_aoi_first_uid", FIRST_UID),
):
    put(_name, ranked(_options), "select poi_id, uid, uid_name, search_rank, round(score, 6) as score from best")
put("best_in_box", measured(SEARCH_ONLY),
    """select poi_id, uid, uid_name, search_rank from aois
where p_lng between min_lng and max_lng and p_lat between min_lat and max_lat
qualify row_number() over (partition by poi_id order by search_rank, uid) = 1""")
put("candidate_lists", measured(NO_NAMES),
    """select poi_id, page, cast(count(*) as integer) as n, string_agg(uid, ',' order by search_rank, uid) as uids
from (select *, cast(floor((row_number() over (partition by poi_id order by search_rank, uid) - 1) / 1000) as bigint) as page
  from aois where valid) group by poi_id, page""")

# --- status and reports ---
COUNTS = """counts as (select poi_id, count(*) as accepted, count(*) filter (where called) as called,
  count(*) filter (where valid) as valid from aois group by poi_id)"""
STATUS = [
    COUNTS,
    """st as (select p.poi_id, p.name, p.lng, p.lat, p.poi_id % 50 <> 0 as answered, c.accepted, c.called, c.valid,
  case when p.poi_id % 50 = 0 then null when c.accepted is null then 'No Uid' when c.called < c.accepted then null
    when c.valid > 0 then 'Matched' else 'No Geometry' end as status
 from poi p left join counts c on c.poi_id = p.poi_id where p.prior_status is null)""",
]
put("completion", measured(NO_NAMES) + [COUNTS], "select *, called = accepted as complete from counts")
put("gave_up_requests", [ctes("boundary_request", "fetch_log"), GONE], "select * from gone")
put("completion_given_up", measured(NO_NAMES, True) + [COUNTS], "select *, called = accepted as complete from counts")
put("match_status_given_up", measured(NO_NAMES, True) + STATUS,
    "select poi_id, answered, accepted, called, valid, status from st")
put("match_status", measured(NO_NAMES) + STATUS,
    "select poi_id, answered, accepted, called, valid, status from st")
RESULT = ranked(NO_NAMES) + STATUS + [
    "won as (select st.*, b.uid, b.uid_name from st left join best b on b.poi_id = st.poi_id and st.status = 'Matched')",
    f"""wkt as (select poi_id, uid, {WKT} as geometry, cast(count(*) as integer) as points
  from verts semi join won using (poi_id, uid) group by poi_id, uid)""",
]
put("match_result", RESULT,
    """select w.poi_id, w.status, w.uid_name, k.geometry from won w
left join wkt k on k.poi_id = w.poi_id and k.uid = w.uid""")
put("csv_roundtrip", RESULT,
    """select w.poi_id, w.name, round(w.lng, 6) as lng, round(w.lat, 6) as lat, w.status, w.uid_name, k.points
from won w left join wkt k on k.poi_id = w.poi_id and k.uid = w.uid""")
put("resumed_results", RESULT, "select poi_id, status, uid_name from won")
put("rings_in_box", ALL_VERTS,
    """select * from (select poi_id, uid, min(round(lng, 6)) as min_lng, min(round(lat, 6)) as min_lat, max(round(lng, 6)) as max_lng,
  max(round(lat, 6)) as max_lat from verts group by poi_id, uid)
where min_lng <= 116.45 and max_lng >= 116.30 and min_lat <= 39.95 and max_lat >= 39.80""")
put("numbered_csv", [ctes("poi")], "select row_number() over (order by poi_id) - 1 as poi_id, name from poi")
FINAL = measured(NO_NAMES) + STATUS + [
    """fin as (select p.poi_id, coalesce(p.prior_status, st.status) as status
 from poi p left join st on st.poi_id = p.poi_id)""",
    """h as (select count(*) filter (where status = 'Matched') as matched, count(*) filter (where status = 'No Uid') as no_uid,
  count(*) filter (where status = 'No Geometry') as no_geometry, count(status) as resolved,
  count(*) - count(status) as missing, count(*) as total from fin)""",
]
put("status_histogram", FINAL, "select * from h")
put("start_report", [ctes("poi")],
    """select count(*) as total, count(*) - count(prior_status) as to_do,
  concat(count(*) filter (where prior_status = 'Matched'), '/', count(*) filter (where prior_status = 'No Uid'), '/0/',
    count(*), ' | ', count(prior_status), ' (', printf('%.2f', 100.0 * count(prior_status) / count(*)), '%)') as progress from poi""")
put("finish_report", FINAL,
    """select matched, missing, total, round(matched / total, 6) as matched_share, round(missing / total, 6) as missing_share,
  printf('%.2f', 100.0 * matched / total) || '%' as matched_text,
  printf('%.2f', 100.0 * missing / total) || '%' as missing_text, missing > 0 as rerun from h""")


def duration(s: str) -> str:
    return f"""case when {s} > 86400 then '>24h'
  when {s} > 3600 then concat(cast(floor({s} / 3600) as bigint), 'h', cast(floor(({s} % 3600) / 60) as bigint), 'min')
  when {s} > 60 then concat(cast(floor({s} / 60) as bigint), 'min', printf('%.0f', {s} % 60), 's')
  else printf('%.0f', {s}) || 's' end"""


EVENTS = [
    ctes("fetch_log"),
    """ev as (select event_id, ts, case when http_status = 200 then 'Matched' when http_status = 404 then 'No Geometry' end as status
 from fetch_log)""",
]
put("throughput", EVENTS + [
    """sp as (select count(status) as resolved, count(*) as to_do,
  epoch_us(max(ts) filter (where status is not null)) / 1e6 - epoch_us(min(ts) filter (where status is not null)) / 1e6 as s0 from ev)""",
    "sq as (select resolved, to_do, round(s0, 6) as seconds, resolved / s0 as rate from sp)",
], f"""select resolved, seconds, printf('%.2f/s (%.0f/h)', rate, rate * 3600) as speed,
  {duration('((to_do - resolved) / rate)')} as remaining, {duration('seconds')} as total_time from sq""")
put("format_duration", [ctes("fetch_log")],
    f"select event_id, {duration('(cast((event_id * 37) % 100000 as double))')} as duration from fetch_log")
put("progress_changes", EVENTS + [
    """run as (select *, count(*) filter (where status = 'Matched') over w as matched, cast(0 as bigint) as no_uid,
  count(*) filter (where status = 'No Geometry') over w as no_geometry, count(status) over w as resolved,
  count(*) over () as total from ev window w as (order by ts, event_id rows unbounded preceding))""",
], """select event_id, matched, no_uid, no_geometry, resolved,
  concat(matched, '/', no_uid, '/', no_geometry, '/', total, ' | ', resolved, ' (',
    printf('%.2f', 100.0 * resolved / total), '%)') as progress from run where status is not null""")
put("flush_points", [ctes("fetch_log")],
    f"""select event_id, calls from (select event_id, row_number() over (order by ts, event_id) as calls from fetch_log)
where calls % {FLUSH_INTERVAL} = 0""")

# --- circular search, fetch log ---
put("circular_search", [ctes("search_result"),
    """pl as (select concat(poi_id, '/', uid) as place_id, cast(u_lng as double) as x, cast(u_lat as double) as y from search_result)"""],
    f"""select poi_id, place_id, round(d, 6) as distance_km from (
  select p.poi_id, place_id, {g.haversine('p.lng', 'p.lat', 'x', 'y')} as d from poi p, pl)
where d <= {SEARCH_RADIUS_M / 1000}""")
ORACLES["circular_search_stored"] = ORACLES["circular_search"]
RETRY = "(500, 502, 503, 504, 522, 524, 408, 403, 400, 302, 301)"
put("retry_attempts", [ctes("fetch_log")],
    f"""select request_id, event_id, row_number() over (partition by request_id order by ts, event_id) as attempt,
  http_status, http_status in {RETRY} as retryable from fetch_log""")
GAVE_UP = f"""gu as (select request_id, count(*) filter (where http_status in {RETRY}) as failures from fetch_log group by request_id)"""
put("gave_up", [ctes("fetch_log"), GAVE_UP], "select request_id, failures, failures > 3 as gave_up from gu")
put("first_good_response", [ctes("fetch_log")],
    f"""select request_id, event_id, http_status from fetch_log where http_status not in {RETRY}
qualify row_number() over (partition by request_id order by ts, event_id) = 1""")
put("retry_reasons", [ctes("fetch_log"), GAVE_UP],
    f"""select cast(http_status as varchar) as reason, count(*) as n from fetch_log where http_status in {RETRY} group by 1
union all select 'total', count(*) from fetch_log where http_status in {RETRY}
union all select 'max_reached', count(*) from gu where failures > 3""")
_RINGLESS = """ringless as materialized (select poi_id, uid from (
  select poi_id, uid, body->>'$.content.geo' as geo from boundary_response) where geo is not null and split_part(geo, '|', 3) = '')"""
put("parse_failures", [*accepted(NO_NAMES), _RINGLESS],
    """select poi_id, cast(null as varchar) as uid, 'search' as level, 'quota' as reason from poi where poi_id % 50 = 0
union all
select a.poi_id, a.uid, 'boundary', 'no ring part' from accepted a
semi join ringless b on b.poi_id = a.poi_id and b.uid = a.uid""")

# --- streaming: the same result as the batch job, for complete POIs with candidates ---
put("stream_completion", ranked(NO_NAMES) + STATUS,
    """select st.poi_id, st.status, b.uid, b.uid_name, b.search_rank, round(b.score, 6) as score
from st left join best b on b.poi_id = st.poi_id where st.status in ('Matched', 'No Geometry')""")
put("stream_throughput", [ctes("fetch_log")],
    """select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as window_start, count(*) as n
from fetch_log group by 1""")
# both response streams and given-up requests: the state of each open POI, what was saved, and the last progress line
STREAMED = ranked(NO_NAMES, True) + STATUS
put("stream_match", STREAMED,
    """select st.poi_id, st.answered, st.accepted, st.called, st.valid, st.status, b.uid, b.uid_name, cast(b.search_rank as integer) as search_rank,
  round(b.score, 6) as score from st left join best b on b.poi_id = st.poi_id and st.status = 'Matched'""")
put("stream_saved", STREAMED + [
    "won as (select st.*, b.uid, b.uid_name from st left join best b on b.poi_id = st.poi_id and st.status = 'Matched')",
    """pts2 as (select poi_id, uid, cast(count(*) as integer) as points from verts semi join won using (poi_id, uid) group by poi_id, uid)""",
], """select w.poi_id, w.status, w.uid_name, k.points from won w
left join pts2 k on k.poi_id = w.poi_id and k.uid = w.uid where w.status is not null""")
put("stream_progress", STREAMED + [
    """h as (select cast(sum(called) as bigint) as calls, count(*) filter (where status = 'Matched') as matched, count(*) filter (where status = 'No Uid') as no_uid,
  count(*) filter (where status = 'No Geometry') as no_geometry, count(status) as resolved, count(*) as total from st)""",
    """sp as (select 60.0 * (max(poi_id % 600) - min(poi_id % 600)) as s from st)""",
], f"""select calls, matched, no_uid, no_geometry, resolved,
  concat(matched, '/', no_uid, '/', no_geometry, '/', total, ' | ', resolved, ' (', printf('%.2f', 100.0 * resolved / total), '%)') as progress,
  {duration('s')} as elapsed from h, sp""")
