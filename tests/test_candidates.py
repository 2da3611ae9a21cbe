import json

import pytest
from pyspark.sql import functions as F

from placehull.operators.candidates import accept, category_matches, judge_candidates, passed
from placehull.options import PRESETS, VAR, MatchOptions
from placehull.sources.manifests import search_manifest
from placehull.sources.poi import check_columns, prepare_poi, read_poi_csv, unresolved
from placehull.sources.responses import decode_search, status_class


@pytest.mark.parametrize(
    "tag, prim, sec, expected",
    [
        (None, "a", "b", True),
        ("a;b", "a", "b", True),
        ("a;c", "a", "b", False),
        ("a;c", "a", "", True),  # a blank part is no constraint
        ("a;b", "", "", True),
        ("a;b;c", "a", "b", False),  # too many parts reject this candidate only
        ("xax", "a", "b", True),
        ("xbx", "a", "b", True),
        ("xcx", "a", "", False),
        ("xcx", "", "", True),
    ],
)
def test_category_rule(spark, tag, prim, sec, expected):
    df = spark.createDataFrame([(tag, prim, sec)], "t string, p string, s string")
    assert df.select(category_matches(F.col("t"), F.col("p"), F.col("s"))).first()[0] is expected


def test_status_classes(spark):
    codes = [0, 2, 210, 302, 401, 502, 999, None]
    df = spark.createDataFrame([(c,) for c in codes], "s int")
    assert [r[0] for r in df.select(status_class(F.col("s"))).collect()] == [
        "ok", "error", "parameter", "verify", "quota", "key", "error", "error"
    ]


def result(uid, name="n", lng=116.316833, lat=39.998877, tag=None):
    item = {"uid": uid, "name": name, "location": {"lat": lat, "lng": lng}}
    if tag is not None:
        item["detail_info"] = {"tag": tag}
    return item


def judge(spark, results, options=MatchOptions(), extra=()):
    poi = spark.createDataFrame(
        [(1, "n", 116.30420708125263, 39.991595084258336)],
        "poi_id bigint, name string, lng double, lat double",
    )
    bodies = [(1, json.dumps({"status": 0, "results": results})), *extra]
    responses = spark.createDataFrame(bodies, "poi_id bigint, body string")
    prepared = unresolved(prepare_poi(poi, options))
    return judge_candidates(prepared, decode_search(responses), options)


def test_reject_reasons_and_ranks(spark):
    rows = judge(
        spark,
        [
            result("u1"), result("", "x"), result("u3", ""), result("u4", lng=0.0),
            result("u5", lng=116.4), result("u6", tag="q"), {"uid": "u7", "name": "n"},
        ],
        MatchOptions(prim_ind="p"),
    ).orderBy("search_rank").collect()
    assert [r.search_rank for r in rows] == [1, 2, 3, 4, 5, 6, 7]
    assert [r.reason for r in rows] == [None, "key", "key", "key", "radius", "tag", "key"]


def test_radius_is_inclusive(spark):
    # a candidate whose distance survives the way to metres and back
    rows = judge(spark, [result(f"u{i}", lng=116.33 + i / 1000) for i in range(5)]).collect()
    row = next(r for r in rows if r.distance_km * 1000 / 1000 == r.distance_km)
    exact, lng = row.distance_km, row.u_lng
    at = judge(spark, [result("u1", lng=lng)], MatchOptions(radius=exact * 1000)).first()
    below = judge(spark, [result("u1", lng=lng)], MatchOptions(radius=exact * 1000 - 1e-6)).first()
    assert at.reason is None and below.reason == "radius"


def test_repeated_uid_kept_once_and_first_only(spark):
    rows = [result("u2", lng=0.0), result("u2", "late"), result("u1"), result("u2", "later")]
    kept = {(r.uid, r.search_rank) for r in accept(judge(spark, rows), MatchOptions()).collect()}
    assert kept == {("u2", 2), ("u1", 3)}
    only = MatchOptions(use_first_uid=True)
    assert [(r.uid, r.search_rank) for r in accept(judge(spark, rows, only), only).collect()] == [("u2", 2)]


def test_broken_and_refused_responses_give_nothing(spark):
    extra = [(1, "not json"), (1, '{"status": 401, "results": []}')]
    assert judge(spark, [], extra=extra).count() == 0
    assert passed(judge(spark, [])).count() == 0


def test_required_columns(spark):
    df = spark.createDataFrame([("a", 1.0)], "name string, lng double")
    with pytest.raises(ValueError, match="lat"):
        check_columns(df, MatchOptions())
    df = spark.createDataFrame([("a", 1.0, 2.0)], "name string, lng double, lat double")
    check_columns(df, MatchOptions())
    with pytest.raises(ValueError, match="sec_ind"):
        check_columns(df, MatchOptions(sec_ind=VAR))


def test_options_are_checked():
    for bad in (
        dict(radius=-1), dict(crs="utm"), dict(min_similarity=1), dict(sort_by_area=2),
        dict(update_interval=0), dict(radius_limit="maybe"),
        dict(sort_by_search_rank=0, sort_by_distance=0, sort_by_similarity=0),
    ):
        with pytest.raises(ValueError):
            MatchOptions(**bad)
    assert PRESETS["mixed_large"].enabled_sorts == ("search_rank", "area", "distance", "similarity")


def test_manifest_scopes_and_resume(spark):
    poi = spark.createDataFrame(
        [(1, "a", 1.0, 2.0, "p", "s", None), (2, "b", 1.0, 2.0, "p", None, None),
         (3, "c", 1.0, 2.0, None, "", None), (4, "d", 1.0, 2.0, "p", "s", "Matched")],
        "poi_id bigint, name string, lng double, lat double, prim_ind string, sec_ind string, status string",
    )
    options = MatchOptions(prim_ind=VAR, sec_ind=VAR)
    rows = search_manifest(prepare_poi(poi, options), options, 2).orderBy("poi_id").collect()
    assert [r.request.split("coord_type=1")[1] for r in rows] == [
        "&tag=p%3Bs&scope=2", "&tag=p&scope=2", "&scope=1"
    ]


def test_csv_scan_with_quoted_wkt(spark, tmp_path):
    path = tmp_path / "poi.csv"
    path.write_text(
        'name,lng,lat,status,geometry\n'
        '弘善家园,116.44,39.87,Matched,"POLYGON ((1 2, 3 4, 5 6, 1 2))"\n'
        'b,116.1,39.1,,\n', encoding="utf-8",
    )
    rows = prepare_poi(read_poi_csv(spark, str(path)), MatchOptions()).orderBy("poi_id").collect()
    assert rows[0].name == "弘善家园" and len(rows[0].geometry) == 4
    assert rows[1].status is None and rows[1].geometry is None and rows[1].lng_wgs84 == 116.1
    assert rows[0].poi_id != rows[1].poi_id
