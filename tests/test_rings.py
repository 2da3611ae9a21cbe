import random

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from placehull.functions.rings import (
    is_multi_part,
    ring_to_wkt,
    rings_wgs84,
    with_ring_numbers,
    wkt_to_ring,
)
from placehull.operators.outlines import measure_rings
from placehull.plans.queries import QUERIES

X, Y = 12948599.0, 4837127.0


def encode(points, tail=";"):
    body = ",".join(f"{X + x},{Y + y}" for x, y in points)
    return f"4|1,2;3,4|1-{body}{tail}"


def numbers(spark, geo):
    df = spark.createDataFrame([(geo,)], "geo string")
    got = with_ring_numbers(df).first()["numbers"]
    return got and [(a - X, b - Y) for a, b in zip(got[::2], got[1::2])]


SQUARE = [(0, 0), (100, 0), (100, 100), (0, 100)]


def test_ring_is_closed_once(spark):
    assert numbers(spark, encode(SQUARE)) == SQUARE + SQUARE[:1]
    assert numbers(spark, encode(SQUARE + SQUARE[:1])) == SQUARE + SQUARE[:1]


def test_odd_tail_is_dropped(spark):
    assert numbers(spark, encode(SQUARE, tail=",7;")) == SQUARE + SQUARE[:1]


@pytest.mark.parametrize("geo", [None, "", "4|bad", "4|1|1-a,b,c,d,e,f;", encode(SQUARE[:2])])
def test_unreadable_rings_are_null(spark, geo):
    assert numbers(spark, geo) is None


def test_first_ring_of_a_multi_part(spark):
    geo = encode(SQUARE) + "1-1,2,3,4,5,6;"
    assert numbers(spark, geo) == SQUARE + SQUARE[:1]
    df = spark.createDataFrame([(geo,), (encode(SQUARE),)], "geo string")
    assert [r[0] for r in df.select(is_multi_part(F.col("geo"))).collect()] == [True, False]


def test_wkt_round_trip_and_rejects(spark):
    df = spark.createDataFrame([(1, encode(SQUARE))], "k int, geo string")
    rings = rings_wgs84(df, ["k"])
    texts = rings.select("ring", ring_to_wkt(F.col("ring")).alias("w"))
    row = texts.select("ring", wkt_to_ring(F.col("w")).alias("again")).first()
    assert row.ring == row.again and row.ring[0] == row.ring[-1] and len(row.ring) == 5
    other = spark.createDataFrame([("POINT (1 2)",), (None,)], "w string")
    assert [r[0] for r in other.select(wkt_to_ring(F.col("w"))).collect()] == [None, None]


def measured(spark, rings, point=(0.0, 0.0)):
    """Measure Mercator rings; the point is projected through a tiny ring's first corner."""
    df = spark.createDataFrame([(i, encode(r)) for i, r in enumerate(rings)], "id int, geo string")
    marker = spark.createDataFrame([(encode([point, *SQUARE]),)], "geo string")
    from placehull.functions.rings import vertices_wgs84
    from placehull.functions.utm import to_utm

    corner = vertices_wgs84(with_ring_numbers(marker)).where("pos = 0").select("lng", "lat")
    at = to_utm(corner, [(("lng", "lat"), ("pe", "pn"))]).first()
    df = with_ring_numbers(df).withColumns({"pe": F.lit(at.pe), "pn": F.lit(at.pn)})
    rows = measure_rings(df, "id", [], ("pe", "pn"), 50).orderBy("id").collect()
    return rows


def test_area_ignores_direction_and_start(spark):
    ring = [(0, 0), (400, 30), (500, 300), (200, 420), (-50, 250)]
    variants = [ring, ring[::-1], ring[2:] + ring[:2]]
    areas = [r.area_km2 for r in measured(spark, variants)]
    assert max(areas) - min(areas) < 1e-10 and areas[0] > 0.05


def test_distance_is_zero_inside_and_on_the_ring(spark):
    # 0 inside, 0 on a corner, positive outside; concave notch counts as outside
    notch = [(0, 0), (100, 0), (100, 100), (50, 20), (0, 100)]
    inside = measured(spark, [notch], point=(20.0, 20.0))[0].distance_m
    corner = measured(spark, [notch], point=(100.0, 100.0))[0].distance_m
    in_notch = measured(spark, [notch], point=(50.0, 80.0))[0].distance_m
    beside = measured(spark, [notch], point=(200.0, 0.0))[0].distance_m
    assert inside == 0 and corner < 1e-6
    assert 5 < in_notch < 60
    assert 60 < beside < 100  # 100 Mercator units are about 76 m here


def test_degenerate_edge_does_no_harm(spark):
    ring = [(0, 0), (100, 0), (100, 0), (100, 100), (0, 100)]
    a, b = measured(spark, [ring, SQUARE], point=(300.0, 50.0))
    assert abs(a.area_km2 - b.area_km2) < 1e-12 and abs(a.distance_m - b.distance_m) < 1e-9


def test_vertex_off_every_band_spoils_the_ring(spark):
    bad = [(0, 0), (100, 0), (100, -Y - 10), (0, 100)]
    row = measured(spark, [bad])[0]
    assert row.area_km2 is None and row.distance_m is None and row.min_lng is None


def test_wkt_texts_with_any_white_space(spark):
    """Plain texts take the short way, others the patterns: the same numbers."""
    ways = {
        "POLYGON ((1 2, 3.5 -4, 1e1 2))": [(1.0, 2.0), (3.5, -4.0), (10.0, 2.0)],
        " polygon((1 2,3 4 5, 6 ,x 7,))\n": [(1.0, 2.0), (3.0, 4.0), (6.0, None), (None, 7.0), (None, None)],
        "POLYGON ((1  2 ,\t3\t4 9,  5))": [(1.0, 2.0), (3.0, 4.0), (5.0, None)],
        "POLYGON (( 1 2 , 3 4 ))": [(1.0, 2.0), (3.0, 4.0)],
        "POLYGON (( ))": [(None, None)],
        "POLYGON (())": None,
        "POLYGON ((1 2), (3 4))": None,
        "none": None,
        None: None,
    }
    df = spark.createDataFrame([(t,) for t in ways], "wkt string").select("wkt", wkt_to_ring(F.col("wkt")).alias("ring"))
    assert {r.wkt: r.ring and [tuple(v) for v in r.ring] for r in df.collect()} == ways


def test_wkt_decode_reads_each_text_once(spark):
    """No filter with a copy of all steps stands below the vertices."""
    plan = QUERIES["wkt_decode"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 1


def test_only_repeated_keys_are_moved(spark):
    """Rings of keys that come once are converted in place; others are merged by place, null keys as well."""
    square = "4|1,1;2,2|1-{0},4838000,{1},4838000,{1},4838300,{0},4838300,{0},4838000;".format
    one, two, off = square(12950000, 12950300), square(12960000, 12960300), "4|0|1-1,-5,2,-5,2,-6,1,-5;"
    rows = [("a", one), ("b", one), ("b", two), (None, two), (None, one), ("c", off), ("d", off), ("d", one), ("e", "bad"), ("f", None), ("f", one), ("g", "bad"), ("g", "bad")]
    df = spark.createDataFrame(rows, "k string, geo string")
    alone = {geo: rings_wgs84(df.limit(0).unionByName(spark.createDataFrame([("x", geo)], df.schema)), ["k"]).first().ring for geo in (one, two)}
    both = [v for pair in zip(alone[one], alone[two]) for v in sorted(pair)]
    found = [(r.k, r.ring) for r in rings_wgs84(df, ["k"]).collect()]
    assert len(found) == 6 and dict(found) == {"a": alone[one], "b": both, None: both, "c": None, "d": None, "f": alone[one]}
    plan = rings_wgs84(df.where("k in ('a', 'c', 'e')"), ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
