import math
import random

import pytest
from pyspark.sql import functions as F

from placehull.functions.coords import convert, haversine_km, outside_china
from placehull.functions.utm import to_utm


def converted(spark, points, source, target):
    df = spark.createDataFrame(
        [(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "i int, lng double, lat double"
    )
    return [(r.lng, r.lat) for r in convert(df, source, target).orderBy("i").collect()]


def test_documented_point(spark):
    [(lng, lat)] = converted(spark, [(116.316833, 39.998877)], "bd09", "wgs84")
    assert abs(lng - 116.30420708125263) < 1e-12
    assert abs(lat - 39.991595084258336) < 1e-12


COUNTRY = (75.0, 130.0, 5.0, 50.0)


# The inverse is the documented single step 2x - f(x): it errs by the product of the offset
# (0.01 degrees at most) and its slope (0.01 at most).
@pytest.mark.parametrize(
    "a, b, box, tolerance",
    [
        ("gcj02", "bd09", COUNTRY, 2e-6),
        ("wgs84", "gcj02", COUNTRY, 1e-4),
        ("wgs84", "bd09", COUNTRY, 1e-4),
    ],
)
def test_round_trips(spark, a, b, box, tolerance):
    rng = random.Random(5)
    points = [(rng.uniform(*box[:2]), rng.uniform(*box[2:])) for _ in range(200)]
    back = converted(spark, converted(spark, points, a, b), b, a)
    for (x, y), (u, v) in zip(points, back):
        assert abs(x - u) < tolerance and abs(y - v) < tolerance


def test_no_offset_outside_the_box(spark):
    points = [(71.9, 30.0), (138.0, 30.0), (100.0, 0.5), (100.0, 56.0)]
    assert converted(spark, points, "wgs84", "gcj02") == points
    df = spark.createDataFrame([(72.004, 0.8293), (72.0, 10.0)], "lng double, lat double")
    flags = [r[0] for r in df.select(F.expr(outside_china("lng", "lat"))).collect()]
    assert flags == [False, True]


def test_mercator_needs_a_band(spark):
    got = converted(spark, [(12948599.7, 4837127.85), (1.0, 0.0), (1.0, -5.0)], "bd09mc", "wgs84")
    assert abs(got[0][0] - 116.305) < 1e-2 and abs(got[0][1] - 39.985) < 1e-2
    assert got[1:] == [(None, None)] * 2


def test_missing_coordinates_stay_missing(spark):
    df = spark.createDataFrame([(None, 40.0)], "lng double, lat double")
    assert convert(df, "bd09", "wgs84").collect()[0].lng is None


def test_haversine(spark):
    df = spark.createDataFrame([(116.0, 40.0, 116.0, 41.0)], "a double, b double, c double, d double")
    got = df.select(haversine_km(*(F.col(c) for c in "abcd"))).first()[0]
    assert abs(got - math.radians(1) * 6378.137) < 1e-9


def test_utm_on_and_beside_the_meridian(spark):
    df = spark.createDataFrame(
        [(0, 117.0, 40.0), (1, 116.0, 40.0), (2, 118.0, 40.0), (3, 117.0, 0.0)],
        "i int, lng double, lat double",
    )
    rows = to_utm(df, [(("lng", "lat"), ("e", "n"))]).orderBy("i").collect()
    assert abs(rows[0].e - 500000) < 1e-6 and abs(rows[0].n - 4427757.2187) < 1e-3
    assert abs((rows[1].e - 500000) + (rows[2].e - 500000)) < 1e-6
    assert abs(rows[1].n - rows[2].n) < 1e-6
    assert abs(rows[3].n) < 1e-6
    cut = to_utm(df, [(("lng", "lat"), ("e", "n"))], cut=True).orderBy("i").collect()
    assert [(r.e, r.n) for r in cut] == [(r.e, r.n) for r in rows]
