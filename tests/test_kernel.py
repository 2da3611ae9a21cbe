"""The ring kernel against the column expressions, shapely-free brute force and closed forms; documented names."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from placehull.functions import coords
from placehull.functions.text import name_similarity
from placehull.functions.utm import to_utm
from placehull.operators import ringkernel as k
from placehull.operators.outlines import measure_rings

# fixed values: names of matched areas and points of the documented example, with their similarity
DOCUMENTED = [
    ("弘善家园", "弘善家园", 1.0),
    ("望京西园(一区)", "望京西园一区", 0.8571),
    ("沿海赛洛城", "沿海赛洛城七期", 0.8333),
    ("马甸南村小区", "马甸南村", 0.8),
    ("农光东里", "农光东里", 1.0),
    ("国美第一城-3号院", "国美第一城3号院", 0.9412),
    ("月华轩小区", "北太平庄路2号院", 0.0),
]


def test_documented_similarities(spark):
    df = spark.createDataFrame([(a, b) for a, b, _ in DOCUMENTED], "a string, b string")
    rows = df.select("a", "b", name_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert {(r.a, r.b): round(r.s, 4) for r in rows} == {(a, b): s for a, b, s in DOCUMENTED}


def test_kernel_equals_the_column_conversions(spark):
    """Points of all six Mercator bands and beyond."""
    rng = random.Random(8)
    lows = [band[0] for band in coords.BD_MERCATOR]
    ys = [rng.uniform(low, high) for low, high in zip(lows, [18e6, *lows]) for _ in range(40)] + [0.0, -5.0]
    points = [(i, rng.uniform(8e6, 15e6), y) for i, y in enumerate(ys)]
    df = coords.convert(spark.createDataFrame(points, "i int, x double, y double"), "bd09mc", "wgs84", "x", "y")
    rows = to_utm(df, [(("lng", "lat"), ("e", "n"))]).orderBy("i").collect()
    x, y = (np.array([p[j] for p in points]) for j in (1, 2))
    lng, lat = k.gcj02_to_wgs84(*k.bd09_to_gcj02(*k.mercator_to_bd09(x, y)))
    e, n = k.wgs84_to_utm(lng, lat, 117.0)
    for r, *mine in zip(rows, lng, lat, e, n):
        if r.lng is None:
            assert np.isnan(mine[0]) and np.isnan(mine[3])
        else:
            assert mine[:2] == pytest.approx([r.lng, r.lat], abs=1e-11) and mine[2:] == pytest.approx([r.e, r.n], abs=1e-5)


def test_mercator_bands_meet_and_follow_the_closed_form():
    """Bands agree where they meet, and each follows the ellipsoid's Mercator, which the fixed values approximate."""
    for (low, *_), (_, *_) in zip(coords.BD_MERCATOR[:-1], coords.BD_MERCATOR[1:]):
        above, below = (k.mercator_to_bd09(np.array([1.2e7]), np.array([low + d])) for d in (1e-3, -1e-3))
        jump = 0.02 if low > 12e6 else 2e-6  # the published values of the highest band start a little above the next
        assert abs(above[0][0] - below[0][0]) < 1e-6 and abs(above[1][0] - below[1][0]) < jump
    a, f = 6378137.0, 1 / 298.257223563
    e = math.sqrt(f * (2 - f))
    for y in (5e5, 2.5e6, 4.5e6, 7e6, 1e7, 1.4e7):
        lat = 2 * math.atan(math.exp(y / a)) - math.pi / 2
        for _ in range(20):
            lat = 2 * math.atan(math.exp(y / a) * ((1 + e * math.sin(lat)) / (1 - e * math.sin(lat))) ** (e / 2)) - math.pi / 2
        found = k.mercator_to_bd09(np.array([1.2e7]), np.array([y]))[1][0]
        assert found == pytest.approx(math.degrees(lat), abs=0.004)


def distance_by_force(x, y, ring):
    inside, best = False, math.inf
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
            inside = not inside
        dx, dy = bx - ax, by - ay
        length = dx * dx + dy * dy
        t = 0 if not length else max(0, min(1, ((x - ax) * dx + (y - ay) * dy) / length))
        best = min(best, math.hypot(ax + t * dx - x, ay + t * dy - y))
    return 0.0 if inside else best


def test_figures_of_rings(spark):
    """Random rings next to missing ones: area, box, distance; start, direction and neighbours do not matter."""
    rng, rows, want = random.Random(3), [], {}
    for i in range(60):
        n = rng.randrange(3, 40)
        cx, cy = rng.uniform(1.28e7, 1.31e7), rng.uniform(4.5e6, 4.9e6)
        turn = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
        ring = [(cx + rng.uniform(50, 500) * math.cos(t), cy + rng.uniform(50, 500) * math.sin(t)) for t in turn]
        rows.append((2 * i, [v for p in [*ring, ring[0]] for v in p], cx, cy))
        moved = ring[3:] + ring[:3] if i % 2 else ring[::-1]
        rows.append((2 * i + 1, [v for p in [*moved, moved[0]] for v in p], cx, cy))
        want[i] = ring
    rows += [(1000, None, 1.29e7, 4.8e6), (1001, [0.0, -5.0, 1.0, -5.0, 1.0, -6.0, 0.0, -5.0], 1.29e7, 4.8e6)]
    df = spark.createDataFrame(rows, "i int, numbers array<double>, cx double, cy double")
    far = coords.convert(df.withColumn("cx", F.col("cx") + 300), "bd09mc", "wgs84", "cx", "cy", out=("p_lng", "p_lat"))
    points = to_utm(far, [(("p_lng", "p_lat"), ("p_e", "p_n"))]).cache()
    found = {r.i: r for r in measure_rings(points, "i", [], ("p_e", "p_n"), 50).collect()}
    at = {r.i: (r.p_e, r.p_n) for r in points.collect()}
    assert len(found) == len(rows) and found[1000].area_km2 is None and found[1001].edges is None
    for i, ring in want.items():
        x, y = (np.array([p[j] for p in [*ring, ring[0]]]) for j in (0, 1))
        lng, lat = k.gcj02_to_wgs84(*k.bd09_to_gcj02(*k.mercator_to_bd09(x, y)))
        e, n = k.wgs84_to_utm(lng, lat, 117.0)
        area = abs(sum(a * d - b * c for a, b, c, d in zip(e - e[0], n - n[0], e[1:] - e[0], n[1:] - n[0]))) / 2e6
        for r in (found[2 * i], found[2 * i + 1]):
            assert r.edges == len(ring) and r.area_km2 == pytest.approx(area, abs=1e-9)
            assert (r.min_lng, r.max_lat) == pytest.approx((lng.min(), lat.max()), abs=1e-12)
            assert r.distance_m == pytest.approx(distance_by_force(*at[2 * i], list(zip(e, n))), abs=1e-5)
    without = measure_rings(points, "i", [], ("p_e", "p_n"), 50, with_distance=False).collect()
    assert all(r.distance_m is None and r.area_km2 == found[r.i].area_km2 for r in without)
    assert measure_rings(points.limit(0), "i", [], ("p_e", "p_n"), 50).count() == 0
