import random

from pyspark.sql import functions as F

from conftest import SMALL
from placehull.functions.coords import BD_MERCATOR
from placehull.operators.outlines import aoi_metrics
from placehull.operators.validity import box_contains
from placehull.options import MatchOptions
from placehull.plans.queries import match_job


def test_bands_are_monotone():
    tops = [20037508.0, *[b[0] for b in BD_MERCATOR]]
    for top, (low, _, _, *poly, scale) in zip(tops, BD_MERCATOR):
        values = []
        for i in range(2001):
            c = (low + (top - low) * i / 2000) / scale
            values.append(sum(a * c**k for k, a in enumerate(poly)))
        assert all(a < b for a, b in zip(values, values[1:]))


def random_outlines(spark, n=400):
    """Rings of all sizes all over the country, with a point in or around each of them."""
    rng = random.Random(8)
    rows = []
    for i in range(n):
        x, y = rng.uniform(8.2e6, 1.5e7), rng.uniform(1.5e5, 7.3e6)
        size = 10 ** rng.uniform(1, 5.3)
        ring = [(x + rng.uniform(0, size), y + rng.uniform(0, size)) for _ in range(6)]
        geo = "4|0,0;0,0|1-" + ",".join(f"{a},{b}" for a, b in ring) + ";"
        rows.append((i, f"u{i}", geo, x + size * rng.uniform(-0.3, 1.3), y + size * rng.uniform(-0.3, 1.3)))
    return spark.createDataFrame(rows, "poi_id bigint, uid string, geo string, mx double, my double")


def test_pruned_rings_never_hold_their_point(spark):
    from placehull.functions.coords import convert

    df = convert(random_outlines(spark), "bd09mc", "wgs84", "mx", "my", ("p_lng", "p_lat"))
    df = df.select(
        F.struct("poi_id", "uid").alias("aoi_key"), "geo", "p_lng", "p_lat",
        F.lit(1).alias("search_rank"), F.lit("a").alias("uid_name"), F.lit("a").alias("p_name"),
        F.lit(True).alias("called"), F.lit(False).alias("multi_part"),
    )
    inside = {}
    for prune in (False, True):
        rows = aoi_metrics(df, MatchOptions(), prune=prune).withColumn(
            "inside", F.coalesce(box_contains(F.col("p_lng"), F.col("p_lat")), F.lit(False))
        ).collect()
        inside[prune] = {r.poi_id for r in rows if r.inside}
        if prune:
            dropped = sum(r.area_km2 is None for r in rows)
    assert inside[True] == inside[False] and 50 < len(inside[True]) < 350
    assert dropped > 50


def test_same_validity_on_the_views(spark):
    attached = match_job(spark, SMALL).attached
    held = [
        {
            (r.poi_id, r.uid, r.area_km2)
            for r in aoi_metrics(attached, MatchOptions(), prune=prune)
            .where(box_contains(F.col("p_lng"), F.col("p_lat"))).collect()
        }
        for prune in (False, True)
    ]
    assert held[0] == held[1] and held[0]
