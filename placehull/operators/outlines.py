"""Candidates meet their boundary responses; areas, boxes and distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placehull.functions.coords import (
    BD_MERCATOR,
    BD09_TO_GCJ02,
    BD09MC_TO_BD09,
    GCJ02_TO_WGS84,
    num,
    run_steps,
)
from placehull.functions.rings import is_multi_part, with_ring_numbers
from placehull.functions.utm import to_utm
from placehull.operators.ringkernel import MEASURES, ring_measures
from placehull.options import MatchOptions


def response_order(geo: str = "geo") -> Column:
    """Which of several responses to one request counts, least first: one with an outline, then by its digest.

    Batch and stream share this rule, so the order of arrival does not matter.
    """
    return F.struct(F.col(geo).isNull().alias("none"), F.md5(F.col(geo).cast("binary")).alias("digest"))


def boundaries_once(decoded: DataFrame) -> DataFrame:
    """One boundary per (poi_id, uid), the least by ``response_order``, merged map-side."""
    keyed = decoded.select(
        F.struct("poi_id", "uid").alias("aoi_key"), response_order().alias("pick"), "geo", "multi_part"
    )
    least = F.min(F.struct("pick", "geo", "multi_part"))
    return keyed.groupBy("aoi_key").agg(least.alias("b")).select(
        "aoi_key", F.col("b.geo").alias("geo"), F.col("b.multi_part").alias("multi_part"),
        F.lit(True).alias("called"),
    )


def attach_boundaries(accepted: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Candidates left-joined to their boundary; ``called`` tells whether a response came."""
    joined = accepted.join(boundaries, "aoi_key", "left")
    return joined.withColumn("called", F.coalesce("called", F.lit(False)))


def attach_answers(accepted: DataFrame, decoded: DataFrame, how: str = "left") -> DataFrame:
    """``attach_boundaries`` of all decoded responses: joined first, then the least by ``response_order`` per candidate, which stands in ``pick``.

    Only key and outline are moved, once; digests are made for candidates alone. The join leaves the rows grouped and sorted by its key,
    which the aggregate takes over. With ``how`` "inner" candidates without an answer are left out.
    """
    answers = decoded.select(F.struct("poi_id", "uid").alias("aoi_key"), "geo", F.lit(True).alias("__came"))
    rows = accepted.join(answers, "aoi_key", how).withColumn("__pick", F.struct(response_order().alias("pick"), "geo"))
    fields = [c for c in accepted.columns if c != "aoi_key"]
    least = rows.groupBy("aoi_key").agg(
        *[F.first(c).alias(c) for c in fields], F.min("__pick").alias("__least"), F.bool_or("__came").alias("called")
    )
    geo = F.col("__least.geo")
    return least.select(
        "aoi_key", *fields, geo.alias("geo"), F.when(F.col("called"), is_multi_part(geo)).alias("multi_part"),
        F.coalesce("called", F.lit(False)).alias("called"), F.col("__least.pick").alias("pick"),
    )


def measure_rings(
    df: DataFrame, key: str, carry: list[str], origin: tuple[str, str], zone: int, with_distance: bool = True
) -> DataFrame:
    """Edges, box (degrees), area and distance to ``origin`` (UTM columns) of each row's ring.

    Row by row in Arrow batches (``ringkernel``): no shuffle, and it runs in a stream as well.
    """
    found = ring_measures(zone, with_distance)("numbers", *origin)
    rows = df.select(key, *carry, found.alias("m"))
    return rows.select(key, *carry, *[F.col(f"m.{c}").alias(c) for c in MEASURES])


# --- bound used by drop_far_rings, see there ---
BEND = 0.05  # per degree of box width plus height; the offsets bend by less than 0.035
SLACK = 2e-5  # degrees
SMOOTH_BOX = (72.2, 137.6, 1.0, 55.6)  # bd09 degrees well inside the gcj02 box


def drop_far_rings(df: DataFrame, numbers: str = "numbers") -> DataFrame:
    """Remove rings whose box cannot hold the POI before their vertices are converted.

    Mercator to bd09 is monotone in each axis within a band, so the ring's Mercator box is a
    bd09 box. From there to wgs84 each point moves by an offset that changes by less than 0.035
    of the distance between two points inside the gcj02 box. So the wgs84 box lies within the
    bd09 box carried along with one corner, widened by a twentieth of its size. A POI outside
    that cannot be in the exact box. Rings across two bands or near the edge of the gcj02 box
    are all kept.
    """
    columns = df.columns
    df = df.withColumns({
        f"__{end}{axis}": F.expr(f"array_{end}(filter({numbers}, (v, i) -> i % 2 = {k}))")
        for k, axis in enumerate("xy") for end in ("min", "max")
    })
    bands = " + ".join(f"case when {{y}} > {num(low)} then 1 else 0 end" for low, *_ in BD_MERCATOR)
    one_band = f"({bands.format(y='__miny')}) = ({bands.format(y='__maxy')}) and __miny > 0D"
    df = df.withColumn("__one_band", F.expr(one_band))
    df = run_steps(df, BD09MC_TO_BD09, [
        (("__minx", "__miny"), ("__lng0", "__lat0")), (("__maxx", "__maxy"), ("__lng1", "__lat1")),
    ])
    corner = [(("__lng0", "__lat0"), ("__wlng", "__wlat"))]
    df = run_steps(df, BD09_TO_GCJ02 + GCJ02_TO_WGS84, corner)
    west, east, south, north = (num(v) for v in SMOOTH_BOX)
    smooth = (
        f"__one_band and __lng0 > {west} and __lng1 < {east} and __lat0 > {south} and __lat1 < {north}"
    )
    room = f"({num(BEND)} * (__lng1 - __lng0 + __lat1 - __lat0) + {num(SLACK)})"
    near = (
        f"p_lng between __wlng - {room} and __wlng + __lng1 - __lng0 + {room}"
        f" and p_lat between __wlat - {room} and __wlat + __lat1 - __lat0 + {room}"
    )
    keep = f"case when ({smooth}) and not ({near}) then null else {numbers} end"
    return df.withColumn(numbers, F.expr(keep)).select(*columns)


CARRIED = ["search_rank", "uid_name", "p_name", "p_lng", "p_lat", "called", "multi_part"]


def aoi_metrics(
    attached: DataFrame, options: MatchOptions, prune: bool = True, keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per accepted candidate with its metrics; nulls where there is no usable ring.

    The distance is measured only when that sort is on. ``keep``: further columns to hand on. Every step works row by row, in a batch or a stream.

    With ``prune`` rings that cannot hold the POI in their box get nulls as well: they are never
    valid, and most candidates of a search are of that kind.
    """
    rows = with_ring_numbers(attached)
    if "geo" not in keep:
        rows = rows.drop("geo")
    if prune:
        rows = drop_far_rings(rows)
    rows = to_utm(rows, [(("p_lng", "p_lat"), ("p_e", "p_n"))], options.utm_zone)
    sums = measure_rings(rows, "aoi_key", [*CARRIED, *keep], ("p_e", "p_n"), options.utm_zone, "distance" in options.enabled_sorts)
    return sums.withColumns({
        "poi_id": F.col("aoi_key.poi_id"), "uid": F.col("aoi_key.uid"),
    }).drop("aoi_key")
