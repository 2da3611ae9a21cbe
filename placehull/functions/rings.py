"""Encoded rings, vertex rows, WKT and GeoJSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placehull.operators.ringkernel import ring_points
from placehull.session import stage

MIN_RING_POINTS = 4  # a closed triangle


def ring_part(geo: Column) -> Column:
    """Third '|' part of ``4|box|1-x1,y1,...;`` (null when missing)."""
    return F.get(F.split(geo, r"\|"), F.lit(2))


def is_multi_part(geo: Column) -> Column:
    part = ring_part(geo)
    return F.coalesce(F.substr(part, F.lit(3), F.length(part) - 3).contains(";"), F.lit(False))


def ring_numbers(geo: Column) -> Column:
    """Flat [x1, y1, x2, y2, ...] of the first ring; a bad token leaves a null element.

    The two-character prefix and the last character are dropped, an odd tail is ignored.
    """
    part = ring_part(geo)
    body = F.substring_index(F.substr(part, F.lit(3), F.length(part) - 3), ";", 1)
    return F.split(body, ",").try_cast("array<double>")


def closed(numbers: Column) -> Column:
    """Whole pairs only, first pair repeated at the end unless already there.

    Null when any number is missing or the closed ring has too few points.
    """
    even = F.size(numbers) - F.size(numbers) % 2
    pairs = F.slice(numbers, F.lit(1), even)
    last_is_first = (F.get(numbers, even - 2) == F.get(numbers, F.lit(0))) & (
        F.get(numbers, even - 1) == F.get(numbers, F.lit(1))
    )
    ring = F.when(last_is_first, pairs).otherwise(
        F.concat(pairs, F.slice(numbers, F.lit(1), F.lit(2)))
    )
    usable = F.size(F.array_compact(pairs)) == even
    return F.when((even >= 2 * (MIN_RING_POINTS - 1)) & usable, ring)


def with_ring_numbers(df: DataFrame, geo: str = "geo", out: str = "numbers") -> DataFrame:
    df = df.withColumn(out, ring_numbers(F.col(geo))).withColumn(out, closed(F.col(out)))
    return df.withColumn(out, F.when(F.size(out) >= 2 * MIN_RING_POINTS, F.col(out)))


def explode_vertices(df: DataFrame, numbers: str = "numbers", keep: list[str] | None = None) -> DataFrame:
    """One row per vertex: pos (0-based), x, y. Rows without a ring disappear.

    They do so in the generator: a filter on the ring would be pushed below its decoding, with a copy of all steps
    in its condition for each use.
    """
    keep = keep if keep is not None else [c for c in df.columns if c != numbers]
    index = F.sequence(F.lit(0), F.floor(F.size(numbers) / 2).cast("int") - 1)
    index = F.when(F.col(numbers).isNotNull(), index)
    rows = df.select(*keep, numbers, F.explode(index).alias("pos"))
    return rows.select(
        *keep,
        "pos",
        F.get(numbers, F.col("pos") * 2).alias("x"),
        F.get(numbers, F.col("pos") * 2 + 1).alias("y"),
    )


def vertices_wgs84(df: DataFrame, numbers: str = "numbers", keep: list[str] | None = None) -> DataFrame:
    """Vertex rows (0-based ``pos``) with ``lng``/``lat`` in wgs84 degrees (NaN off every band)."""
    keep = keep if keep is not None else [c for c in df.columns if c != numbers]
    rows = df.select(*keep, ring_points()(numbers).alias("__points"))
    rows = rows.select(*keep, F.posexplode("__points").alias("pos", "v"))
    return rows.select(*keep, "pos", F.col("v.lng").alias("lng"), F.col("v.lat").alias("lat"))


def rings_wgs84(df: DataFrame, keys: list[str], geo: str = "geo") -> DataFrame:
    """Decode ``geo`` into ``ring: array<struct<lng, lat>>``, one row per key.

    Rings are converted whole, row by row; rows of one key are merged by place, as all their vertices in one order. Only keys that
    may come twice are grouped (``_repeated``), so that the rings of all others are not moved.
    """
    rows = df.select(*keys, geo)
    numbers = F.col("numbers").alias("numbers")
    again = _repeated(rows, keys)
    if again is None:
        single, several = rows, None
    else:
        marked = rows.withColumn("__key", F.xxhash64(*keys)).join(again, "__key", "left")
        single = marked.where("__again is null")
        several = with_ring_numbers(marked.where("__again"), geo).groupBy(*keys).agg(F.collect_list("numbers").alias("rs"))
    whole = ring_points(whole=True)
    out = with_ring_numbers(single, geo).select(*keys, numbers).select(*keys, F.struct(F.col("numbers").isNotNull().alias("there"), whole("numbers").alias("ring")).alias("r"))
    # a ring off the bands is a row without a ring; the flag stands beside the conversion, so that no filter is pushed below the decoding
    out = out.where("r.there").select(*keys, "r.ring")
    if several is None:
        return out
    several = several.where(F.size("rs") > 0).select(*keys, "rs", whole(F.flatten("rs")).alias("points"))
    places = F.flatten(F.transform("rs", lambda r: F.sequence(F.lit(0), F.floor(F.size(r) / 2).cast("int") - 1)))
    placed = F.zip_with(places, "points", lambda pos, v: F.struct(pos.alias("pos"), v["lng"].alias("lng"), v["lat"].alias("lat")))
    merged = F.transform(F.array_sort(placed), lambda v: F.struct(v["lng"].alias("lng"), v["lat"].alias("lat")))
    ring = F.when(F.size("rs") > 1, merged).otherwise(F.col("points"))
    return out.unionByName(several.select(*keys, ring.alias("ring")))


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame | None:
    """Hashes of keys that more than one row has, with a flag ``__again`` (a few others may share a hash); None if there are none."""
    counts = rows.groupBy(F.xxhash64(*keys).alias("__key")).agg(F.count("*").alias("n"))
    again = stage(counts.where("n > 1").select("__key", F.lit(True).alias("__again")), "repeated_keys")
    return None if again.isEmpty() else again


def ring_to_wkt(ring: Column) -> Column:
    points = F.transform(ring, lambda v: F.concat_ws(" ", v["lng"].cast("string"), v["lat"].cast("string")))
    return F.when(ring.isNotNull(), F.concat(F.lit("POLYGON (("), F.array_join(points, ", "), F.lit("))")))


def wkt_to_ring(wkt: Column) -> Column:
    """Single-ring POLYGON text to array<struct<lng, lat>>; anything else is null.

    Where single spaces are the only white space, points are cut by plain text functions; a split by a pattern compiles it for each point.
    """
    body = F.regexp_extract(wkt, r"(?i)^\s*POLYGON\s*\(\(([^()]*)\)\)\s*$", 1)

    def vertex(lng: Column, lat: Column) -> Column:
        return F.struct(lng.try_cast("double").alias("lng"), lat.try_cast("double").alias("lat"))

    def plain(point: Column) -> Column:
        lat = F.when(point.contains(" "), F.substring_index(F.substring_index(point, " ", 2), " ", -1))
        return vertex(F.substring_index(point, " ", 1), lat)

    def spaced(parts: Column) -> Column:
        return vertex(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))

    def ring(text: Column) -> Column:
        points = F.transform(F.transform(F.split(text, ","), lambda p: F.trim(p)), plain)
        others = F.transform(F.transform(F.split(text, r"\s*,\s*"), lambda p: F.split(F.trim(p), r"\s+")), spaced)
        return F.when(F.length(text) > 0, F.when(text.rlike(r"[^\S ]|  "), others).otherwise(points))

    return F.get(F.transform(F.array(body), ring), F.lit(0))  # so that the body is cut out once


def ring_to_geojson(ring: Column) -> Column:
    """Polygon geometry object as a struct ready for ``to_json``."""
    points = F.transform(ring, lambda v: F.array(v["lng"], v["lat"]))
    return F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates"))
