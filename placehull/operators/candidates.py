"""Search results to accepted candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placehull.functions.coords import convert, haversine_km
from placehull.options import MatchOptions
from placehull.sources.responses import flatten_results


def has_keys(uid: Column, name: Column, lng: Column, lat: Column) -> Column:
    """uid, name and location all present: null, '' and 0.0 count as missing."""
    return F.coalesce((uid != "") & (name != "") & (lng != 0) & (lat != 0), F.lit(False))


def category_matches(tag: Column, prim: Column, sec: Column) -> Column:
    """No tag passes. ``a;b`` must equal both parts, a plain tag must contain either value.

    A blank value puts no constraint on its part; a tag of three or more parts never passes.
    """
    parts = F.split(tag, ";")
    pair = (
        (F.size(parts) == 2)
        & ((prim == "") | (F.get(parts, F.lit(0)) == prim))
        & ((sec == "") | (F.get(parts, F.lit(1)) == sec))
    )
    plain = (
        ((prim == "") & (sec == ""))
        | ((prim != "") & tag.contains(prim))
        | ((sec != "") & tag.contains(sec))
    )
    return F.when(tag.isNull(), True).when(tag.contains(";"), pair).otherwise(plain)


def judge_candidates(
    poi: DataFrame, decoded: DataFrame, options: MatchOptions, keep: tuple[str, ...] = (), outer: bool = False
) -> DataFrame:
    """All search results of the given POIs with the first rule they fail (null = accepted).

    ``keep``: columns of ``decoded`` to hand on; ``outer``: responses without results keep a (failing) row.

    Responses are joined to their POI before the results are exploded, so the shuffle moves
    one compact row per response; adaptive skew handling may split a hot POI there because
    nothing above the join relies on its partitioning.
    """
    side = poi.select(
        "poi_id",
        F.col("name").alias("p_name"),
        F.col("lng_wgs84").alias("p_lng"),
        F.col("lat_wgs84").alias("p_lat"),
        "prim_ind",
        "sec_ind",
    )
    carry = (*keep, "p_name", "p_lng", "p_lat", "prim_ind", "sec_ind")
    rows = flatten_results(decoded.join(side, "poi_id"), *carry, outer=outer)
    rows = convert(rows, "bd09", "wgs84", "u_lng", "u_lat", ("__lng", "__lat"))
    away = haversine_km(F.col("__lng"), F.col("__lat"), F.col("p_lng"), F.col("p_lat"))
    rows = rows.withColumn("distance_km", away).drop("__lng", "__lat")
    reason = (
        F.when(~has_keys(*(F.col(c) for c in ("uid", "uid_name", "u_lng", "u_lat"))), "key")
        .when(~(F.col("distance_km") <= options.radius_km), "radius")
        .when(~category_matches(F.col("u_tag"), F.col("prim_ind"), F.col("sec_ind")), "tag")
    )
    return rows.withColumn("reason", reason)


def passed(judged: DataFrame) -> DataFrame:
    """Accepted rows only.

    Written as a generator that yields nothing for a rejected row: a plain filter would be
    pushed below the staged conversions, with all of them folded into its condition.
    """
    keep = F.explode(F.when(F.col("reason").isNull(), F.array(F.lit(True)))).alias("__keep")
    return judged.select("*", keep).drop("__keep")


CANDIDATE_FIELDS = ("search_rank", "uid_name", "p_name", "p_lng", "p_lat")


def accept(judged: DataFrame, options: MatchOptions) -> DataFrame:
    """Accepted candidates, a uid once per POI at its lowest rank.

    The grouping key is one struct: hashing it spreads a hot POI over all partitions (its
    plain ``poi_id`` partitioning would be reused otherwise), and repeated uids are merged
    map-side before the shuffle.
    """
    rows = passed(judged)
    if options.use_first_uid:
        best = F.min(F.struct("search_rank", "uid", *CANDIDATE_FIELDS[1:])).alias("c")
        first = rows.groupBy("poi_id").agg(best)
        return first.select(
            F.struct("poi_id", F.col("c.uid").alias("uid")).alias("aoi_key"),
            "poi_id",
            "c.uid",
            *[F.col(f"c.{f}").alias(f) for f in CANDIDATE_FIELDS],
        )
    keyed = rows.select(F.struct("poi_id", "uid").alias("aoi_key"), *CANDIDATE_FIELDS)
    lowest = keyed.groupBy("aoi_key").agg(F.min(F.struct(*CANDIDATE_FIELDS)).alias("c"))
    return lowest.select(
        "aoi_key",
        F.col("aoi_key.poi_id").alias("poi_id"),
        F.col("aoi_key.uid").alias("uid"),
        *[F.col(f"c.{f}").alias(f) for f in CANDIDATE_FIELDS],
    )
