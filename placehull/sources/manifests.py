"""Request manifests: what a fetcher would have to ask for. Nothing is fetched here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placehull.options import MatchOptions


def category_segment(prim: Column, sec: Column) -> Column:
    """Both categories -> ``a;b`` and scope 2; one -> that one and scope 2; none -> scope 1."""
    tag = F.concat_ws(";", F.nullif(prim, F.lit("")), F.nullif(sec, F.lit("")))
    return F.when(tag == "", "&scope=1").otherwise(
        F.concat(F.lit("&tag="), F.url_encode(tag), F.lit("&scope=2"))
    )


def search_manifest(poi: DataFrame, options: MatchOptions, key_slots: int = 1) -> DataFrame:
    """One request row per unresolved, prepared POI; keys are slot numbers, never secrets."""
    request = F.concat(
        F.lit("query="), F.url_encode("name"),
        F.lit("&location="), F.col("lat_wgs84").cast("string"),
        F.lit(","), F.col("lng_wgs84").cast("string"),
        F.lit(f"&radius={options.radius:g}&radius_limit={options.radius_limit}"),
        F.lit("&output=json&coord_type=1"),
        category_segment(F.col("prim_ind"), F.col("sec_ind")),
    )
    slot = F.pmod(F.col("poi_id"), F.lit(key_slots)).cast("int")
    return poi.where(F.col("status").isNull()).select(
        "poi_id", slot.alias("key_slot"), request.alias("request")
    )


def boundary_manifest(accepted: DataFrame) -> DataFrame:
    """One request row per accepted candidate."""
    request = F.concat(F.lit("qt=ext&uid="), F.url_encode("uid"), F.lit("&ext_ver=new&l=11"))
    return accepted.select("poi_id", "uid", "uid_name", "search_rank", request.alias("request"))
