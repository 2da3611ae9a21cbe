"""Captured search and boundary responses, batch or streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placehull.functions.rings import is_multi_part

SEARCH_SCHEMA = (
    "struct<status:int, results:array<struct<name:string, uid:string, "
    "location:struct<lat:double,lng:double>, detail_info:struct<tag:string>>>>"
)


def status_class(status: Column) -> Column:
    """Service status: ok, or the kind of failure."""
    hundred = F.floor(status / 100)
    return (
        F.when(status == 0, "ok")
        .when(hundred == 2, "parameter")
        .when(hundred == 3, "verify")
        .when(hundred == 4, "quota")
        .when(hundred == 5, "key")
        .otherwise("error")
    )


def decode_search(responses: DataFrame, body: str = "body", carry: tuple[str, ...] = ()) -> DataFrame:
    """poi_id, service_status, status_class, results (parsed before any shuffle); batch or stream."""
    parsed = responses.select("poi_id", *carry, F.from_json(body, SEARCH_SCHEMA).alias("r"))
    return parsed.select(
        "poi_id",
        *carry,
        F.col("r.status").alias("service_status"),
        status_class(F.col("r.status")).alias("status_class"),
        F.col("r.results").alias("results"),
    )


def flatten_results(decoded: DataFrame, *carry: str, outer: bool = False) -> DataFrame:
    """One row per search result; ``search_rank`` counts from 1 before any filter.

    ``outer``: a response without results keeps one row, with nulls. Refused responses yield nothing by way of a null array: a filter on the status would be
    pushed to the scan and parse every body a second time.
    """
    results = F.when(F.col("status_class") == "ok", F.col("results"))
    explode = F.posexplode_outer if outer else F.posexplode
    rows = decoded.select("poi_id", *carry, explode(results).alias("pos", "r"))
    return rows.select(
        "poi_id",
        *carry,
        F.col("r.uid").alias("uid"),
        F.col("r.name").alias("uid_name"),
        (F.col("pos") + 1).alias("search_rank"),
        F.col("r.location.lng").alias("u_lng"),
        F.col("r.location.lat").alias("u_lat"),
        F.col("r.detail_info.tag").alias("u_tag"),
    )


def decode_boundaries(responses: DataFrame, body: str = "body", carry: tuple[str, ...] = ()) -> DataFrame:
    """poi_id, uid, geo (null when the response has none), multi_part."""
    geo = F.get_json_object(body, "$.content.geo")
    return responses.select("poi_id", "uid", *carry, geo.alias("geo")).withColumn(
        "multi_part", is_multi_part(F.col("geo"))
    )


def without_answer(requests: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Boundary requests that were given up, as decoded responses without an outline: called, and no candidate."""
    return requests.select(
        "poi_id", "uid", *carry, F.lit(None).cast("string").alias("geo"), F.lit(False).alias("multi_part")
    )
