"""Status of each POI and the written-back result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCHED, NO_UID, NO_GEOMETRY = "Matched", "No Uid", "No Geometry"


def completion(judged_aois: DataFrame) -> DataFrame:
    """Accepted candidates, boundary responses seen and valid areas per POI."""
    return judged_aois.groupBy("poi_id").agg(
        F.count("*").alias("accepted"),
        F.count_if("called").alias("called"),
        F.count_if("valid").alias("valid"),
    )


def is_complete() -> Column:
    return F.col("called") == F.col("accepted")


def derive_status() -> Column:
    """From ``answered`` (an ok search response came) and the completion counts."""
    return (
        F.when(~F.coalesce("answered", F.lit(False)), F.lit(None).cast("string"))
        .when(F.coalesce("accepted", F.lit(0)) == 0, NO_UID)
        .when(F.col("called") < F.col("accepted"), F.lit(None).cast("string"))
        .when(F.col("valid") > 0, MATCHED)
        .otherwise(NO_GEOMETRY)
    )


def poi_status(poi: DataFrame, decoded: DataFrame, counts: DataFrame) -> DataFrame:
    """POI columns plus counts and status; all joins are on poi_id, so it is shuffled once."""
    answered = decoded.groupBy("poi_id").agg(
        F.bool_or(F.col("status_class") == "ok").alias("answered")
    )
    joined = poi.drop("status").join(answered, "poi_id", "left").join(counts, "poi_id", "left")
    return joined.withColumn("status", derive_status())


def write_back(status: DataFrame, best: DataFrame) -> DataFrame:
    """Name (and geometry, when ``best`` has it) of the best area onto the matched rows."""
    won = best.select("poi_id", *[c for c in ("uid", "uid_name", "geometry") if c in best.columns])
    base = status.drop(*[c for c in won.columns if c != "poi_id"])
    joined = base.join(won, "poi_id", "left")
    matched = F.col("status") == MATCHED
    return joined.withColumns(
        {c: F.when(matched, F.col(c)) for c in won.columns if c != "poi_id"}
    )
