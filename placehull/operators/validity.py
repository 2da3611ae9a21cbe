"""Which measured areas may be matched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placehull.functions.text import name_similarity
from placehull.options import MatchOptions

#: Columns that only ``valid`` is judged by; they are not staged.
JUDGED_BY = ("p_name", "p_lng", "p_lat", "multi_part", "edges", "min_lng", "min_lat", "max_lng", "max_lat")


def box_contains(lng: Column, lat: Column) -> Column:
    return lng.between(F.col("min_lng"), F.col("max_lng")) & lat.between(
        F.col("min_lat"), F.col("max_lat")
    )


def judge_aois(metrics: DataFrame, options: MatchOptions) -> DataFrame:
    """Add ``similarity`` (only when that sort is on) and ``valid``.

    Names are compared only for areas that pass the box and size tests; the others reach
    the Python worker as nulls and cost nothing there.
    """
    fits = F.coalesce(
        box_contains(F.col("p_lng"), F.col("p_lat"))
        & F.col("area_km2").between(options.min_aoi_area, options.max_aoi_area),
        F.lit(False),
    )
    rows = metrics.withColumn("fits", fits)
    if not options.sort_by_similarity:
        return rows.withColumnRenamed("fits", "valid")
    name = F.when(F.col("fits"), F.col("uid_name"))
    rows = rows.withColumn("similarity", name_similarity(name, F.col("p_name")))
    alike = F.coalesce(F.col("similarity") >= options.min_similarity, F.lit(False))
    return rows.withColumn("valid", F.col("fits") & alike).drop("fits")
