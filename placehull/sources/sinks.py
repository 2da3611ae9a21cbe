"""Writers for result tables: CSV with WKT, GeoJSON feature lines, parquet rings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placehull.functions.rings import ring_to_geojson, ring_to_wkt


def with_wkt(results: DataFrame) -> DataFrame:
    return results.withColumn("geometry", ring_to_wkt(F.col("geometry")))


def geojson_features(results: DataFrame) -> DataFrame:
    """One Feature text per row that has a geometry (wgs84 degrees)."""
    rows = results.dropna(subset=["geometry"])
    properties = F.struct(*[F.col(c) for c in rows.columns if c != "geometry"])
    feature = F.struct(
        F.lit("Feature").alias("type"),
        properties.alias("properties"),
        ring_to_geojson(F.col("geometry")).alias("geometry"),
    )
    return rows.select(F.to_json(feature).alias("value"))


def write_csv(results: DataFrame, path: str) -> None:
    """UTF-8 with header to a new path; Spark cannot overwrite a table it is reading."""
    with_wkt(results).write.csv(path, header=True, quote='"', escape='"', encoding="UTF-8")


def write_features(results: DataFrame, path: str) -> bool:
    """Write feature lines; nothing is written when no row has a geometry."""
    features = geojson_features(results)
    if features.isEmpty():
        return False
    features.write.text(path)
    return True


def write_rings(results: DataFrame, path: str) -> None:
    results.dropna(subset=["geometry"]).write.parquet(path)


def save(results: DataFrame, folder: str) -> None:
    """Both sinks under one new folder."""
    write_csv(results, f"{folder}/poi_csv")
    write_features(results, f"{folder}/aoi_geojson")
