"""The result table of resumed runs: one row per POI, in hash buckets of which an upsert rewrites those it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placehull.session import stage

BUCKETS = 256


def bucket_of(poi_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(poi_id), F.lit(buckets)).cast("int")


def create(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write a new table; the number of buckets stays for its life, a file per bucket."""
    _write(rows.withColumn("bucket", bucket_of(F.col("poi_id"), buckets)), path, "errorifexists")


def _write(rows: DataFrame, path: str, mode: str) -> None:
    dealt = rows.repartition("bucket")
    dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def upsert(changes: DataFrame, path: str, buckets: int = BUCKETS) -> list[int]:
    """Put rows (one per poi_id) in place of the table's rows with their ids; returns the buckets rewritten.

    Only buckets with a changed POI are read and written; the others keep their files. The new buckets are
    staged first, as Spark cannot overwrite what it reads, and the dynamic overwrite puts them in place when its job commits. One
    writer at a time.
    """
    spark = changes.sparkSession
    changes = stage(changes.withColumn("bucket", bucket_of(F.col("poi_id"), buckets)), "changes")
    touched = sorted(r.bucket for r in changes.select("bucket").distinct().collect())  # as many rows as buckets, at most
    if touched:
        old = spark.read.parquet(path).where(F.col("bucket").isin(touched))
        kept = old.join(changes.select("poi_id"), "poi_id", "left_anti")
        _write(stage(kept.unionByName(changes.select(*old.columns)), "merged"), path, "overwrite")
    return touched


def still_open(poi: DataFrame, table: DataFrame) -> DataFrame:
    """POIs that the table gives no status."""
    return poi.join(table.where(F.col("status").isNotNull()).select("poi_id"), "poi_id", "left_anti")
