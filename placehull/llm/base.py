"""What the operators of this package share: tables, words, global row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placehull.session import stage

#: One word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Append ``name``: 0, 1, 2, ... in the given order over the whole table.

    Rows are range-partitioned, numbered inside their partition and written once; the offset of a
    partition is the sum of the counts before it (one number per partition, not per row). Rows
    that are equal in ``order`` land in one partition, so order by keys that are nearly distinct.
    """
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    parts = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("__part"), local.alias("__local"))
    )
    parts = stage(parts, "numbered")
    counts = dict(tuple(r) for r in parts.groupBy("__part").count().collect())
    starts, total = [], 0
    for part in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(part, 0)
    begun = F.get(F.lit(starts).cast("array<long>"), F.col("__part"))  # a number per partition
    return parts.withColumn(name, begun + F.col("__local")).drop("__part", "__local")
