"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Shuffle files go at the end of an execution instead of when the driver collects its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str | None = None, app: str = "placehull", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="placehull-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/placehull/{uuid.uuid4().hex}/{name}"


def write_parquet(df: DataFrame, path: str, rows_per_file: int = 0, mode: str = "errorifexists", **options) -> None:
    """Write ``df`` with zstd. The shuffle files of the job are freed once the table stands, since nothing reads them again."""
    spark = df.sparkSession
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).options(**options).parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def stage(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` once as a parquet table in the scratch folder and return the reader.

    Used where several later jobs read the same costly rows: the table cuts the lineage,
    survives lost executors and lets each reader prune to the columns it needs. ``rows_per_file`` bounds the
    files of a table whose rows become many, since readers put files together by their size (0: no bound).
    The shuffle files of the job are freed as well (``write_parquet``).
    """
    path = scratch_path(df.sparkSession, name)
    write_parquet(df, path, rows_per_file)
    return df.sparkSession.read.schema(df.schema).parquet(path)
