"""The POI table: CSV scan, column checks, widening, one coordinate system."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placehull.functions.coords import convert
from placehull.functions.rings import wkt_to_ring
from placehull.options import VAR, MatchOptions
from placehull.session import stage

PointTransform = Callable[[Column, Column], tuple[Column, Column]]
POI_FIELDS = {
    "poi_id": "bigint", "name": "string", "lng": "double", "lat": "double",
    "prim_ind": "string", "sec_ind": "string", "status": "string", "uid_name": "string",
    "lng_wgs84": "double", "lat_wgs84": "double", "geometry": "string",
}
REQUIRED = ("name", "lng", "lat")
RING_TYPE = "array<struct<lng:double,lat:double>>"
RESULT_COLUMNS = {
    "status": "string", "uid_name": "string", "lng_wgs84": "double", "lat_wgs84": "double",
    "geometry": RING_TYPE,
}


def read_poi_csv(spark: SparkSession, path: str, header: list[str] | None = None) -> DataFrame:
    """Scan a UTF-8 CSV with a header line; known columns get their declared types.

    ``header`` spares the one-line look at the file. Files without ``poi_id`` get one by ``with_row_ids``.
    """
    options = dict(header=True, quote='"', escape='"', encoding="UTF-8", enforceSchema=False)
    if header is None:
        header = spark.read.options(**options).csv(path).columns
    schema = T.StructType([T.StructField(c, T.DataType.fromDDL(POI_FIELDS.get(c, "string"))) for c in header])
    df = spark.read.schema(schema).options(**options).csv(path)
    return df if "poi_id" in header else with_row_ids(df)


def with_row_ids(df: DataFrame, name: str = "poi_id") -> DataFrame:
    """Number the rows of a file scan 0, 1, 2, ... by file and place in it.

    The ids depend on the files alone, not on how the scan splits them: rows of a split come in file order, so a row's
    id is the number of rows in the splits before its own plus its place in it. Rows are written once; what is
    numbered over the whole table is one row per split.
    """
    split = (F.col("__file"), F.col("__start"))
    rows = df.select(
        "*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__at"),
    )
    rows = stage(rows, "rows")
    splits = rows.groupBy(*split).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select(*split, "__first", F.coalesce(before, F.lit(0)).alias("__before"))
    numbered = rows.join(splits, ["__file", "__start"])
    numbered = numbered.withColumn(name, F.col("__before") + F.col("__at") - F.col("__first"))
    return numbered.select(*df.columns, name)


def check_columns(df: DataFrame, options: MatchOptions) -> DataFrame:
    """Raise before any job when a needed column is missing."""
    needed = list(REQUIRED)
    needed += [c for c in ("prim_ind", "sec_ind") if getattr(options, c) == VAR]
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def add_result_columns(df: DataFrame) -> DataFrame:
    """Absent result columns become typed nulls; a saved WKT geometry becomes a ring."""
    if dict(df.dtypes).get("geometry") == "string":
        df = df.withColumn("geometry", wkt_to_ring(F.col("geometry")))
    absent = {c: F.lit(None).cast(t) for c, t in RESULT_COLUMNS.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def unify_crs(df: DataFrame, crs: str, transform: PointTransform | None = None) -> DataFrame:
    """Fill ``lng_wgs84``/``lat_wgs84`` from ``lng``/``lat``, or by a caller's own transform."""
    out = ("lng_wgs84", "lat_wgs84")
    if transform is None:
        return convert(df, crs, "wgs84", "lng", "lat", out)
    return df.withColumns(dict(zip(out, transform(F.col("lng"), F.col("lat")))))


def parameter_or_column(name: str, value: str) -> Column:
    """The same text for all rows, or the row's own column; a null category is blank."""
    return F.coalesce(F.col(name), F.lit("")) if value == VAR else F.lit(value)


def prepare_poi(df: DataFrame, options: MatchOptions) -> DataFrame:
    """Checked, widened and reprojected POI table with its effective categories."""
    df = unify_crs(add_result_columns(check_columns(df, options)), options.crs)
    return df.withColumns(
        {c: parameter_or_column(c, getattr(options, c)) for c in ("prim_ind", "sec_ind")}
    )


def unresolved(df: DataFrame) -> DataFrame:
    return df.where(F.col("status").isNull())


def without_resolved(poi: DataFrame, results: DataFrame) -> DataFrame:
    """POIs that no earlier run has given a status."""
    done = results.where(F.col("status").isNotNull()).select("poi_id")
    return poi.join(done, "poi_id", "left_anti")
