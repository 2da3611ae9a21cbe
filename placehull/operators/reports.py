"""Progress and quality figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placehull.functions.text import duration_text, percent_text, remaining_text, speed_text
from placehull.operators.ordered import HOT_ROWS, running_totals
from placehull.operators.status import MATCHED, NO_GEOMETRY, NO_UID


def histogram(results: DataFrame) -> DataFrame:
    """One row: matched, no_uid, no_geometry, resolved, missing, total."""
    counts = results.agg(
        F.count_if(F.col("status") == MATCHED).alias("matched"),
        F.count_if(F.col("status") == NO_UID).alias("no_uid"),
        F.count_if(F.col("status") == NO_GEOMETRY).alias("no_geometry"),
        F.count("*").alias("total"),
    )
    resolved = F.col("matched") + F.col("no_uid") + F.col("no_geometry")
    return counts.withColumn("resolved", resolved).withColumn(
        "missing", F.col("total") - F.col("resolved")
    )


def progress_text() -> Column:
    """``matched/no uid/no geometry/total | resolved (percent)``."""
    return F.concat(
        F.concat_ws("/", *[F.col(c).cast("string") for c in ("matched", "no_uid", "no_geometry", "total")]),
        F.lit(" | "), F.col("resolved").cast("string"),
        F.lit(" ("), percent_text(F.col("resolved"), F.col("total")), F.lit(")"),
    )


def start_report(results: DataFrame) -> DataFrame:
    return histogram(results).select(
        "total", F.col("missing").alias("to_do"), progress_text().alias("progress")
    )


def finish_report(results: DataFrame) -> DataFrame:
    h = histogram(results)
    share = {
        f"{c}_share": F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("total").cast("double")), F.lit(0.0))
        for c in ("matched", "missing")
    }
    return h.select(
        "matched", "missing", "total",
        *[v.alias(k) for k, v in share.items()],
        percent_text(F.col("matched"), F.col("total")).alias("matched_text"),
        percent_text(F.col("missing"), F.col("total")).alias("missing_text"),
        (F.col("missing") > 0).alias("rerun"),
    )


def elapsed_seconds(first: Column, last: Column) -> Column:
    """Seconds between two timestamps of the same type, exact to the microsecond."""
    return ((last - first).cast("interval second").cast("decimal(18,6)")).cast("double")


def throughput(done: DataFrame, to_do: int | Column, ts: str = "ts") -> DataFrame:
    """Speed, expected rest and total time over the resolved rows' timestamps.

    ``to_do``: how many rows there were to resolve in all.
    """
    span = done.agg(
        F.count("*").alias("resolved"),
        elapsed_seconds(F.min(ts), F.max(ts)).alias("seconds"),
    )
    to_do = F.lit(to_do) if isinstance(to_do, int) else to_do
    seconds = F.coalesce("seconds", F.lit(0.0))
    return span.select(
        "resolved",
        seconds.alias("seconds"),
        speed_text(F.col("resolved"), seconds).alias("speed"),
        remaining_text(F.col("resolved"), to_do, seconds).alias("remaining"),
        duration_text(seconds).alias("total_time"),
    )


def flush_points(calls: DataFrame, order: list[str], interval: int, part_rows: int = HOT_ROWS) -> DataFrame:
    """Arrivals at which the running number of calls is a multiple of the interval."""
    if interval <= 0:
        raise ValueError("interval must be positive")
    rows = running_totals(calls, order, {"calls": F.lit(1).cast("long")}, part_rows)
    return rows.where(F.col("calls") % interval == 0).drop("__bucket")


def progress_changes(events: DataFrame, order: list[str], total: int, part_rows: int = HOT_ROWS) -> DataFrame:
    """Running histogram in arrival order, one row each time it differs from the one before.

    The running counts never fall, so a row differs from its predecessor exactly when its own
    status is one of those counted.
    """
    named = (("matched", MATCHED), ("no_uid", NO_UID), ("no_geometry", NO_GEOMETRY))
    flags = {n: F.when(F.col("status") == s, 1).otherwise(0).cast("long") for n, s in named}
    rows = running_totals(events, order, flags, part_rows)
    rows = rows.where(F.col("status").isin(*[s for _, s in named])).withColumn("total", F.lit(total).cast("long"))
    rows = rows.withColumn("resolved", F.col("matched") + F.col("no_uid") + F.col("no_geometry"))
    return rows.select(
        *order, "matched", "no_uid", "no_geometry", "resolved", progress_text().alias("progress")
    )
