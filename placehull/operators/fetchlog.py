"""Analytics over a log of fetch attempts (request_id, event_id, ts, http_status)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placehull.functions.rings import ring_part
from placehull.operators.ordered import HOT_ROWS, row_numbers

# fixed values
RETRYABLE = (500, 502, 503, 504, 522, 524, 408, 403, 400, 302, 301)
MAX_RETRIES = 3


def retryable(status: Column) -> Column:
    return status.isin(*RETRYABLE)


def attempts(log: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each log row with its attempt number inside the request and the retryable flag."""
    order = [F.col("ts"), F.col("event_id")]
    return row_numbers(log, ["request_id"], {"attempt": order}, hot_rows).withColumn(
        "retryable", retryable(F.col("http_status"))
    )


def gave_up(log: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Failures per request; more of them than allowed retries means it gave up."""
    return log.groupBy("request_id").agg(
        F.count_if(retryable(F.col("http_status"))).alias("failures")
    ).withColumn("gave_up", F.col("failures") > max_retries)


def gave_up_requests(
    manifest: DataFrame, log: DataFrame, window: Column, max_retries: int = MAX_RETRIES
) -> DataFrame:
    """Requests of a manifest that failed more often than retries are allowed: its poi_id and uid, and ``failures``.

    ``manifest`` has request_id and issued_ts; the attempts of a request are the log rows of its id from issued_ts until
    ``window`` (an interval) later, so an id may be issued again. Only failed attempts are joined, by id and
    interval; sums are combined before they are shuffled by the request, so an id with very many attempts is split by
    the join's skew handling.
    """
    failed = log.where(retryable(F.col("http_status"))).select(F.col("request_id").alias("__id"), F.col("ts").alias("__ts"))
    mine = (F.col("__id") == F.col("request_id")) & (F.col("__ts") >= F.col("issued_ts")) & (F.col("__ts") < F.col("issued_ts") + window)
    rows = manifest.select(F.struct("poi_id", "uid").alias("request"), "request_id", "issued_ts").join(failed, mine)
    counts = rows.groupBy("request").agg(F.count("*").alias("failures"))
    return counts.where(F.col("failures") > max_retries).select("request.poi_id", "request.uid", "failures")


def first_good(log: DataFrame) -> DataFrame:
    """The earliest response of each request that needs no retry."""
    good = log.where(~retryable(F.col("http_status")))
    first = F.min(F.struct("ts", "event_id", "http_status")).alias("g")
    return good.groupBy("request_id").agg(first).select(
        "request_id",
        F.col("g.event_id").alias("event_id"),
        F.col("g.ts").alias("ts"),
        F.col("g.http_status").alias("http_status"),
    )


def retry_reasons(log: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Failures by reason, with the total of all and the number of requests that gave up.

    Counts are merged per reason before anything is moved; the two figures without a reason
    are added as rows of their own.
    """
    failed = log.where(retryable(F.col("http_status")))
    by_reason = failed.groupBy(F.col("http_status").cast("string").alias("reason")).agg(
        F.count("*").alias("n")
    )
    total = by_reason.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(
        F.lit("total").alias("reason"), "n"
    )
    reached = gave_up(log, max_retries).agg(F.count_if("gave_up").alias("n")).select(
        F.lit("max_reached").alias("reason"), "n"
    )
    return by_reason.unionByName(total).unionByName(reached)


def parse_failures(decoded_search: DataFrame, attached: DataFrame) -> DataFrame:
    """POI-level (search not usable) and AOI-level (outline not readable) failures.

    ``attached`` are candidates with their boundary and ring numbers; a response without any
    outline is no failure, it only yields no area.
    """
    poi_level = decoded_search.where(F.col("status_class") != "ok").select(
        "poi_id", F.lit(None).cast("string").alias("uid"), F.lit("search").alias("level"),
        F.col("status_class").alias("reason"),
    )
    bad = F.col("called") & F.col("geo").isNotNull() & F.col("numbers").isNull()
    why = F.when(ring_part(F.col("geo")).isNull(), "no ring part").otherwise("bad coordinates")
    aoi_level = attached.where(bad).select(
        "poi_id", "uid", F.lit("boundary").alias("level"), why.alias("reason")
    )
    return poi_level.unionByName(aoi_level)
