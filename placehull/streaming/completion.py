"""Boundary responses as a stream: measure them as they come, finish a POI when its last one is in.

Two queries, joined by tables on shared storage:

``measure``   responses -> measured areas (table ``aois``, every arrival) and the POIs heard of (table
              ``calls``). Both are written under the batch id and overwritten when a batch is replayed.
``finish``    ``calls`` -> for the POIs heard of, all their measured areas are read back, one per
              (poi_id, uid) is chosen by the rule of the batch job, and where every accepted candidate has
              an answer the POI is ranked and written to ``results``.

The tables are the state: repeats, replays and any order of arrival give the same result, a
better answer that comes late writes a new result, and a POI that stays incomplete stays open.
The cost of a trigger includes a scan of the measured areas (narrow rows, no outlines) and the join of its responses with the
candidates, where the least answer of each is taken as well, so that an outline is moved once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from placehull.operators.candidates import CANDIDATE_FIELDS
from placehull.operators.ordered import HOT_ROWS
from placehull.operators.outlines import aoi_metrics, attach_answers
from placehull.operators.ranking import best_per_poi, score_aois
from placehull.operators.status import MATCHED, NO_GEOMETRY
from placehull.operators.validity import JUDGED_BY, judge_aois
from placehull.options import MatchOptions
from placehull.session import stage, write_parquet
from placehull.sources.responses import decode_boundaries

RESPONSE_SCHEMA = "poi_id bigint, uid string, body string"
CALLS_SCHEMA = "poi_id bigint, accepted bigint, batch_id bigint"


def read_responses(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Stream of captured boundary responses from parquet files."""
    return (
        spark.readStream.schema(RESPONSE_SCHEMA)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def _trigger(every: str | None) -> dict:
    return {"processingTime": every} if every else {"availableNow": True}


def measure(
    responses: DataFrame,
    accepted: DataFrame,
    options: MatchOptions,
    folder: str,
    every: str | None = None,
) -> StreamingQuery:
    """Start the measuring query; ``every`` sets the flush interval, otherwise it drains and ends.

    ``accepted`` are the accepted candidates of the batch job.
    """
    spark = responses.sparkSession
    fields = [f for f in CANDIDATE_FIELDS if f != "p_name" or options.sort_by_similarity]
    candidates = stage(accepted.select("aoi_key", *fields), "accepted")
    totals = stage(
        candidates.groupBy("aoi_key.poi_id").agg(F.count("*").alias("accepted")), "accepted_totals"
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        attached = attach_answers(candidates, decode_boundaries(batch), "inner")
        if "p_name" not in fields:
            attached = attached.withColumn("p_name", F.lit(None).cast("string"))
        rows = judge_aois(aoi_metrics(attached, options, keep=("pick",)), options).drop(*JUDGED_BY)
        aois = f"{folder}/aois/batch_id={batch_id}"
        write_parquet(rows, aois, mode="overwrite")
        seen = batch.sparkSession.read.schema(rows.schema).parquet(aois)
        calls = seen.select("poi_id").distinct()
        write_parquet(calls.join(totals, "poi_id"), f"{folder}/calls/batch_id={batch_id}", mode="overwrite")

    for name in ("aois", "calls"):  # so that the second query finds its source
        _ensure_folder(spark, f"{folder}/{name}")
    return (
        responses.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{folder}/checkpoint_measure")
        .trigger(**_trigger(every))
        .start()
    )


def _ensure_folder(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(jvm_path)


def chosen(aois: DataFrame) -> DataFrame:
    """One measured area per (poi_id, uid): that of the response which counts in the batch job."""
    fields = [c for c in aois.columns if c not in ("poi_id", "uid", "pick", "batch_id")]
    least = F.min(F.struct("pick", "batch_id", *fields)).alias("a")
    return aois.groupBy("poi_id", "uid").agg(least).select("poi_id", "uid", *[F.col(f"a.{c}").alias(c) for c in fields])


def finish(
    spark: SparkSession,
    options: MatchOptions,
    folder: str,
    every: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> StreamingQuery:
    """Start the finishing query over the tables that ``measure`` writes."""

    def write(batch: DataFrame, batch_id: int) -> None:
        heard = stage(batch.groupBy("poi_id").agg(F.max("accepted").alias("accepted")), "heard")
        if heard.isEmpty():
            return
        log = batch.sparkSession.read.parquet(f"{folder}/aois")
        aois = stage(chosen(log.join(heard.select("poi_id"), "poi_id", "left_semi")), "heard_aois")
        called = aois.groupBy("poi_id").agg(F.count("*").alias("called"))
        complete = called.join(heard, "poi_id").where("called >= accepted").select("poi_id")
        complete = stage(aois.join(complete, "poi_id", "left_semi"), "complete_aois")
        write_parquet(results(complete, options, hot_rows), f"{folder}/results/batch_id={batch_id}", mode="overwrite")

    return (
        spark.readStream.schema(CALLS_SCHEMA).parquet(f"{folder}/calls")
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{folder}/checkpoint_finish")
        .trigger(**_trigger(every))
        .start()
    )


def results(aois: DataFrame, options: MatchOptions, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Status and best area of complete POIs (``aois``: all their measured candidates)."""
    counts = aois.groupBy("poi_id").agg(F.count_if("valid").alias("valid"))
    best = best_per_poi(score_aois(aois.where("valid"), options, hot_rows), "uid_name")
    status = F.when(F.col("valid") > 0, MATCHED).otherwise(NO_GEOMETRY)
    return counts.join(best, "poi_id", "left").select(
        "poi_id", status.alias("status"), "uid", "uid_name", "search_rank", "score"
    )


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """One result per POI: repeats and replays may finish a POI again, and its newest result counts."""
    rows = spark.read.parquet(f"{folder}/results")
    newest = rows.groupBy("poi_id").agg(F.max("batch_id").alias("batch_id"))
    return rows.join(newest, ["poi_id", "batch_id"]).drop("batch_id")


def still_open(accepted: DataFrame, finished: DataFrame) -> DataFrame:
    """Candidates of the POIs that no result has closed yet, for the next run."""
    return accepted.join(finished.select("poi_id"), "poi_id", "left_anti")
