"""What a run of ``matching.changes`` leaves on shared storage: changes, a ledger of micro-batches, saved pairs.

Every micro-batch writes its change rows to a folder of its own name and then one ledger entry that names the folder. The entry is
the commit: readers go by entries alone, and a batch that is replayed finds its entry and does nothing. An entry carries the run's totals
on: calls, POIs by status, first and last event time. Each is the entry's before plus the sums of this batch's changes, so nothing is
counted anew.

Whenever the number of calls passes a multiple of the interval the POIs that changed since the last save are written as a pair, CSV with WKT and
GeoJSON lines, to a new folder; the same ledger entry names it, so both files of a pair appear at once or not at all. ``close`` saves what is left.
The cost of a trigger is that of its own rows, one entry, and from time to time the rows since the last save.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from placehull.functions.rings import rings_wgs84
from placehull.functions.text import duration_text, remaining_text, speed_text
from placehull.operators.reports import elapsed_seconds, progress_text
from placehull.operators.status import MATCHED, NO_GEOMETRY, NO_UID
from placehull.session import stage
from placehull.sources import sinks
from placehull.streaming.matching import CHANGE_SCHEMA, STATE_STORE

ENTRY_SCHEMA = (
    "batch_id bigint, closing boolean, calls bigint, matched bigint, no_uid bigint, no_geometry bigint, "
    "first_ts timestamp, last_ts timestamp, saves bigint, changes string, saved string"
)
#: A trigger checkpoints its changes instead of whole files of the store, and does not look up each key to count rows.
STORE_SETTINGS = {"changelogCheckpointing.enabled": "true", "trackTotalNumberOfRows": "false"}
RESULT_FIELDS = ("status", "uid", "uid_name", "geometry")


@dataclass(frozen=True)
class Entry:
    """The run's totals after a micro-batch, and the folders it wrote."""

    batch_id: int = -1
    closing: bool = False
    calls: int = 0
    matched: int = 0
    no_uid: int = 0
    no_geometry: int = 0
    first_ts: datetime | None = None
    last_ts: datetime | None = None
    saves: int = 0
    changes: str | None = None
    saved: str | None = None


def read_entries(spark: SparkSession, folder: str) -> DataFrame:
    """All committed entries; an entry that was cut off while written is not seen."""
    return spark.read.schema(ENTRY_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{folder}/ledger")


def last_entry(spark: SparkSession, folder: str) -> Entry:
    rows = read_entries(spark, folder).orderBy(F.desc("batch_id"), F.desc("closing")).limit(1).collect()
    return Entry(**rows[0].asDict()) if rows else Entry()


def _commit(spark: SparkSession, folder: str, entry: Entry) -> None:
    name = f"{entry.batch_id:012d}{'-closing' if entry.closing else ''}"
    row = spark.createDataFrame([tuple(vars(entry).values())], ENTRY_SCHEMA)
    row.coalesce(1).write.mode("overwrite").parquet(f"{folder}/ledger/{name}")


def read_changes(spark: SparkSession, entries: DataFrame) -> DataFrame:
    """Change rows of the entries with their batch_id."""
    named = entries.filter("changes is not null").select("batch_id", "changes").collect()  # an entry per micro-batch
    empty = spark.createDataFrame([], f"{CHANGE_SCHEMA}, batch_id bigint")
    if not named:
        return empty
    rows = spark.read.schema(CHANGE_SCHEMA).parquet(*[r.changes for r in named])
    batch = F.regexp_extract(F.input_file_name(), r"/changes/(\d+)-", 1).cast("long")
    return rows.withColumn("batch_id", batch)


def newest(rows: DataFrame) -> DataFrame:
    """The last change of each POI."""
    order = W.partitionBy("poi_id").orderBy(F.desc("batch_id"), F.desc("expired"))
    return rows.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def results(spark: SparkSession, folder: str) -> DataFrame:
    """How each POI that was heard of stands after the last micro-batch."""
    return newest(read_changes(spark, read_entries(spark, folder)))


def _save(poi: DataFrame, rows: DataFrame, path: str) -> None:
    """The pair for POIs that changed: their table columns, status and best outline."""
    last = stage(newest(rows), "changed")
    rings = rings_wgs84(last.filter("geo is not null").select("poi_id", "geo"), ["poi_id"]).withColumnRenamed("ring", "geometry")
    found = last.select("poi_id", "status", "uid", "uid_name").join(rings, "poi_id", "left")
    table = poi.drop(*RESULT_FIELDS).join(found, "poi_id")
    sinks.save(stage(table, "save"), path)


def start(changes: DataFrame, poi: DataFrame, folder: str, interval: int, every: str | None = None) -> StreamingQuery:
    """Run ``changes``; ``every`` sets the trigger, otherwise the query drains its sources and ends."""
    if interval <= 0:
        raise ValueError("interval must be positive")
    spark = changes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    for name, value in STORE_SETTINGS.items():
        spark.conf.set(f"spark.sql.streaming.stateStore.rocksdb.{name}", value)
    spark.createDataFrame([], ENTRY_SCHEMA).write.mode("append").parquet(f"{folder}/ledger/start")

    def write(batch: DataFrame, batch_id: int) -> None:
        commit_batch(batch, batch_id, poi, folder, interval)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    query = changes.writeStream.foreachBatch(write).outputMode("append")
    return query.option("checkpointLocation", f"{folder}/checkpoint").trigger(**trigger).start()


def commit_batch(batch: DataFrame, batch_id: int, poi: DataFrame, folder: str, interval: int) -> None:
    """Write a micro-batch once: changes, a pair if one is due, then the entry."""
    spark = batch.sparkSession
    before = last_entry(spark, folder)
    if before.batch_id >= batch_id:
        return  # a replay
    path = f"{folder}/changes/{batch_id}-{uuid.uuid4().hex}"
    batch.write.parquet(path)
    rows = spark.read.schema(CHANGE_SCHEMA).parquet(path)

    def turned(status: str):
        now, then = (F.coalesce(F.col(c) == status, F.lit(False)).cast("long") for c in ("status", "old_status"))
        return F.coalesce(F.sum(now - then), F.lit(0))

    sums = rows.agg(
        F.coalesce(F.sum("new_calls"), F.lit(0)).alias("calls"), turned(MATCHED).alias("matched"), turned(NO_UID).alias("no_uid"),
        turned(NO_GEOMETRY).alias("no_geometry"), F.min("ts").alias("first"), F.max("ts").alias("last"),
    ).first()
    counts = {c: getattr(before, c) + sums[c] for c in ("calls", "matched", "no_uid", "no_geometry")}
    first = min(filter(None, (before.first_ts, sums["first"])), default=None)
    last = max(filter(None, (before.last_ts, sums["last"])), default=None)
    entry = replace(before, batch_id=batch_id, closing=False, first_ts=first, last_ts=last, changes=path, saved=None, **counts)
    if entry.calls // interval > before.calls // interval:
        entry = _saved(spark, entry, poi, folder, path)
    _commit(spark, folder, entry)


def _saved(spark: SparkSession, entry: Entry, poi: DataFrame, folder: str, path: str | None) -> Entry:
    entries = read_entries(spark, folder)
    since = entries.filter("saved is not null").agg(F.coalesce(F.max("batch_id"), F.lit(-1))).first()[0]
    due = entries.filter(F.col("batch_id") > since)
    rows = read_changes(spark, due)
    if path is not None:
        rows = rows.unionByName(spark.read.schema(CHANGE_SCHEMA).parquet(path).withColumn("batch_id", F.lit(entry.batch_id)))
    target = f"{folder}/saves/{entry.saves + 1}-{uuid.uuid4().hex}"
    _save(poi, rows, target)
    return replace(entry, saves=entry.saves + 1, saved=target)


def close(spark: SparkSession, poi: DataFrame, folder: str) -> None:
    """Save the POIs that changed since the last pair, if any; call it when no query runs."""
    last = last_entry(spark, folder)
    if last.saved is None and last.batch_id >= 0:
        _commit(spark, folder, _saved(spark, replace(last, closing=True, changes=None), poi, folder, None))


def saved_folders(spark: SparkSession, folder: str) -> list[str]:
    """Folders of the committed pairs, oldest first."""
    rows = read_entries(spark, folder).filter("saved is not null").orderBy("saves").select("saved").collect()
    return [r.saved for r in rows]


def progress(spark: SparkSession, folder: str, total: int, to_do: int) -> DataFrame:
    """A line per save: counts, progress text, average speed and expected rest, over ``total`` POIs of which ``to_do`` were open."""
    rows = read_entries(spark, folder).filter("saved is not null")
    rows = rows.withColumns({"resolved": F.col("matched") + F.col("no_uid") + F.col("no_geometry"), "total": F.lit(total).cast("long")})
    seconds = elapsed_seconds(F.col("first_ts"), F.col("last_ts"))
    return rows.select(
        "saves", "batch_id", "calls", "matched", "no_uid", "no_geometry", "resolved", progress_text().alias("progress"),
        speed_text(F.col("resolved"), seconds).alias("speed"), remaining_text(F.col("resolved"), F.lit(to_do), seconds).alias("remaining"),
        duration_text(seconds).alias("elapsed"),
    )
