"""Running throughput: events per time window as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def window_counts(events: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Streaming count per window; state of windows older than the watermark is dropped."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), "n"
    )


def start(counts: DataFrame, folder: str, every: str | None = None) -> StreamingQuery:
    """Write the windows each micro-batch touched; replays overwrite their own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/windows/batch_id={batch_id}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        counts.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**trigger)
        .start()
    )


def latest(updates: DataFrame) -> DataFrame:
    """The newest count of each window, from the rows of all micro-batches."""
    return updates.groupBy("window_start").agg(F.max_by("n", "batch_id").alias("n"))
