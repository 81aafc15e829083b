"""Structured Streaming: resumable ingest and running moments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream over a folder of Parquet files, in file order."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Exactly once: every micro-batch owns a partition that a replay overwrites.

    Runs until the source is drained; a restart continues after the last commit.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def streaming_moments(stream: DataFrame, lat: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """channel_idx, mean, std: area-weighted moments of everything the stream has brought.

    Every micro-batch adds its own (weight, mean, centred squares) per channel to the
    table ``out``, in a partition that a replay overwrites; they are merged on
    reading.  Large offsets do not cancel, and no state is held by the driver.
    """
    from isobar.operators.stats import mean_std, merge_moments, row_moments

    by = ["channel_idx"]

    def put(batch: DataFrame, epoch: int) -> None:
        merge_moments(row_moments(batch, lat, by), by).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return mean_std(merge_moments(stream.sparkSession.read.parquet(out).drop("batch"), by), by)


def event_series(events: DataFrame, hours: int, late: str = "1 hour") -> DataFrame:
    """bucket, event_type, n, total of a stream or table of events (tumbling windows)."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    b = F.window(F.col("ts").cast("timestamp"), f"{hours} hours")
    return events.groupBy(b.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("bucket"), "event_type", "n", "total")
