"""Tumbling chunks over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dubflow.sources.shared import new_path


def chunk_counts(events: DataFrame, size: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Events a chunk and type; rows later than the watermark are left out."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def write_updates(counts: DataFrame, path: str, checkpoint: str):
    """A started query that writes each batch's changed rows to a folder of its number: a batch that runs again replaces it."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, path: str, keys: list[str], value: str, schema: str) -> DataFrame:
    """The last state of each key in the folder of updates."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(path)
    return rows.groupBy(*keys).agg(F.max_by(value, "batch").alias(value))


def stream_chunk_counts(spark: SparkSession, path: str) -> DataFrame:
    """Reads the file as a stream to its end; updates go to files, and chunks that are still open at the end are in the result."""
    folder, name = path.rsplit("/", 1)
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    out, checkpoint = new_path(spark, "chunks"), new_path(spark, "chunks-state")
    running = write_updates(chunk_counts(events), out, checkpoint)
    running.awaitTermination()
    return newest(spark, out, ["start", "event_type"], "n", "start timestamp, event_type string, n long")
