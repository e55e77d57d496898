"""Structured Streaming forms of append-only inputs: journal counts and session clusters."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.session import scratch_dir


def journal(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet") -> DataFrame:
    """A folder of files as a stream of rows, with event time as a timestamp."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(stream: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts per event type and window, late rows within the watermark included."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def session_clusters(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Clusters of a user's events that are no more than a gap apart."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there; each batch's result is written by the executors as Parquet, and the last one returned."""
    folder, done = f"{scratch_dir(stream.sparkSession)}/{name}-{uuid4().hex}", []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{number}")
        done.append(number)

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not done:
        return stream.sparkSession.createDataFrame([], stream.schema)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/{done[-1]}")
