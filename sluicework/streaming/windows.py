"""Windowed counts over streams, run to the end of what is there or continuously."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema: str, file_format: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(file_format).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def tumbling_count(df: DataFrame, ts: str, by: list[str], window: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Rows per window and key; the same plan over a table and over a stream."""
    timed = df.withColumn("_ts", F.col(ts).cast("timestamp"))
    if df.isStreaming:
        timed = timed.withWatermark("_ts", lateness)
    return timed.groupBy(F.window("_ts", window), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *by, "n")


def sessions(df: DataFrame, ts: str, by: list[str], gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Rows per session of a key, sessions ending after ``gap`` without a row."""
    timed = df.withColumn("_ts", F.col(ts).cast("timestamp"))
    if df.isStreaming:
        timed = timed.withWatermark("_ts", lateness)
    return timed.groupBy(F.session_window("_ts", gap), *by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("session_start"), *by, "n")


def write_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append", file_format: str = "parquet") -> StreamingQuery:
    """Process everything that has arrived and stop; the next call goes on from there."""
    return df.writeStream.format(file_format).option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def complete_result(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a complete-mode aggregation over what has arrived and read its last result."""

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    df.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
