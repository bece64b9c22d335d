"""Streams: files arriving over time, framed or gathered into sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, folder: str, schema, format: str = "json", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(format).load(folder)


def session_counts(events: DataFrame, key: str, ts: str, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """Sessions of each key, given out once the watermark has passed their end; state is one row a session."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    found = timed.groupBy(key, F.session_window("_ts", gap).alias("_w")).agg(F.count("*").alias("n_events"))
    return found.select(key, F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), "n_events")


def frame_energy(samples: DataFrame, key: str, ts: str, value: str, frame: str = "50 milliseconds", hop: str = "25 milliseconds", late: str = "1 second") -> DataFrame:
    """Root mean square of sliding frames of a stream."""
    timed = samples.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    found = timed.groupBy(key, F.window("_ts", frame, hop).alias("_w")).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))
    return found.select(key, F.col("_w.start").alias("frame_start"), "rms")


def write_available(stream: DataFrame, path: str, checkpoint: str):
    """Processes what has arrived, then stops."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
