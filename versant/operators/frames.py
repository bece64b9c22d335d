"""Frames of a signal: root mean squares, silence runs, speech chunks, minima."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import db_to_amplitude


def energy_envelope(samples: DataFrame, key: str, ts: str, value: str, frame: str = "50 milliseconds", hop: str = "25 milliseconds") -> DataFrame:
    """Root mean square of sliding windows: key, frame_start, rms."""
    framed = samples.groupBy(key, F.window(ts, frame, hop).alias("_w")).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))
    return framed.select(key, F.col("_w.start").alias("frame_start"), "rms")


def normalized_energy(frames: DataFrame, key: str, rms: str) -> DataFrame:
    """rms over its key's maximum, or over 1 where that is 0."""
    most = F.max(rms).over(Window.partitionBy(key))
    return frames.withColumn("level", F.col(rms) / F.when(most > 0, most).otherwise(1.0))


def silence_runs(frames: DataFrame, key: str, t: str, rms: str, threshold_db: float = -30.0, least: float = 0.3) -> DataFrame:
    """Runs of quiet frames of at least ``least``: silence_start and silence_end, which is the time of the
    first frame that isn't quiet, or of the last frame."""
    w = Window.partitionBy(key).orderBy(t)
    quiet = F.col("level") < db_to_amplitude(F.lit(threshold_db))
    marked = normalized_energy(frames, key, rms).withColumn("_quiet", quiet).withColumn("_next", F.coalesce(F.lead(t).over(w), F.col(t))).withColumn("_rn", F.row_number().over(w))
    runs = marked.filter("_quiet").withColumn("_island", F.col("_rn") - F.row_number().over(w))
    found = runs.groupBy(key, "_island").agg(F.min(t).alias("silence_start"), F.max("_next").alias("silence_end"))
    return found.filter(F.col("silence_end") - F.col("silence_start") >= least).drop("_island")


def speech_chunks(frames: DataFrame, key: str, t: str, rms: str, total: Column, threshold_db: float = -30.0, merge_gap: float = 0.3) -> DataFrame:
    """Runs of frames that aren't quiet, joined over gaps under ``merge_gap``; all of the time if there are none."""
    w = Window.partitionBy(key).orderBy(t)
    quiet = F.col("level") < db_to_amplitude(F.lit(threshold_db))
    marked = normalized_energy(frames, key, rms).withColumn("_quiet", quiet).withColumn("_total", total).withColumn("_next", F.coalesce(F.lead(t).over(w), F.col("_total"))).withColumn("_rn", F.row_number().over(w))
    runs = marked.filter("not _quiet").withColumn("_island", F.col("_rn") - F.row_number().over(w))
    found = runs.groupBy(key, "_island").agg(F.min(t).alias("_s"), F.max("_next").alias("_e"))
    by_start = Window.partitionBy(key).orderBy("_s")
    opened = found.withColumn("_open", F.coalesce((F.col("_s") - F.lag("_e").over(by_start) >= merge_gap).cast("int"), F.lit(1))).withColumn("_chunk", F.sum("_open").over(by_start))
    chunks = opened.groupBy(key, "_chunk").agg(F.min("_s").alias("chunk_start"), F.max("_e").alias("chunk_end")).drop("_chunk")
    whole = marked.groupBy(key).agg(F.max("_total").alias("_total"), F.bool_and("_quiet").alias("_silent")).filter("_silent")
    return chunks.unionByName(whole.select(key, F.lit(0.0).alias("chunk_start"), F.col("_total").cast("double").alias("chunk_end")))


def breath_intervals(silences: DataFrame, start_ms: str, end_ms: str) -> DataFrame:
    """Silences in seconds with their duration, marked as breath boundaries."""
    s, e = F.col(start_ms) / 1000.0, F.col(end_ms) / 1000.0
    return silences.select("*", s.alias("start_sec"), e.alias("end_sec"), (e - s).alias("duration_sec"), F.lit(True).alias("is_breath_boundary")).drop(start_ms, end_ms)


def lowest_frames(frames: DataFrame, key: str, t: str, rms: str, n: int = 3, first: float | None = None, last: float | None = None) -> DataFrame:
    """The n frames of least energy for each key, earlier ones first among equals; only those from
    ``first`` to ``last``, both included, where given."""
    w = Window.partitionBy(key).orderBy(rms, t)
    for bound, inside in ((first, F.col(t) >= F.lit(first)), (last, F.col(t) <= F.lit(last))):
        frames = frames if bound is None else frames.filter(inside)
    return frames.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Sessions of events: a new one begins ``gap`` or more after the one before."""
    found = events.groupBy(key, F.session_window(F.col(ts).cast("timestamp"), gap).alias("_w")).agg(F.count("*").alias("n_events"), F.min(ts).alias("session_start"), F.max(ts).alias("session_end"))
    return found.drop("_w")
