"""The engine's inputs as the bundled tables can play them, in DataFrames and in SQL alike.

Numbers are made of binary fractions, so both engines compute them without rounding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as scored, timed rows of a recording (user_id) in order."""
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    v, w = F.floor("value"), F.floor(F.col("value") * 8) % 512
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", order.cast("long").alias("unit_no"), v.alias("v"), w.alias("w"))
    begun = rows.withColumn("start_s", F.col("unit_no") * 3 + F.col("v") / 128.0)
    return begun.select("user_id", "event_id", "unit_no", "start_s", (F.col("start_s") + 1 + F.col("w") / 128.0).alias("end_s"), (F.col("v") / 512.0).alias("score"), (F.col("event_id") % 12 + 1).alias("n_words"))


RESULTS_SQL = """
base AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS unit_no, floor(value)::BIGINT AS v, floor(value * 8)::BIGINT % 512 AS w FROM events),
res AS (SELECT user_id, event_id, unit_no, unit_no * 3 + v / 128.0::DOUBLE AS start_s, unit_no * 3 + v / 128.0::DOUBLE + 1 + w / 128.0::DOUBLE AS end_s, v / 512.0::DOUBLE AS score, event_id % 12 + 1 AS n_words FROM base)"""


def silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third row's middle as a silence of 1/16 to 1/2 s."""
    rows = results(spark, sf_dir).filter("event_id % 3 = 0")
    start = F.col("unit_no") * 3 + 1.5
    return rows.select("user_id", F.col("event_id").alias("silence_id"), start.alias("silence_start"), (start + (F.col("event_id") % 8 + 1) / 16.0).alias("silence_end"))


SILENCES_SQL = RESULTS_SQL + """,
sil AS (SELECT user_id, event_id AS silence_id, unit_no * 3 + 1.5::DOUBLE AS silence_start, unit_no * 3 + 1.5::DOUBLE + (event_id % 8 + 1) / 16.0::DOUBLE AS silence_end FROM res WHERE event_id % 3 = 0)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as energy frames a quarter of a second apart."""
    return results(spark, sf_dir).select("user_id", (F.col("unit_no") / 4.0).alias("t"), (F.col("score") * F.col("score")).alias("rms"))


FRAMES_SQL = RESULTS_SQL + """,
frames AS (SELECT user_id, unit_no / 4.0::DOUBLE AS t, score * score AS rms FROM res)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as segments, timed by their letters."""
    w = Window.partitionBy("recording").orderBy("seg_idx", "text")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("recording"), F.col("turn").cast("int").alias("seg_idx"), "role", "text")
    upto = F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("end_s", upto / 16.0).withColumn("start_s", (upto - F.length("text")) / 16.0)


SEGMENTS_SQL = """
seg AS (SELECT conv_id AS recording, turn::INTEGER AS seg_idx, role, text,
        (sum(length(text)) OVER w)::BIGINT / 16.0::DOUBLE AS end_s, ((sum(length(text)) OVER w) - length(text))::BIGINT / 16.0::DOUBLE AS start_s
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING))"""


def words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '[\\p{{Z}}\\t-\\r\\x1c-\\x20\\x{{85}}]+'), lambda w: w <> '')"


def normalized_sql(text: str) -> str:
    return f"""trim(regexp_replace(regexp_replace(regexp_replace(translate(coalesce({text}, ''), 'أإآٱىةؤئ', 'اااايهوي'), '[\\x{{064B}}-\\x{{065F}}\\x{{0670}}]', '', 'g'), '[^\\p{{L}}\\p{{N}}_\\p{{Z}}\\t-\\r\\x1c-\\x20\\x{{85}}]', '', 'g'), '[\\p{{Z}}\\t-\\r\\x1c-\\x20\\x{{85}}]+', ' ', 'g'))"""
