"""Runs of neighbouring rows: gaps and islands, zones, anchors, medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import adaptive_threshold


def islands(rows: DataFrame, key: str, order: str, flag: Column) -> DataFrame:
    """The rows where ``flag`` holds, with ``idx`` (0-based place in the key) and ``island`` (alike within a run)."""
    w = Window.partitionBy(key).orderBy(order)
    numbered = rows.withColumn("idx", F.row_number().over(w) - 1).withColumn("_flag", F.coalesce(flag, F.lit(False)))
    flagged = numbered.filter("_flag")
    return flagged.withColumn("island", F.col("idx") - F.row_number().over(w)).drop("_flag")


def low_runs(rows: DataFrame, key: str, order: str, score: str, threshold: float = 0.7, least: int = 2) -> DataFrame:
    """key, start_idx, end_idx (exclusive) of the longest runs of scores under the threshold."""
    found = islands(rows, key, order, F.col(score) < threshold).groupBy(key, "island").agg(F.min("idx").alias("start_idx"), (F.max("idx") + 1).alias("end_idx"))
    return found.filter(F.col("end_idx") - F.col("start_idx") >= least).drop("island")


def _zones(found: DataFrame, key: str, order: str, score: str, start: str, end: str, least: int) -> DataFrame:
    zones = found.groupBy(key, "island").agg(
        F.min("idx").alias("start_idx"), (F.max("idx") + 1).alias("end_idx"), F.min(order).alias("start_unit"), F.max(order).alias("end_unit"),
        F.avg(score).alias("avg_score"), F.min_by(start, "idx").alias("start_time"), F.max_by(end, "idx").alias("end_time"),
    )
    return zones.filter(F.col("end_idx") - F.col("start_idx") >= least).drop("island")


def problem_zones(rows: DataFrame, key: str, order: str, score: str, start: str, end: str, n_words: str | None = None, least: int = 3, threshold: float = 0.85) -> DataFrame:
    """Runs of scores under the threshold, or under each unit's own one if ``n_words`` is given."""
    bar = adaptive_threshold(n_words, threshold) if n_words else F.lit(threshold)
    return _zones(islands(rows, key, order, F.col(score) < bar), key, order, score, start, end, least)


def upper_median(values: Column) -> Column:
    """Aggregate: the upper of the two middle values of an even number; null without values."""
    kept = F.sort_array(F.collect_list(values))
    return F.get(kept, F.floor(F.size(kept) / 2).cast("int"))


def with_pace(rows: DataFrame, key: str, start: str, end: str, n_words: str) -> DataFrame:
    """pace (seconds a word) and median_pace, the upper median of the key's positive paces."""
    paced = rows.withColumn("pace", (F.col(end) - F.col(start)) / F.greatest(F.col(n_words), F.lit(1)))
    medians = paced.filter("pace > 0").groupBy(F.col(key).alias("_key")).agg(upper_median(F.col("pace")).alias("median_pace"))
    return paced.join(medians, F.col(key) == F.col("_key"), "left").drop("_key")


def _off_pace(ratio: float) -> Column:
    p, m = F.col("pace"), F.col("median_pace")
    return F.when(p > 0, F.greatest(p / m, m / p) > ratio)


def drift_zones(rows: DataFrame, key: str, order: str, score: str, start: str, end: str, n_words: str, least: int = 5, ratio: float = 2.5) -> DataFrame:
    """Runs of units whose pace is not positive or is off the median by more than ``ratio`` either way."""
    paced = with_pace(rows, key, start, end, n_words)
    flag = F.col("median_pace").isNotNull() & ((F.col("pace") <= 0) | _off_pace(ratio))
    return _zones(islands(paced, key, order, flag), key, order, score, start, end, least)


def combined_runs(rows: DataFrame, key: str, order: str, score: str, start: str, end: str, n_words: str, threshold: float = 0.75, least: int = 2, ratio: float = 2.5) -> DataFrame:
    """Runs of low scores or paces off the median; here a pace that isn't positive is no reason."""
    paced = with_pace(rows, key, start, end, n_words)
    flag = (F.col(score) < threshold) | F.coalesce(_off_pace(ratio), F.lit(False))
    found = islands(paced, key, order, flag).groupBy(key, "island").agg(F.min("idx").alias("start_idx"), (F.max("idx") + 1).alias("end_idx"))
    return found.filter(F.col("end_idx") - F.col("start_idx") >= least).drop("island")


def anchors(rows: DataFrame, key: str, order: str, score: str, start: str, end: str, n_words: str, bar: float = 0.95, slowest: float = 0.8, fastest: float = 2.0, with_neighbours: bool = True) -> DataFrame:
    """Rows to be trusted: high score, plausible words a second, and neighbours that fit."""
    w = Window.partitionBy(key).orderBy(order)
    length = F.col(end) - F.col(start)
    rate = F.when(length > 0, F.col(n_words) / length)
    marked = rows.withColumn("idx", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    for name, column in (("_ps", F.lag(score)), ("_pe", F.lag(end)), ("_ns", F.lead(score)), ("_nb", F.lead(start))):
        marked = marked.withColumn(name, column.over(w))
    sound = (F.col(score) >= bar) & rate.between(slowest, fastest)
    if with_neighbours:
        before = F.col("_ps").isNull() | ((F.col("_ps") >= 0.5) & (F.col("_pe") <= F.col(start) + 1.0))
        after = F.col("_ns").isNull() | ((F.col("_ns") >= 0.5) & (F.col("_nb") >= F.col(end) - 1.0))
        sound = sound & ((F.col("_n") <= 2) | (before & after))
    return marked.filter(sound).drop("_n", "_ps", "_pe", "_ns", "_nb")


def anchor_gaps(found: DataFrame, sizes: DataFrame, key: str, least: int = 3) -> DataFrame:
    """Runs [gap_start, gap_end) of rows between anchors and after the last, for keys of two anchors or more.
    ``found`` has idx, ``sizes`` the key and its number of rows n."""
    w = Window.partitionBy(key).orderBy("idx")
    near = found.select(key, "idx").withColumn("next_idx", F.lead("idx").over(w)).withColumn("_anchors", F.count("*").over(Window.partitionBy(key)))
    joined = near.filter("_anchors >= 2").join(sizes.select(F.col(key).alias("_key"), "n"), F.col(key) == F.col("_key"))
    gaps = joined.select(key, (F.col("idx") + 1).alias("gap_start"), F.coalesce("next_idx", "n").alias("gap_end"))
    return gaps.filter(F.col("gap_end") - F.col("gap_start") >= least)


def nearest_trusted(rows: DataFrame, key: str, order: str, score: str, start: str, end: str, bar: float = 0.7) -> DataFrame:
    """For each row the end of the last trusted row before it and the start of the first one after."""
    w = Window.partitionBy(key).orderBy(order)
    good = (F.col(end) > F.col(start)) & (F.col(score) >= bar)
    before = F.last(F.when(good, F.col(end)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(F.when(good, F.col(start)), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("trusted_end", before).withColumn("trusted_start", after)
