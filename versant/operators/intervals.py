"""Joins of time intervals: overlap, containment, nearest, as-of.

Every join has the recording as an equi-key.  Where one recording may hold very
many rows, time buckets are a second key: each side is assigned to the buckets
it touches, so the join stays an equi-join of many small groups rather than a
nested loop over one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _buckets(a: Column, b: Column, width: float) -> Column:
    low, high = F.floor(a / width), F.floor(b / width)
    return F.explode(F.sequence(low, F.greatest(low, high)))


def overlap_join(left: DataFrame, right: DataFrame, key: str, left_span: tuple[str, str], right_span: tuple[str, str], slack: float = 0.0, width: float = 60.0, how: str = "inner") -> DataFrame:
    """Rows of one key whose spans overlap strictly once ``slack`` widens the left one.

    A pair that shares several buckets is kept in the first of them.  ``how`` is inner or left_semi,
    which gives a row of ``left`` once, however many rows overlap it; repeated rows stay repeated.
    """
    (ls, le), (rs, re) = left_span, right_span
    right = right.withColumnRenamed(key, "_rkey")
    a, b = F.col(ls) - slack, F.col(le) + slack
    if how == "left_semi":
        return _once(overlap_join(_counted(left), right.withColumnRenamed("_rkey", key), key, left_span, right_span, slack, width), left.columns)
    dealt_l = left.withColumn("_bucket", _buckets(a, b, width))
    dealt_r = right.withColumn("_rbucket", _buckets(F.col(rs), F.col(re), width))
    first = F.col("_bucket") == F.greatest(F.floor(a / width), F.floor(F.col(rs) / width))
    same = (F.col(key) == F.col("_rkey")) & (F.col("_bucket") == F.col("_rbucket")) & (F.col(rs) < b) & (F.col(re) > a) & first
    return dealt_l.join(dealt_r, same).drop("_bucket", "_rbucket", "_rkey")


def _counted(rows: DataFrame) -> DataFrame:
    """Each different row once, with how often it occurs."""
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("_times"))


def _once(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Counted rows that have a pair, as often as they occur."""
    return pairs.select(*columns, "_times").distinct().withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select(*columns)


def containment_join(outer: DataFrame, inner: DataFrame, key: str, outer_span: tuple[str, str], inner_span: tuple[str, str], buffer: float = 0.0, width: float = 60.0) -> DataFrame:
    """Rows of ``inner`` that lie wholly within a span of ``outer`` widened by ``buffer``."""
    (os, oe), (is_, ie) = outer_span, inner_span
    a, b = F.col(os) - buffer, F.col(oe) + buffer
    dealt = outer.withColumn("_bucket", _buckets(a, b, width))
    inner = inner.withColumnRenamed(key, "_rkey").withColumn("_rbucket", F.floor(F.col(is_) / width))
    same = (F.col(key) == F.col("_rkey")) & (F.col("_bucket") == F.col("_rbucket")) & (F.col(is_) >= a) & (F.col(ie) <= b)
    return dealt.join(inner, same).drop("_bucket", "_rbucket", "_rkey")


def contiguous_slice(rows: DataFrame, keys: list[str], idx: str, lowest: Column, highest: Column, inside: Column) -> DataFrame:
    """All rows between the first and the last that hold ``inside``."""
    w = Window.partitionBy(*keys)
    return rows.withColumn("_lo", F.min(F.when(inside, F.col(idx))).over(w)).withColumn("_hi", F.max(F.when(inside, F.col(idx))).over(w)).filter(F.col(idx).between(F.col("_lo"), F.col("_hi")) & F.col(idx).between(lowest, highest)).drop("_lo", "_hi")


def clipped_silences(spans: DataFrame, silences: DataFrame, key: str, span: tuple[str, str], silence: tuple[str, str], least: float = 0.2) -> DataFrame:
    """The parts of silences inside spans, ``least`` seconds or more: clip_start, clip_end."""
    joined = overlap_join(spans, silences, key, span, silence)
    clipped = joined.withColumn("clip_start", F.greatest(span[0], silence[0])).withColumn("clip_end", F.least(span[1], silence[1]))
    return clipped.filter(F.col("clip_end") - F.col("clip_start") >= least)


def nearest(points: DataFrame, events: DataFrame, key: str, point_id: str, point: str, event: str, event_order: str, tolerance: float, width: float | None = None) -> DataFrame:
    """Each point with the nearest event of its key within ``tolerance``; the first of equally near ones."""
    width = width or max(4 * tolerance, 1e-3)
    p = points.withColumn("_bucket", _buckets(F.col(point) - tolerance, F.col(point) + tolerance, width))
    e = events.withColumnRenamed(key, "_rkey").withColumn("_rbucket", F.floor(F.col(event) / width))
    distance = F.abs(F.col(point) - F.col(event))
    joined = p.join(e, (F.col(key) == F.col("_rkey")) & (F.col("_bucket") == F.col("_rbucket")) & (distance <= tolerance))
    w = Window.partitionBy(key, point_id).orderBy(distance, event_order)
    ranked = joined.withColumn("distance", distance).withColumn("_rank", F.row_number().over(w))
    return ranked.filter("_rank = 1").drop("_rank", "_bucket", "_rbucket", "_rkey")


def as_of(points: DataFrame, events: DataFrame, key: str, point: str, event: str, value: str, forward: bool = False) -> DataFrame:
    """Each point with ``value`` of its key's last event at or before it, or first at or after it.

    One union and one window: events and points are sorted together once, and no pair is formed.
    """
    p = points.withColumn("_t", F.col(point)).withColumn("_kind", F.lit(0 if forward else 1)).withColumn("_value", F.lit(None).cast(events.schema[value].dataType))
    e = events.select(key, F.col(event).alias("_t"), F.lit(1 if forward else 0).alias("_kind"), F.col(value).alias("_value"))
    both = p.unionByName(e, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_t", "_kind")
    frame = w.rowsBetween(0, Window.unboundedFollowing) if forward else w.rowsBetween(Window.unboundedPreceding, 0)
    pick = F.first if forward else F.last
    return both.withColumn("as_of", pick("_value", ignorenulls=True).over(frame)).filter(F.col("_kind") == (0 if forward else 1)).drop("_t", "_kind", "_value")


def silence_beside(rows: DataFrame, silences: DataFrame, key: str, start: str, end: str, silence: tuple[str, str]) -> DataFrame:
    """quiet_from: where the last silence that ends by the row's start begins; quiet_to: where the first
    silence that begins from its end on ends."""
    back = as_of(rows, silences, key, start, silence[1], silence[0]).withColumnRenamed("as_of", "quiet_from")
    return as_of(back, silences, key, end, silence[0], silence[1], forward=True).withColumnRenamed("as_of", "quiet_to")


def near_start(rows: DataFrame, events: DataFrame, key: str, row_id: str, at: str, event: str, tolerance: float = 0.3) -> DataFrame:
    """Rows that have an event of their key strictly within ``tolerance`` of a time; repeated rows stay repeated."""
    width = max(4 * tolerance, 1e-3)
    p = _counted(rows).withColumn("_bucket", _buckets(F.col(at) - tolerance, F.col(at) + tolerance, width))
    e = events.select(F.col(key).alias("_rkey"), F.col(event).alias("_event")).withColumn("_rbucket", F.floor(F.col("_event") / width))
    same = (F.col(key) == F.col("_rkey")) & (F.col("_bucket") == F.col("_rbucket")) & (F.abs(F.col(at) - F.col("_event")) < tolerance)
    return _once(p.join(e, same, "left_semi"), rows.columns)


def first_gap_within(pairs: DataFrame, silences: DataFrame, key: str, pair_id: str, a: str, b: str, silence: tuple[str, str], least: float = 0.18, width: float = 60.0) -> DataFrame:
    """The first silence of ``least`` seconds or more that lies wholly between two times."""
    joined = containment_join(pairs, silences.filter(F.col(silence[1]) - F.col(silence[0]) >= least), key, (a, b), silence, width=width)
    w = Window.partitionBy(key, pair_id).orderBy(silence[0], silence[1])
    return joined.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")
