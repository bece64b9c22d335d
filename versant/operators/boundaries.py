"""Repair and placement of time boundaries between neighbouring rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fix_overlaps(rows: DataFrame, key: str, order: str, start: str = "start_s", end: str = "end_s", min_gap: float = 0.0) -> DataFrame:
    """Splits what a gap lacks of ``min_gap`` evenly between its two sides; a side never passes its own other end.

    New starts depend on given values only, new ends on given values and the row's own new start, so
    two window steps do what a pass from left to right would.
    """
    w = Window.partitionBy(key).orderBy(order)
    s, e = F.col(start), F.col(end)
    lack = F.lit(min_gap) - (s - F.lag(end).over(w))
    moved = s + lack / 2
    begun = rows.withColumn("_start", F.when(lack > 0, F.round(F.when(moved > e, e - 0.1).otherwise(moved), 2)).otherwise(s))
    after = F.lit(min_gap) - (F.lead(start).over(w) - e)
    shrunk = e - after / 2
    closed = begun.withColumn("_end", F.when(after > 0, F.round(F.when(shrunk < F.col("_start"), F.col("_start") + 0.1).otherwise(shrunk), 2)).otherwise(e))
    return closed.withColumn("repaired", F.coalesce(lack > 0, F.lit(False))).withColumn(start, F.col("_start")).withColumn(end, F.col("_end")).drop("_start", "_end")


def _shares(gap: Column) -> tuple[Column, Column]:
    """How much of a gap goes before the later row and how much after the earlier one."""
    before = F.when(gap <= 0.3, F.least(gap, F.lit(0.1))).when(gap >= 0.4, F.lit(0.2)).otherwise(gap / 2.0)
    after = F.when(gap <= 0.3, gap - F.least(gap, F.lit(0.1))).when(gap >= 0.4, gap - 0.2).otherwise(gap / 2.0)
    return before, after


def apply_buffers(rows: DataFrame, key: str, order: str, start: str = "start_s", end: str = "end_s", silence_before: str | None = None, silence_after: str | None = None, buffer: float = 0.3) -> DataFrame:
    """buffered_start and buffered_end: rows reach into the gaps to their neighbours.

    Where there is no gap, they reach into the silence that ends at the row's start or begins at its
    end, if the columns with that silence's other edge (see ``intervals.silence_beside``) are given.
    """
    w = Window.partitionBy(key).orderBy(order)
    s, e = F.col(start), F.col(end)
    prev, after = F.lag(end).over(w), F.lead(start).over(w)
    quiet_before = s - F.least(F.lit(buffer), s - F.col(silence_before)) if silence_before else F.lit(None).cast("double")
    quiet_after = e + F.least(F.lit(buffer), F.col(silence_after) - e) if silence_after else F.lit(None).cast("double")
    from_quiet = F.when(quiet_before.isNotNull() & (prev.isNull() | (quiet_before >= prev)), quiet_before).otherwise(s)
    to_quiet = F.when(quiet_after.isNotNull() & (after.isNull() | (quiet_after <= after)), quiet_after).otherwise(e)
    new_start = F.when(s > prev, s - _shares(s - prev)[0]).otherwise(from_quiet)
    new_end = F.when(after > e, e + _shares(after - e)[1]).otherwise(to_quiet)
    return rows.withColumn("buffered_start", new_start).withColumn("buffered_end", new_end)


def proportional_times(rows: DataFrame, keys: list[str], order: list[str], weight: str, start: Column, duration: Column) -> DataFrame:
    """Shares of a duration by weight, one after another; equal shares where all weights are 0."""
    w = Window.partitionBy(*keys)
    running = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum(weight).over(w)
    upto = F.when(total > 0, F.sum(weight).over(running) / total).otherwise(F.count("*").over(running) / F.count("*").over(w))
    before = F.when(total > 0, (F.sum(weight).over(running) - F.col(weight)) / total).otherwise((F.count("*").over(running) - 1) / F.count("*").over(w))
    return rows.withColumn("alloc_start", F.round(start + duration * before, 2)).withColumn("alloc_end", F.round(start + duration * upto, 2))


def word_stream(segments: DataFrame, keys: list[str], text: str, start: str, end: str) -> DataFrame:
    """One row a word: word_idx, word and times by share of letters; words without letters share evenly."""
    from ..functions.text import words

    split = segments.withColumn("_words", words(text)).select("*", F.posexplode("_words").alias("word_idx", "word"))
    split = split.withColumn("_size", F.length("word"))
    timed = proportional_times(split, keys, ["word_idx"], "_size", F.col(start), F.col(end) - F.col(start))
    return timed.drop("_words", "_size").withColumnRenamed("alloc_start", "word_start").withColumnRenamed("alloc_end", "word_end")


def expected_positions(units: DataFrame, key: str, order: str, n_words: str, stream_words: Column) -> DataFrame:
    """expected: where in a stream of words each unit should begin, by the words before it."""
    w = Window.partitionBy(key)
    size = F.greatest(F.col(n_words), F.lit(1))
    before = F.sum(size).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size
    return units.withColumn("expected", before * stream_words / F.sum(size).over(w))


def forward_fill(rows: DataFrame, key: str, order: str, column: str, step: float = 0.0) -> DataFrame:
    """filled: the last value that isn't null, and ``step`` more for each row since then."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = rows.withColumn("_run", F.count(column).over(w))
    since = F.row_number().over(Window.partitionBy(key, "_run").orderBy(order)) - F.when(F.col("_run") > 0, 1).otherwise(0)
    return runs.withColumn("filled", F.last(column, ignorenulls=True).over(w) + since * step).drop("_run")


def silence_bonus(gap: Column, silent: Column) -> Column:
    """A bonus for a boundary in a silence, a malus for one without; tiny gaps are never boundaries."""
    return F.when(gap < 0.05, 0.05).when(silent, -0.15).otherwise(0.05)


#: Words of a key that ``smooth_gaps`` folds at a time.
_PIECE = 64


def smooth_gaps(rows: DataFrame, key: str, order: str, unit: str, start: str, end: str, total: Column) -> DataFrame:
    """Closes gaps between words: at a unit's border as ``apply_buffers`` shares them, inside a unit up to
    0.1 s; words last 0.1 s at least and the last one to ``total``.  Ordered and carried from word to
    word, so it folds over each key's words, in pieces, as each step copies the words done in its piece."""
    w = F.struct(F.col(order).alias("o"), F.col(unit).alias("u"), F.col(start).alias("s"), F.col(end).alias("e"))
    gathered = rows.groupBy(key).agg(F.sort_array(F.collect_list(w)).alias("ws"), F.first(total).alias("total"))

    def step(state: Column, x: Column) -> Column:
        last = state["last"]
        s = F.greatest(x["s"], last["e"])
        gap = s - last["e"]
        before, after = _shares(gap)
        inside = F.greatest(gap - 0.1, F.lit(0.0))
        border = x["u"] != last["u"]
        new_end = F.when(gap <= 0, last["e"]).when(border, last["e"] + after).otherwise(last["e"] + inside)
        new_start = F.when((gap > 0) & border, s - before).otherwise(F.when(gap > 0, new_end).otherwise(s))
        fresh = F.struct(x["o"].alias("o"), x["u"].alias("u"), new_start.alias("s"), F.greatest(x["e"], new_start + 0.1).alias("e"))
        closed = F.struct(last["o"].alias("o"), last["u"].alias("u"), last["s"].alias("s"), new_end.alias("e"))
        return F.struct(state["pieces"].alias("pieces"), F.concat(state["piece"], F.array(closed)).alias("piece"), fresh.alias("last"))

    def piece_done(state: Column) -> Column:
        return F.struct(F.concat(state["pieces"], F.array(state["piece"])).alias("pieces"), none.alias("piece"), state["last"].alias("last"))

    none = F.slice(F.col("ws"), 1, 0)
    pieces = F.when(F.size("ws") > 1, F.transform(F.sequence(F.lit(2), F.size("ws"), F.lit(_PIECE)), lambda i: F.slice(F.col("ws"), i, _PIECE))).otherwise(F.array(none))
    begun = F.struct(F.array(none).alias("pieces"), none.alias("piece"), F.element_at("ws", 1).alias("last"))
    folded = F.aggregate(pieces, begun, lambda state, piece: F.aggregate(piece, state, step, piece_done), lambda state: F.concat(F.flatten(state["pieces"]), F.array(state["last"])))
    out = gathered.select(key, F.col("total"), F.posexplode(folded).alias("i", "w"), F.size("ws").alias("n"))
    last_end = F.when(F.col("i") == F.col("n") - 1, F.greatest(F.col("w.e"), F.col("total"))).otherwise(F.col("w.e"))
    return out.select(key, F.col("w.o").alias(order), F.col("w.u").alias(unit), F.col("w.s").alias(start), last_end.alias(end))
