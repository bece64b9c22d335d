"""Alignment of many recordings: a grouped Arrow stage around the solvers of one recording."""

from __future__ import annotations

import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import solve

RESULT = "recording long, unit_no long, start_s double, end_s double, text string, score double, overlap boolean, source string, group_id long, words array<struct<word: string, start: double, end: double>>, error string"
_WORD = pa.struct([("word", pa.string()), ("start", pa.float64()), ("end", pa.float64())])
_RESULT = pa.schema([("recording", pa.int64()), ("unit_no", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("text", pa.string()), ("score", pa.float64()), ("overlap", pa.bool_()), ("source", pa.string()), ("group_id", pa.int64()), ("words", pa.list_(_WORD)), ("error", pa.string())])
#: Bytes of recordings that a worker is sent at a time, unless the session says otherwise.
_BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows that a worker gives back at a time.
_ROWS = 8192


def _small_batches(spark: SparkSession) -> None:
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(_BATCH_BYTES))


def drop_formulas(segments: DataFrame, key: str, kind: str, first_group: Column) -> DataFrame:
    """Opening formulas go: both kinds, or istiadha alone where ``first_group`` says that the recording is of
    group 1, whose text holds the other; a recording of formulas alone keeps its rows."""
    gone = F.coalesce((F.col(kind) == "istiadha") | (F.col(kind).isin("basmala", "basmalah") & ~first_group), F.lit(False))
    kept = F.count_if(~F.col("_gone")).over(Window.partitionBy(key))
    return segments.withColumn("_gone", gone).withColumn("_kept", kept).filter(~F.col("_gone") | (F.col("_kept") == 0)).drop("_gone", "_kept")


def align(segments: DataFrame, units: DataFrame, strategy: str = "auto", silences: DataFrame | None = None, envelope: DataFrame | None = None, progress: Accumulator | None = None, isolate: bool = False, **options) -> DataFrame:
    """One scored, timed row for each unit of each recording.

    segments: recording, seg_idx, start_s, end_s, text, and if known kind (formulas; ayah where it is missing or
    null), text_id (0: no unit's text), group_id and words (word, start, end); units: recording, unit_no, text,
    and group_id (1 where missing or null); silences: recording, silence_start, silence_end; envelope:
    recording, t, rms.  Group 1's opening formula is part of its text, other groups' are passed over.  Words of
    the segments come back with the unit that took them.  ``progress`` counts the units that are done.
    With ``isolate`` a recording that can't be aligned is one row with the reason as ``error`` and no unit,
    and the others are aligned; without it, the error ends the job.
    Options are those of ``solve.align_full``; ``required`` maps (group, unit index) to tokens.

    The recording is the shuffle key of both sides; recordings without units or segments give no rows, null
    recordings neither; null texts are empty, and null times an error of their recording.
    """
    spare = {"kind": F.lit("ayah"), "text_id": F.lit(1), "group_id": F.lit(None).cast("int"), "words": F.lit(None).cast("array<struct<word: string, start: double, end: double>>")}
    given = {c: F.col(c) if c in segments.columns else other for c, other in spare.items()}
    fields = F.struct("seg_idx", "start_s", "end_s", "text", *[c.alias(n) for n, c in given.items()])
    grouped = segments.select("recording", fields.alias("s")).groupBy("recording").agg(F.sort_array(F.collect_list("s")).alias("segments"))
    group = F.col("group_id") if "group_id" in units.columns else F.lit(None).cast("int")
    wanted = units.groupBy(F.col("recording").alias("_r1")).agg(F.sort_array(F.collect_list(F.struct(F.coalesce(group, F.lit(1)).alias("group_id"), "unit_no", "text"))).alias("units"))
    joined = grouped.join(wanted, F.col("recording") == F.col("_r1")).drop("_r1")
    for name, side, a, b in (("silences", silences, "silence_start", "silence_end"), ("envelope", envelope, "t", "rms")):
        if side is None:
            joined = joined.withColumn(name, F.lit(None).cast("array<struct<a: double, b: double>>"))
            continue
        extra = side.groupBy(F.col("recording").alias("_r2")).agg(F.sort_array(F.collect_list(F.struct(F.col(a).alias("a"), F.col(b).alias("b")))).alias(name))
        joined = joined.join(extra, F.col("recording") == F.col("_r2"), "left").drop("_r2")
    _small_batches(segments.sparkSession)

    def solved(one: dict) -> list[tuple]:
        wanted = [solve.Unit(int(u["unit_no"]), u["text"] or "", u["group_id"]) for u in one["units"]]
        parts = []
        for s in one["segments"]:
            if s["start_s"] is None or s["end_s"] is None:
                raise ValueError(f"segment {s['seg_idx']} of recording {one['recording']} has no time")
            words = tuple((w["word"], w["start"], w["end"]) for w in s["words"] or ())
            of_group = wanted[0].group if s["group_id"] is None else s["group_id"]
            parts.append(solve.Segment(s["text"] or "", s["start_s"], s["end_s"], s["kind"] or "ayah", 1 if s["text_id"] is None else s["text_id"], of_group, words))
        sides = [[(x["a"], x["b"]) for x in one[n] or ()] for n in ("silences", "envelope")]
        found = solve.align_full(parts, wanted, *sides, strategy, **options)
        if progress is not None:
            progress.add(len(found))
        word = lambda w: (w.text, w.start, w.end) if isinstance(w, solve.Word) else tuple(w)
        return [(one["recording"], r.unit.number, r.start, r.end, r.text, r.score, r.overlap, r.source, r.unit.group, [dict(zip(("word", "start", "end"), word(w))) for w in r.words], None) for r in found]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1).to_pylist()[0]
                try:
                    out = solved(one)
                except Exception as wrong:
                    if not isolate:
                        raise
                    out = [(one["recording"], *[None] * (len(_RESULT) - 2), f"{type(wrong).__name__}: {wrong}")]
                finally:
                    solve.forget()
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), _RESULT)], schema=_RESULT)

    return joined.filter("recording is not null").mapInArrow(run, RESULT)


def _per_recording(left: DataFrame, right: DataFrame, left_fields: list[str], right_fields: list[str], solver, schema: str) -> DataFrame:
    """Runs ``solver(rows of left, rows of right)`` for each recording; it gives tuples behind the recording.
    A worker holds the rows of one recording at a time, besides the batch that it was sent and the rows it is about to give."""
    a = left.groupBy("recording").agg(F.sort_array(F.collect_list(F.struct(*left_fields))).alias("a"))
    b = right.groupBy(F.col("recording").alias("_r")).agg(F.sort_array(F.collect_list(F.struct(*right_fields))).alias("b"))
    joined = a.join(b, F.col("recording") == F.col("_r"), "left").select("recording", "a", "b")
    _small_batches(left.sparkSession)
    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    def run(batches):
        out = []
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1).to_pylist()[0]
                for x in solver(one["a"], one["b"] or []):
                    out.append((one["recording"], *x))
                    if len(out) >= _ROWS:
                        yield batch_of(out)
                        out = []
        if out:
            yield batch_of(out)

    return joined.mapInArrow(run, schema)


def match_words(reference: DataFrame, heard: DataFrame) -> DataFrame:
    """Each reference word (recording, word_idx, word) with the heard word it is matched with, in order; null if none."""

    def solver(a, b):
        found = solve.align_sequences([x["word"] for x in a], [x["word"] for x in b])
        return ((x["word_idx"], None if j is None else b[j]["word_idx"]) for x, j in zip(a, found))

    fields = ["word_idx", "word"]
    return _per_recording(reference, heard, fields, fields, solver, "recording long, word_idx long, heard_idx long")


def claim_breaths(segments: DataFrame, breaths: DataFrame) -> DataFrame:
    """Each segment (recording, seg_idx, end_s) with the nearest breath (start_sec, end_sec) that none before it
    took: pause_duration, 0 without one, and is_breath_boundary."""

    def solver(a, b):
        found = solve.claim_breaths([x["end_s"] for x in a], [(x["start_sec"], x["end_sec"]) for x in b])
        return [(x["seg_idx"], 0.0 if j is None else b[j]["end_sec"] - b[j]["start_sec"], j is not None) for x, j in zip(a, found)]

    return _per_recording(segments, breaths, ["seg_idx", "end_s"], ["start_sec", "end_sec"], solver, "recording long, seg_idx long, pause_duration double, is_breath_boundary boolean")


def snap_boundaries(rows: DataFrame, targets: DataFrame, to: str = "silences") -> DataFrame:
    """Moves borders of (recording, unit_no, start_s, end_s) to silences (a, b: start and end) or to quiet frames
    (a, b: time and energy); a moved start counts for the next border, hence one pass over each recording."""
    move = {"silences": solve.snap_to_silences, "energy": solve.snap_to_energy}[to]

    def solver(a, b):
        given = [solve.Row(solve.Unit(int(x["unit_no"]), ""), x["start_s"], x["end_s"], "", 0.0) for x in a]
        return [(r.unit.number, r.start, r.end) for r in move(given, [(x["a"], x["b"]) for x in b])]

    return _per_recording(rows, targets, ["unit_no", "start_s", "end_s"], ["a", "b"], solver, "recording long, unit_no long, start_s double, end_s double")
