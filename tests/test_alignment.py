"""Alignment of DataFrames: groups, formulas, words, required tokens; joins of intervals; streams and sources."""

import io
import json
import math
import struct
import wave

import pytest
from pyspark.sql import functions as F

from versant import cli
from versant.operators.solve import Unit, Word, align_words

from versant.operators import intervals
from versant.plans import alignment, report
from versant.sources import audio, corpus
from versant.streaming import sessions

SEGMENT = "recording long, seg_idx int, start_s double, end_s double, text string, kind string, group_id int, words array<struct<word: string, start: double, end: double>>"
FORMULA = "بسم الله الرحمن الرحيم"
UNITS = {1: [FORMULA, "الحمد لله رب العالمين"], 2: ["الم", "ذلك الكتاب لا ريب فيه هدى للمتقين"]}


def given(spark):
    """Recording 10 holds group 1 and recording 20 group 2, which its opening formula precedes."""
    words = lambda text, a, b: [(w, a + i * (b - a) / len(text.split()), a + (i + 1) * (b - a) / len(text.split())) for i, w in enumerate(text.split())]
    rows = []
    for recording, group in ((10, 1), (20, 2)):
        texts = ([FORMULA] if group != 1 else []) + UNITS[group]
        for i, text in enumerate(texts):
            rows.append((recording, i, 3.0 * i, 3.0 * i + 2, text, "basmala" if text == FORMULA else "ayah", group, words(text, 3.0 * i, 3.0 * i + 2)))
    rows.append((None, 0, 0.0, 1.0, None, None, None, None))
    units = [(10 * g, g, i + 1, t) for g, texts in UNITS.items() for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SEGMENT), spark.createDataFrame(units, "recording long, group_id int, unit_no int, text string")


@pytest.mark.parametrize("strategy", ["dp", "greedy", "hybrid", "words"])
def test_groups_and_words_are_carried(spark, strategy):
    segments, units = given(spark)
    found = alignment.align(segments, units, strategy, repair=False).orderBy("recording", "unit_no").collect()
    assert [(r.recording, r.group_id, r.unit_no, round(r.score, 3)) for r in found] == [(10, 1, 1, 1.0), (10, 1, 2, 1.0), (20, 2, 1, 1.0), (20, 2, 2, 1.0)]
    assert [r.start_s for r in found if r.recording == 20] == pytest.approx([3.0, 6.0], abs=0.35)
    assert [[w.word for w in r.words] for r in found] == [t.split() for g in UNITS for t in UNITS[g]]
    assert alignment.align(segments.limit(0), units, strategy).count() == 0 == alignment.align(segments, units.limit(0), strategy).count()


def test_required_tokens_and_progress(spark):
    rows = [(1, 0, 0.0, 1.0, "alpha beta"), (1, 1, 1.0, 2.0, "gamma"), (1, 2, 2.0, 3.0, "delta epsilon")]
    segments = spark.createDataFrame(rows, "recording long, seg_idx int, start_s double, end_s double, text string")
    units = spark.createDataFrame([(1, 1, "alpha beta"), (1, 2, "delta epsilon")], "recording long, unit_no int, text string")
    plain = [r.text for r in alignment.align(segments, units, "greedy", fix_drift=False).orderBy("unit_no").collect()]
    forced = [r.text for r in alignment.align(segments, units, "greedy", fix_drift=False, required={(1, 0): ["gamma"]}).orderBy("unit_no").collect()]
    assert plain[0] == "alpha beta" and forced == ["alpha beta gamma", "delta epsilon"]
    done = spark.sparkContext.accumulator(0)
    assert alignment.align(segments, units, "dp", progress=done).count() == 2 == done.value


def test_semi_joins_keep_repeated_rows_and_add_none(spark):
    left = spark.createDataFrame([(1, 7, 0.0, 120.0), (1, 8, 0.0, 5.0), (1, 8, 0.0, 5.0), (1, 9, 300.0, 301.0)], "k long, id long, s double, e double")
    right = spark.createDataFrame([(1, 4.0, 11.0), (1, 70.0, 71.0), (2, 300.0, 301.0)], "k long, rs double, re double")
    assert sorted(r.id for r in intervals.overlap_join(left, right, "k", ("s", "e"), ("rs", "re"), how="left_semi").collect()) == [7, 8, 8]
    assert sorted(r.id for r in intervals.near_start(left, right, "k", "id", "e", "rs", tolerance=2.0).collect()) == [8, 8]


def test_sources(spark, tmp_path):
    for edition, mark in (("a", ""), ("b", "!")):
        (tmp_path / f"c/edition={edition}").mkdir(parents=True)
        (tmp_path / f"c/edition={edition}/x.json").write_text(json.dumps({"1": ["x" + mark, "y"], "114": ["z"], "115": ["no"], "2": ["v"]}))
    units = corpus.corpus(spark, f"{tmp_path}/c", "b")
    assert sorted(map(tuple, units.collect())) == [(1, 1, 1, "x!"), (2, 1, 2, "y"), (3, 2, 1, "v"), (4, 114, 1, "z")]
    assert [r.text for r in corpus.group_units(units, "001").orderBy("unit_no").collect()] == ["x!", "y"]
    assert corpus.unit(units, 114, 1).first().id == 4 and corpus.unit(units, 2, 9).count() == 0
    for wrong in (0, 115):
        with pytest.raises(corpus.CorpusError):
            corpus.group_units(units, wrong)
    (tmp_path / "audio").mkdir()
    (tmp_path / "audio/002_x.wav").write_bytes(b"12345")
    (tmp_path / "audio/notes.txt").write_bytes(b"1")
    assert [(r.length, r.group_id) for r in corpus.recordings(spark, f"{tmp_path}/audio", "*.wav").collect()] == [(5, 2)]
    (tmp_path / "seg.json").write_text(json.dumps({"recording": 1, "seg_idx": 0, "text": "t", "words": [{"word": "t", "start": 0.5, "end": 1.0}]}) + "\n")
    (tmp_path / "sil.json").write_text(json.dumps({"recording": 1, "start_ms": 100, "end_ms": 250}) + "\n")
    assert corpus.segments(spark, f"{tmp_path}/seg.json").first().words[0].start == 0.5
    assert tuple(corpus.silences(spark, f"{tmp_path}/sil.json").first()) == (1, 100, 250)
    samples = spark.createDataFrame([(list(range(100)), 200, 450)], "x array<int>, a int, b int")
    assert samples.select(corpus.slice_samples("x", 100, "a", "b")).first()[0] == list(range(20, 45))


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [(1, f"2024-01-01 0{h}:00:00", float(h)) for h in (0, 1, 9)] + [(2, "2024-01-01 09:30:00", 3.0), (3, "2024-01-05 00:00:00", 1.0)]
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps({"k": k, "ts": t, "v": v}) for k, t, v in rows))
    arriving = lambda: sessions.arriving(spark, f"{tmp_path}/in", "k long, ts timestamp, v double")
    for name, stream in (("s", sessions.session_counts(arriving(), "k", "ts")), ("f", sessions.frame_energy(arriving(), "k", "ts", "v", "2 hours", "1 hour"))):
        sessions.write_available(stream, f"{tmp_path}/{name}", f"{tmp_path}/{name}-state").awaitTermination()
    counts = {(r.k, r.n_events) for r in spark.read.parquet(f"{tmp_path}/s").collect()}
    assert counts == {(1, 2), (1, 1), (2, 1)}  # key 3's session is still open
    energy = {(r.k, r.frame_start.hour): round(r.rms, 6) for r in spark.read.parquet(f"{tmp_path}/f").filter("k = 1").collect()}
    assert energy[1, 0] == pytest.approx(0.5**0.5) and energy[1, 9] == 9.0


def test_command_line_keeps_going_when_a_recording_fails(spark, tmp_path):
    (tmp_path / "corpus.json").write_text(json.dumps({str(g): t for g, t in UNITS.items()}))
    segments, _ = given(spark)
    good = segments.filter("recording is not null").toPandas()
    lines = [json.dumps({"recording": int(r.recording), "seg_idx": int(r.seg_idx), "group_id": int(r.group_id), "start_s": r.start_s, "end_s": r.end_s, "text": r.text, "kind": r.kind}) for r in good.itertuples()]
    lines.append(json.dumps({"recording": 30, "seg_idx": 0, "group_id": 2, "text": "no times"}))
    (tmp_path / "seg.json").write_text("\n".join(lines))
    for form in ("json", "csv", "text"):
        assert cli.main([f"{tmp_path}/seg.json", f"{tmp_path}/corpus.json", f"{tmp_path}/{form}", "--format", form, "--strategy", "dp"], spark) == 1
    rows = {r.recording: json.loads(r.value) for r in spark.read.text(f"{tmp_path}/json").collect()}
    assert set(rows) == {10, 20} and rows[20]["metadata"]["group_id"] == 2 and rows[20]["metadata"]["generated_at"][:2] == "20"
    assert [(u["id"], u["unit_no"], u["original_text"], u["overlap_detected"]) for u in rows[20]["results"]] == [(3, 1, UNITS[2][0], False), (4, 2, UNITS[2][1], False)]
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/csv").filter("recording = 10").collect())[0].startswith('1,0.00,')
    assert spark.read.text(f"{tmp_path}/text").filter("value like 'Unit 1: %s'").count() == 2
    names = corpus.dimension(corpus.corpus(spark, f"{tmp_path}/corpus.json"), {1: "one"})
    assert sorted(map(tuple, names.collect())) == [(1, 2, "one"), (2, 2, None)]
    segments, units = given(spark)
    named = report.full_document(alignment.align(segments, units, "dp"), units, names, {"reader": F.lit("x")})
    assert {r.recording: json.loads(r.value)["metadata"].get("group_name") for r in named.collect()} == {10: "one", 20: None}


@pytest.mark.parametrize("width,channels", [(1, 1), (2, 2), (3, 1), (4, 1)])
def test_wav_files_become_frames_and_silences(spark, tmp_path, width, channels):
    rate, most = 8000, (1 << 8 * width - 1) - 1
    values = [round(most * (0 if 1 <= t / rate < 2 else 0.5 * math.sin(t))) for t in range(3 * rate)]
    data = b"".join((bytes([v + 128]) if width == 1 else struct.pack("<q", v)[:width]) * channels for v in values)
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as out:
        out.setnchannels(channels), out.setsampwidth(width), out.setframerate(rate)
        out.writeframes(data)
    (tmp_path / "a.wav").write_bytes(buffer.getvalue())
    (tmp_path / "b.wav").write_bytes(b"not a recording")
    found = audio.energy_frames(spark, str(tmp_path))
    assert [r.path.endswith("b.wav") and r.t is None for r in found.filter("error is not null").collect()] == [True]
    silence = audio.detect_silences(found).collect()
    assert len(silence) == 1 and silence[0].silence_start == pytest.approx(1, abs=0.06) and silence[0].silence_end == pytest.approx(2, abs=0.06)
    speech = sorted((r.chunk_start, r.chunk_end) for r in audio.detect_speech(found).collect())
    assert [x for r in speech for x in r] == pytest.approx([0, 1, 2, 3], abs=0.06)


def test_surroundings_place_repeated_short_units():
    texts = ["one two three", "go on", "four five six", "go on", "seven eight"]
    words = [Word(w, i * 0.5, i * 0.5 + 0.4) for i, w in enumerate(" ".join(texts).split())]
    rows = align_words(words, [Unit(i + 1, t) for i, t in enumerate(texts)])
    assert [r.text for r in rows] == texts
    assert align_words(words[:3], [Unit(i, "x") for i in range(9)]) == []


def test_recordings_are_sent_in_small_batches(spark, monkeypatch):
    rows = spark.range(60 * 20).selectExpr("id div 20 as recording", "id % 20 as seg_idx", "double(id) as end_s").coalesce(1)
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(setting)
    found = alignment.claim_breaths(rows, rows.selectExpr("recording", "end_s as start_sec", "end_s + 0.5 as end_sec"))
    assert spark.conf.get(setting, None) == str(4 << 20) and "Pandas" not in found._jdf.queryExecution().toString()
    monkeypatch.setattr(alignment, "_ROWS", 7)  # rows that a worker gives back at a time
    assert sorted(r.seg_idx for r in found.collect()) == sorted(list(range(20)) * 60) and found.filter("is_breath_boundary").count() == 1200
