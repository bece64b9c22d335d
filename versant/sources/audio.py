"""Recordings as sound: WAV files decoded by the executors into frames of energy, silences and speech chunks."""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frames

_FRAMES = pa.schema([("path", pa.string()), ("t", pa.float64()), ("rms", pa.float64()), ("total_s", pa.float64()), ("error", pa.string())])


def decode_wav(content: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and samples from -1 to 1, channels averaged, of whole-number PCM of 8 to 32 bits."""
    with wave.open(io.BytesIO(content)) as sound:
        width, channels, rate = sound.getsampwidth(), sound.getnchannels(), sound.getframerate()
        raw = np.frombuffer(sound.readframes(sound.getnframes()), np.uint8)
    raw = raw[: len(raw) // (width * channels) * width * channels].reshape(-1, width)
    if width == 1:
        values = raw[:, 0].astype(np.float64) - 128
    else:
        padded = np.zeros((len(raw), 4), np.uint8)
        padded[:, 4 - width :] = raw
        values = padded.view("<i4")[:, 0].astype(np.float64) / (1 << 8 * (4 - width))
    return rate, values.reshape(-1, channels).mean(axis=1) / (1 << 8 * width - 1)


def frame_rms(samples: np.ndarray, rate: int, frame_s: float, hop_s: float) -> np.ndarray:
    """Root mean square of each whole frame; of all samples where they are fewer than a frame."""
    size, hop = max(1, round(frame_s * rate)), max(1, round(hop_s * rate))
    if not len(samples):
        return np.zeros(0)
    size = min(size, len(samples))
    sums = np.concatenate([[0.0], np.cumsum(samples * samples)])
    starts = np.arange(0, len(samples) - size + 1, hop)
    return np.sqrt(np.maximum(sums[starts + size] - sums[starts], 0) / size)


def energy_frames(spark: SparkSession, folder: str, pattern: str = "*.wav", frame_s: float = 0.05, hop_s: float = 0.025) -> DataFrame:
    """path, t, rms, total_s of each frame.  A file that can't be decoded is one row with the reason as
    ``error`` and no frame, so one bad file doesn't fail the others; an empty recording gives no rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")

    def run(batches):
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    rate, samples = decode_wav(content)
                    rms = frame_rms(samples, rate, frame_s, hop_s)
                except (wave.Error, EOFError, ValueError) as wrong:
                    yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip((path, None, None, None, str(wrong) or type(wrong).__name__), _FRAMES)], schema=_FRAMES)
                    continue
                n = len(rms)
                columns = [path] * n, np.arange(n) * max(1, round(hop_s * rate)) / rate, rms, np.full(n, len(samples) / rate), [None] * n
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _FRAMES)], schema=_FRAMES)

    return files.mapInArrow(run, "path string, t double, rms double, total_s double, error string")


def detect_silences(found: DataFrame, threshold_db: float = -30.0, least: float = 0.3) -> DataFrame:
    """Silences (path, silence_start, silence_end) of the files that were decoded."""
    return frames.silence_runs(found.filter("error is null"), "path", "t", "rms", threshold_db=threshold_db, least=least)


def detect_speech(found: DataFrame, threshold_db: float = -30.0, merge_gap: float = 0.3) -> DataFrame:
    """Chunks of speech (path, chunk_start, chunk_end); a recording that is silent throughout is one chunk."""
    rows = found.filter("error is null")
    return frames.speech_chunks(rows, "path", "t", "rms", F.col("total_s"), threshold_db=threshold_db, merge_gap=merge_gap)
