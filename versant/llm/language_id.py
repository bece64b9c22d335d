"""Language identification with string kernels.

A text is the set of its byte strings of 1 to ``longest`` bytes (letters in
lower case, everything else that is ASCII a space): the blended spectrum, as
presence.  The kernel of two texts is the number of strings they share over the
root of the product of their numbers; strings are hashed to ``width`` places.
Landmarks from the training sample give the Nystroem form of kernel ridge
regression, one language against the rest.  A batch of texts is scored by two
matrix products: texts by landmarks, then landmarks by languages.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_rows import extended, map_arrow, record, row_priority, slices
from .text_arrays import bytes_of

_LETTERS = np.full(256, 32, dtype=np.uint8)
_LETTERS[128:] = np.arange(128, 256)
_LETTERS[97:123] = _LETTERS[65:91] = np.arange(97, 123)

_SAMPLE = pa.schema([("lang", pa.string()), ("priority", pa.float64()), ("bits", pa.binary())])
_ADDED = pa.schema([("lang_pred", pa.string()), ("score", pa.float64())])


def presence(column: pa.Array, width: int, longest: int) -> np.ndarray:
    """A row of 0 and 1 for each text: which hashed strings occur in it."""
    raw, places = bytes_of(column)
    text = _LETTERS[raw].astype(np.uint32)
    rows = len(places) - 1
    out = np.zeros(rows * width, dtype=bool)
    owner = np.repeat(np.arange(rows, dtype=np.int64), np.diff(places))
    gram = np.zeros(len(text), dtype=np.uint32)
    shift = np.uint32(32 - int(width).bit_length() + 1)
    for n in range(1, longest + 1):
        size = len(text) - n + 1
        if size <= 0:
            break
        with np.errstate(over="ignore"):
            gram = gram[:size] * np.uint32(257) + text[n - 1 :] + np.uint32(n)
            slot = (gram * np.uint32(2654435769)) >> shift
        inside = owner[:size] == owner[n - 1 :]
        at = owner[:size] * width + slot
        out[at if n == 1 else at[inside]] = True
    return out.reshape(rows, width)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


@dataclass
class KernelModel:
    languages: list[str]
    landmarks: np.ndarray  # presence rows, each over the root of its size
    weights: np.ndarray  # landmarks by languages
    width: int
    longest: int

    def kernel(self, rows: np.ndarray) -> np.ndarray:
        sizes = np.maximum(rows.sum(axis=1, keepdims=True), 1)
        return (rows.astype(np.float32) @ self.landmarks.T) / np.sqrt(sizes).astype(np.float32)

    def predict(self, column: pa.Array, block: int = 512) -> tuple[list[str], np.ndarray]:
        """The best language and its share (softmax of the scores) for each text."""
        names, shares = [], np.zeros(len(column))
        for at in range(0, len(column), block):
            part = column.slice(at, block)
            if self.languages:
                scores = self.kernel(presence(part, self.width, self.longest)) @ self.weights
                odds = np.exp(4.0 * (scores - scores.max(axis=1, keepdims=True)))
                best = scores.argmax(axis=1)
                share = (odds / odds.sum(axis=1, keepdims=True))[np.arange(len(part)), best]
            for i, text in enumerate(part):
                known = self.languages and has_letter(text.as_py())
                names.append(self.languages[best[i]] if known else "und")
                shares[at + i] = share[i] if known else 0.0
        return names, shares


def fit(docs: DataFrame, training: Column, per_language: int = 512, landmarks: int = 48, width: int = 8192, longest: int = 3, ridge: float = 1e-3, most_languages: int = 200, lang_column: str = "lang", text_column: str = "text") -> KernelModel:
    """Learns from a sample of about ``per_language`` distinct texts of each of the ``most_languages``
    commonest languages (ties by name) among the rows where ``training`` holds and language and text
    are not null; ``landmarks`` of them are landmarks.  The sample goes by the texts' hash, so it is
    the same however rows are ordered, repeated in files or partitioned."""
    rows = docs.filter(training).select(F.col(lang_column).cast("string").alias("lang"), row_priority(text_column).alias("priority"), F.col(text_column).cast("string").alias("text")).filter("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(most_languages).collect()}
    if not counts:
        return KernelModel([], np.zeros((0, width), np.float32), np.zeros((0, 0), np.float32), width, longest)

    def run(batches):
        sent = set()
        for batch in batches:
            for part in slices(batch):
                keep = []
                for row in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    chosen = row[0] in counts and row[1] < 1.2 * per_language / counts[row[0]] and row not in sent
                    keep.append(chosen)
                    if chosen:
                        sent.add(row)
                part = part.filter(pa.array(keep))
                if part.num_rows:
                    bits = np.packbits(presence(part.column(2), width, longest), axis=1)
                    yield record(_SAMPLE, part.column(0), part.column(1), [b.tobytes() for b in bits])

    sample = sorted(map_arrow(rows, run, "lang string, priority double, bits binary").collect(), key=lambda r: (r["lang"], r["priority"]))
    taken: dict[str, list[np.ndarray]] = {}
    last = None
    for r in sample:
        own = taken.setdefault(r["lang"], [])
        same, last = last == (r["lang"], r["priority"]), (r["lang"], r["priority"])
        if len(own) < per_language and not same:
            own.append(np.unpackbits(np.frombuffer(r["bits"], np.uint8)))
    languages = sorted(taken)
    x = np.array([v for lang in languages for v in taken[lang]], dtype=np.float32)
    y = np.array([[1.0 if lang == other else -1.0 for other in languages] for lang in languages for _ in taken[lang]])
    marks = np.array([v for lang in languages for v in taken[lang][:landmarks]], dtype=np.float32)
    marks /= np.sqrt(np.maximum(marks.sum(axis=1, keepdims=True), 1))
    model = KernelModel(languages, marks, np.zeros((len(marks), len(languages)), np.float32), width, longest)
    k_nm = model.kernel(x).astype(np.float64)
    k_mm = (marks @ marks.T).astype(np.float64)
    left = k_nm.T @ k_nm + ridge * len(x) * k_mm + 1e-6 * np.eye(len(marks))
    model.weights = np.linalg.solve(left, k_nm.T @ y).astype(np.float32)
    return model


def identify(docs: DataFrame, model: KernelModel, text_column: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1).  Null texts and texts without a letter are ``und``
    with score 0, as is everything if there was nothing to learn from.  Columns named like the new
    ones give way to them; repeated rows are alike; an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = F.col(text_column).cast("string")
    return extended(docs, [text], "lang_pred string, score double", _ADDED, lambda given: (shared.value.predict(given.column(0)), None))


def only_identified(docs: DataFrame, model: KernelModel, least: float, text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, whose language ``identify`` finds with a score of ``least`` or
    more; null texts and texts without a letter go."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def values(given):
        names, shares = shared.value.predict(given.column(0))
        return (), [n != "und" and s >= least for n, s in zip(names, shares.tolist())]

    return extended(docs, [F.col(text_column).cast("string")], "", pa.schema([]), values)
