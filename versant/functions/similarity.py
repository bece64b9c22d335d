"""Similarity of texts that no built-in gives: Indel ratio and phonetic distance.

The kernels are plain Python over one pair; the columns are Arrow-batched and
score each distinct pair of a batch once.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Places of articulation from front to back, emphatic letters, letters often confused.
PLACES = ("بم", "فو", "ثذظ", "تدطضنلر", "سزص", "شجي", "كغخ", "ق", "عح", "ها")
EMPHATIC = "صضطظ"
CONFUSED = ("تط", "دض", "ذز", "ثس", "صس", "قك", "عا", "هح", "اه")

_PLACE = {letter: n for n, letters in enumerate(PLACES) for letter in letters}
_CONFUSED = {frozenset(p) for p in CONFUSED}


def indel_ratio(a: str, b: str) -> float:
    """2 * LCS / (len a + len b) by bit-parallel rows; two empty texts are alike."""
    if not a and not b:
        return 1.0
    if a == b:
        return 1.0
    short, long_ = sorted((a, b), key=len)
    where, full = letter_places(short)
    row = common_row(full, where, full, long_)
    return 2 * (len(short) - row.bit_count()) / (len(a) + len(b))


def letter_places(text: str) -> tuple[dict[str, int], int]:
    """Each letter's places in a text as bits, and all of its places."""
    where: dict[str, int] = {}
    for i, c in enumerate(text):
        where[c] = where.get(c, 0) | (1 << i)
    return where, (1 << len(text)) - 1


def common_row(row: int, where: dict[str, int], full: int, text: str) -> int:
    """The row of bits after a text's letters; in a pattern's first k places, its zeros are how many letters in
    order these k and the text have in common.  A row may be taken further by more text, and patterns with a
    zero of ``full`` between them may lie side by side."""
    for mask in map(where.get, text):
        if mask:
            hit = row & mask
            row = (row + hit | row ^ hit) & full
    return row


def packed_places(codes: np.ndarray, places: np.ndarray, n_bytes: int, letters: Iterable[str]) -> dict[str, int]:
    """``letter_places`` of many patterns in one long integer: the places of letters given by their code points."""
    where, bits = {}, np.zeros(8 * n_bytes, dtype=bool)
    order = np.argsort(codes, kind="stable")
    codes, places = codes[order], places[order]
    for c in letters:
        mine = places[np.searchsorted(codes, ord(c)) : np.searchsorted(codes, ord(c), "right")]
        if mine.size:
            bits[mine] = True
            where[c] = as_integer(bits)
            bits[mine] = False
    return where


def as_integer(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def letter_distance(a: str, b: str) -> float:
    """0 for equal letters up to 1; confusable and near places of articulation lie between."""
    if a == b:
        return 0.0
    if frozenset((a, b)) in _CONFUSED:
        return 0.15
    near = abs(_PLACE[a] - _PLACE[b]) if a in _PLACE and b in _PLACE else 2
    if near == 0:
        return 0.2 if (a in EMPHATIC) != (b in EMPHATIC) else 0.3
    return 0.5 if near == 1 else 1.0


@lru_cache(maxsize=65536)
def phonetic_word(a: str, b: str, gap: float = 0.8) -> float:
    """1 less the cheapest alignment of the letters over the longer length."""
    if a == b:
        return 1.0
    short, long_ = sorted((len(a), len(b)))
    if not short or long_ > 2 * short:
        return 0.0
    row = [gap * j for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        ahead = [gap * i]
        for j, y in enumerate(b, 1):
            ahead.append(min(row[j - 1] + letter_distance(x, y), ahead[-1] + gap, row[j] + gap))
        row = ahead
    return max(0.0, 1.0 - row[-1] / long_)


def phonetic_text(a: str, b: str) -> float:
    """Mean over the word places of the longer of two normalised texts; 0 if either is empty."""
    left, right = a.split(), b.split()
    if not left or not right:
        return 0.0
    n = max(len(left), len(right))
    left, right = left + [""] * (n - len(left)), right + [""] * (n - len(right))
    return sum(map(phonetic_word, left, right)) / n


def _paired(score):
    """A pandas function that scores each distinct pair once."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        seen: dict[tuple[str, str], float] = {}
        out = []
        for pair in zip(a.fillna(""), b.fillna("")):
            if pair not in seen:
                seen[pair] = score(*pair)
            out.append(seen[pair])
        return pd.Series(out, dtype="float64")

    return run


def _column(score, a: Column, b: Column) -> Column:
    return F.pandas_udf(_paired(score), "double")(a, b)


def indel(a: Column | str, b: Column | str, normalized: bool = True) -> Column:
    """Indel ratio, by an Arrow-batched function that scores each different pair of a batch once."""
    a, b = (T.normalize(a), T.normalize(b)) if normalized else (T._c(a), T._c(b))
    return _column(indel_ratio, a, b)


def indel_bound(a: Column, b: Column) -> Column:
    """No Indel ratio of two texts is higher than their lengths allow; for filtering before the score."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.least(F.length(a), F.length(b)) / total)


def indel_native(a: Column, b: Column) -> Column:
    """The same ratio as a fold over letters, all in the JVM; for short texts."""
    letters_b = F.when(F.length(b) > 0, F.split(b, "")).otherwise(F.array().cast("array<string>"))
    letters_b = F.filter(letters_b, lambda x: x != "")
    letters_a = F.filter(F.split(a, ""), lambda x: x != "")
    zero = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))

    def step(row: Column, x: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            best = F.when(F.get(letters_b, j - 1) == x, F.get(row, j - 1) + 1).otherwise(F.greatest(F.get(row, j), F.element_at(done, -1)))
            return F.concat(done, F.array(best))

        places = F.filter(F.sequence(F.lit(0), F.length(b)), lambda j: j > 0)
        return F.aggregate(places, F.array(F.lit(0)), cell)

    total = F.length(a) + F.length(b)
    common = F.element_at(F.aggregate(letters_a, zero, step), -1)
    return F.when(total == 0, 1.0).otherwise(2.0 * common / total)


def phonetic(a: Column | str, b: Column | str) -> Column:
    return _column(phonetic_text, T.normalize(a), T.normalize(b))


def boundary_match(segment: Column | str, unit: Column | str, position: str, n: int = 3, threshold: float = 0.6) -> Column:
    """Whether the first or last words of both agree; n is cut to the unit's words."""
    taken = F.least(F.lit(n), T.word_count(unit))
    if position == "start":
        pick = lambda t: F.array_join(F.slice(T.normalized_words(t), 1, taken), " ")
    else:
        pick = lambda t: F.array_join(F.slice(T.normalized_words(t), -F.greatest(F.least(taken, T.word_count(t)), F.lit(1)), F.greatest(taken, F.lit(1))), " ")
    return indel(pick(segment), pick(unit), normalized=False) >= threshold
