"""Words and shingles of whole columns of text as numpy arrays of 64-bit hashes.

Words are runs of bytes other than the six ASCII white-space characters, A-Z in
lower case.  Everything here is a pure function of the text, alike in every
worker, so hashes can be compared and joined anywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and where each row starts (one more than rows)."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, places, data = column.buffers()
    if len(column) == 0 or places is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    places = np.frombuffer(places, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, dtype=np.uint8), places - places[0]
    return np.frombuffer(data, dtype=np.uint8)[places[0] : places[-1]], places - places[0]


class Words:
    """The words of a column: hashes, and for each row where its words start."""

    def __init__(self, column: pa.Array):
        raw, self.places = bytes_of(column)
        inside = ~_SPACE[raw]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edge = self.places[:-1][self.places[:-1] < self.places[1:]]
        begins[edge] = inside[edge]
        at = np.flatnonzero(begins)
        #: first byte of each word in ``letters``, the bytes of all words end to end
        self.letters = LOWER[raw[inside]]
        self.starts = np.cumsum(inside)[at] - 1 if len(at) else np.zeros(0, dtype=np.int64)
        self.sizes = np.diff(np.append(self.starts, len(self.letters)))
        self.first = np.searchsorted(at, self.places)  # of each row, in words
        self.hashes = self._hashes()

    def _hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        with np.errstate(over="ignore"):
            place = np.arange(len(self.letters), dtype=np.int32)
            place -= np.repeat(self.starts.astype(np.int32), self.sizes)
            terms = _VALUE[self.letters]
            terms *= _powers(int(self.sizes.max()))[place]
            return mix(np.add.reduceat(terms, self.starts) + self.sizes.astype(np.uint64))


def joined(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k words in a row, by the place of the first."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, k, dtype=np.uint64)
        for j in range(k):
            out = mix(out * _BASE + words[j : j + n])
        return out


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """For each row its distinct k-word shingles in ascending order; with fewer words, the whole
    sequence is the one shingle; without words, none."""
    whole, out = joined(words.hashes, k), []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(whole[a : b - k + 1]))
        else:
            out.append(joined(words.hashes[a:b], b - a) if b > a else np.zeros(0, dtype=np.uint64))
    return out


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and their counts."""
    if counts is None:
        keys, counts = np.unique(keys, return_counts=True)
        return keys, counts.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts.astype(np.int64)
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[starts], np.add.reduceat(counts.astype(np.int64), starts)


def looked_up(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    keys = keys.astype(table.dtype, copy=False)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, table[at] == keys


def merged_counts(keys: np.ndarray, counts: np.ndarray, new: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adds counts of sorted distinct keys to a sorted table."""
    at, known = looked_up(keys, new)
    counts[at[known]] += more[known]
    fresh = new[~known]
    where = np.searchsorted(keys, fresh)
    return np.insert(keys, where, fresh), np.insert(counts, where, more[~known])


class Lookup:
    """A sorted table of keys with a direct-mapped front, in which the weightiest key of a slot
    is found by one comparison; all other keys are found by bisection."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        self.keys = keys
        self._shift = np.uint64(64 - max(8, min(22, int(len(keys)).bit_length() + 1)))
        self._front = np.zeros(1 << int(64 - int(self._shift)), dtype=np.int32)
        order = np.argsort(weights, kind="stable").astype(np.int32)
        self._front[self._slots(keys[order])] = order

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key in the table, and whether it is there."""
        if not len(self.keys):
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        at = self._front[self._slots(keys)]
        known = self.keys[at] == keys
        rest = np.flatnonzero(~known)
        at[rest], known[rest] = looked_up(self.keys, keys[rest])
        return at, known
