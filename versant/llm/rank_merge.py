"""Byte-pair token counts by rank-synchronous merging of ragged arrays.

The distinct pre-tokens of a batch lie end to end in one array of symbols.  In
each round every pre-token finds its pair of lowest rank, and all of these
pairs are merged at once; pre-tokens without a known pair leave.  What a
pre-token has left at that point is its number of tokens.

Long pre-tokens would need very many such rounds.  Their symbols are linked to
their neighbours instead, and the places of pairs are filed by rank: a round
takes the lowest rank of all, merges all its places at once, and looks up only
the pairs that this made.
"""

from __future__ import annotations

import gc
import heapq
import json
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_rows import map_arrow, record, slices
from .chunk_tokens import byte_letters, cut_before_spaces
from .text_arrays import looked_up

#: White space as Unicode defines it, and the published pattern spelt with it (fixed values).
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"

_NONE = np.int64(1) << 40


class RankMerger:
    """The merges of a byte-level tokenizers file as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        vocabulary = model["vocab"]
        self.specials = [t["content"] for t in whole["added_tokens"]]
        self.width = max(vocabulary.values()) + 1
        self.first = np.array([vocabulary[c] for c in byte_letters()], dtype=np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocabulary[a] * self.width + vocabulary[b] for a, b in merges], dtype=np.int64)
        made = np.array([vocabulary[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made, self.made_by_rank = keys[order], order.astype(np.int64), made[order], made

    def counts(self, words: list[bytes], long_from: int = 512) -> np.ndarray:
        """Tokens of each pre-token."""
        out = np.zeros(len(words), dtype=np.int64)
        size = np.array([len(w) for w in words], dtype=np.int64)
        for chosen, count in ((np.flatnonzero(size < long_from), self._by_rounds), (np.flatnonzero(size >= long_from), self._by_links)):
            if len(chosen):
                out[chosen] = count([words[i] for i in chosen])
        return out

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each pair among the merges, and whether it is one."""
        return looked_up(self.keys, left.astype(np.int64) * self.width + right)

    def _by_links(self, words: list[bytes]) -> np.ndarray:
        symbols = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)].astype(np.int32)
        ends = np.cumsum([len(w) for w in words])
        n = len(symbols)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1] = before[np.append(0, ends[:-1])] = -1
        current = np.full(n, -1, dtype=np.int32)  # rank of the pair that begins at a place
        alive = np.ones(n, dtype=bool)
        filed: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def file(places: np.ndarray) -> None:
            """Looks up the pairs that begin at these places, and files them."""
            places = places[after[places] >= 0]
            at, known = self._pairs(symbols[places], symbols[after[places]])
            current[places] = np.where(known, self.ranks[at], -1)
            places, found = places[known], self.ranks[at[known]]
            order = np.argsort(found, kind="stable")
            places, found = places[order], found[order]
            starts = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else found
            cuts = [*starts.tolist(), len(found)]
            for rank, a, b in zip(found[starts].tolist(), cuts, cuts[1:]):
                if rank not in filed:
                    filed[rank] = []
                    heapq.heappush(ranks, rank)
                filed[rank].append(places[a:b])

        for a in range(0, n, 1 << 20):
            file(np.arange(a, min(a + (1 << 20), n), dtype=np.int32))
        while ranks:
            rank = heapq.heappop(ranks)
            lists = filed.pop(rank)
            places = np.unique(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])
            places = places[alive[places] & (current[places] == rank)]
            if not len(places):
                continue
            # of pairs that overlap (one symbol again and again) every second, from the left
            fresh = np.append(True, after[places[:-1]] != places[1:])
            turn = np.arange(len(places))
            places = places[(turn - np.maximum.accumulate(np.where(fresh, turn, 0))) % 2 == 0]
            gone = after[places]
            symbols[places] = self.made_by_rank[rank]
            alive[gone] = False
            beyond = after[gone]
            after[places] = beyond
            before[beyond[beyond >= 0]] = places[beyond >= 0]
            current[places] = -1
            left = before[places]
            file(np.unique(np.concatenate([places, left[left >= 0]])))
        return np.add.reduceat(alive.astype(np.int64), np.append(0, ends[:-1]))

    def _by_rounds(self, words: list[bytes]) -> np.ndarray:
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        out = lengths.copy()
        symbols = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        while len(symbols) > 1:
            at, known = self._pairs(symbols[:-1], symbols[1:])
            known &= owner[:-1] == owner[1:]
            rank = np.append(np.where(known, self.ranks[at], _NONE), _NONE)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lengths = np.diff(np.append(starts, len(owner)))
            lowest = np.minimum.reduceat(rank, starts)
            out[owner[starts]] = lengths
            if not (going := lowest < _NONE).any():
                break
            hit = np.flatnonzero((rank == np.repeat(lowest, lengths)) & (rank < _NONE))
            # of pairs that overlap (one symbol again and again) every second, from the left
            fresh = np.append(True, np.diff(hit) > 1)
            run = np.arange(len(hit)) - np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[run % 2 == 0]
            symbols[hit] = self.made[at[hit]]
            keep = np.repeat(going, lengths)
            keep[hit + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return out


class _Counts(dict):
    """piece (after a space) -> tokens; pieces that are missing count 0 and are noted."""

    def __init__(self):
        super().__init__()
        self.pending: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.pending.append(piece)
        return 0


class TokenCounter:
    """Counts for whole texts; counts of pieces and pre-tokens are kept up to a bound."""

    def __init__(self, path: str, capacity: int = 700_000, longest: int = 64):
        self._merger = RankMerger(path)
        self._pattern = regex.compile(_PATTERN)
        self._special = regex.compile("|".join(map(regex.escape, self._merger.specials)) or r"(?!)")
        self._pieces, self._words = _Counts(), {}
        self._capacity, self._longest = capacity, longest

    def _split(self, piece: str) -> tuple[int, list[str]]:
        """How many special strings, and the pre-tokens between them."""
        if "<" not in piece:
            return 0, self._pattern.findall(piece)
        parts = self._special.split(piece)
        return len(parts) - 1, [w for p in parts for w in self._pattern.findall(p)]

    def _resolve(self, pieces: set[str]) -> dict[str, int]:
        split = {p: self._split(p) for p in pieces}
        words = {w for _, found in split.values() for w in found}
        known = {w: self._words[w] for w in words if w in self._words}
        new = [w for w in words if w not in known]
        known.update(zip(new, self._merger.counts([w.encode() for w in new]).tolist()))
        if len(self._words) + len(new) > self._capacity:
            self._words.clear()
        self._words.update((w, known[w]) for w in new if len(w) <= self._longest)
        return {p: n + sum([known[w] for w in found]) for p, (n, found) in split.items()}

    def __call__(self, texts: list[str | None]) -> list[int]:
        gc.disable()
        try:
            totals, owed, cache = [], [], self._pieces
            for text in texts:
                if not text:
                    totals.append(0)
                    owed.append([])
                    continue
                first, *rest = cut_before_spaces(text)
                cache.pending = []
                total = sum(itemgetter(*rest)(cache)) if len(rest) > 1 else sum([cache[p] for p in rest])
                totals.append(total)
                owed.append([first, *[" " + p for p in cache.pending]])
            found = self._resolve({p for pieces in owed for p in pieces})
            for i, pieces in enumerate(owed):
                totals[i] += sum([found[p] for p in pieces])
            if len(cache) + len(found) > self._capacity:
                cache.clear()
            cache.update((p[1:], n) for p, n in found.items() if p[:1] == " " and len(p) <= self._longest)
            return totals
        finally:
            gc.enable()


_LOADED: dict[str, TokenCounter] = {}
_COUNTED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def token_counts(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of each whole text, by the byte-level vocabulary file.

    Special strings inside a text count as one token each, as the library has it by default.
    A null or empty text has no bytes and no tokens; a null id stays null; repeated rows are
    counted each; extra columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        if tokenizer not in _LOADED:
            _LOADED[tokenizer] = TokenCounter(tokenizer)
        count = _LOADED[tokenizer]
        for batch in batches:
            for rows in slices(batch, limit=4 << 20):
                yield record(_COUNTED, rows.column(0), rows.column(1), count(rows.column(2).to_pylist()))

    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return map_arrow(rows, run, "doc_id long, n_bytes long, n_tokens long")
