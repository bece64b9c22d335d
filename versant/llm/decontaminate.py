"""Benchmark decontamination: MinHash containment search in size partitions, verified exactly.

Test items are short and documents long, so the similarity of an item and a
whole document says little.  Items are partitioned by their number of shingles
(powers of two); for each partition a document is cut into windows of twice
the partition's largest size that overlap by half, so an item's copy lies
whole in some window of like size.  Item and window are candidates when one of
``permutations`` minima agrees (bands of one row).  A window without a shingle
of any item cannot agree and is passed over, which spares almost all of them.
Candidates are then decided by exact containment of the item's shingles in the
whole document.

The items' shingles are shared with all tasks in blocks of a bounded number of
items, one pass over the documents for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_rows import extended, map_arrow, record, slices
from .text_arrays import Words, bytes_of, joined, looked_up, mix

_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("contained", pa.int64()), ("item_shingles", pa.int64())])
_SQL = "doc_id long, item_id long, contained long, item_shingles long"

#: ASCII letters in lower case, digits and all bytes beyond ASCII stay; others are space.
_PLAIN = np.full(256, 32, dtype=np.uint8)
_PLAIN[128:] = np.arange(128, 256)
_PLAIN[48:58] = np.arange(48, 58)
_PLAIN[97:123] = _PLAIN[65:91] = np.arange(97, 123)


def plain_words(column: pa.Array) -> Words:
    """Words without regard to case or punctuation."""
    raw, places = bytes_of(column)
    text = pa.StringArray.from_buffers(len(column), pa.py_buffer(places.astype(np.int32)), pa.py_buffer(_PLAIN[raw])) if len(raw) else pa.array([""] * len(column), pa.string())
    return Words(text)


class ItemIndex:
    """Items of one block: shingle sets by shingle length, minima by size partition."""

    def __init__(self, items: list[tuple[int, np.ndarray, int]], permutations: int):
        self.items = items  # (item id, ascending shingles, words in a shingle)
        self.permutations = permutations
        self._fronts: dict[int, np.ndarray] = {}
        self.lengths = sorted({k for _, _, k in items})
        self.shingles = {k: np.unique(np.concatenate([s for _, s, n in items if n == k])) for k in self.lengths}
        self.partitions: dict[tuple[int, int], dict] = {}
        for number, (_, s, k) in enumerate(items):
            size = 1 << max(0, int(len(s) - 1).bit_length())
            part = self.partitions.setdefault((k, size), {"minima": []})
            part["minima"] += [(p, int(m), number) for p, m in enumerate(minima(s, permutations))]
        for part in self.partitions.values():
            part["keys"] = np.array([key(p, m) for p, m, _ in part["minima"]], dtype=np.uint64)
            order = np.argsort(part["keys"], kind="stable")
            part["keys"], part["numbers"] = part["keys"][order], np.array([n for _, _, n in part["minima"]])[order]

    def front(self, k: int) -> np.ndarray:
        """Which of the 2^20 leading parts of a hash some item's shingle has; made once in a worker."""
        if k not in self._fronts:
            self._fronts[k] = np.zeros(1 << 20, dtype=bool)
            self._fronts[k][(self.shingles[k] >> np.uint64(44)).astype(np.int64)] = True
        return self._fronts[k]

    def candidates(self, shingles: np.ndarray, hits: np.ndarray, k: int) -> set[int]:
        """Numbers of items that share a minimum with a window of a document; ``hits``: places of
        shingles that some item has."""
        found: set[int] = set()
        for (length, size), part in self.partitions.items():
            if length != k:
                continue
            for w in np.unique(np.concatenate([hits // size, hits // size - 1])).tolist():
                if w < 0:
                    continue
                window = shingles[w * size : (w + 2) * size]
                keys = np.array([key(p, m) for p, m in enumerate(minima(window, self.permutations))], dtype=np.uint64)
                a, b = np.searchsorted(part["keys"], keys), np.searchsorted(part["keys"], keys, "right")
                for x, y in zip(a.tolist(), b.tolist()):
                    found.update(part["numbers"][x:y].tolist())
        return found


def minima(shingles: np.ndarray, permutations: int) -> list[int]:
    salts = mix(np.arange(101, 101 + permutations, dtype=np.uint64))
    return [int(x) for x in mix(shingles[None, :] ^ salts[:, None]).min(axis=1)]


def key(permutation: int, minimum: int) -> int:
    """A band's key: the minimum with its permutation's number."""
    return (minimum * 64 + permutation) & 0xFFFFFFFFFFFFFFFF


def item_blocks(benchmark: DataFrame, k: int, most: int, id_column: str, text_column: str) -> Iterator[list[tuple[int, np.ndarray, int]]]:
    """Items with their shingles, ``most`` at a time; items without words are left out."""
    rows = benchmark.select(F.col(id_column).cast("long").alias("item_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")).filter("item_id is not null")
    block = []
    for row in rows.toLocalIterator():
        words = plain_words(pa.array([row.text])).hashes
        if len(words):
            n = min(k, len(words))
            block.append((row.item_id, np.unique(joined(words, n)), n))
        if len(block) >= most:
            yield block
            block = []
    if block:
        yield block


def contaminations(docs: DataFrame, benchmark: DataFrame, k: int = 5, num: int = 80, den: int = 100, permutations: int = 32, block_items: int = 50_000, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """doc_id, item_id, contained, item_shingles: the pairs in which the document contains at least
    num / den of the item's k-word shingles.

    Words are runs of ASCII letters and digits and of bytes beyond ASCII, A-Z in lower case; an item
    of fewer than k words is one shingle of its length.  Null ids, null texts and texts without
    words give no pair; repeated documents give a pair each, repeated items too; extra columns are
    ignored; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).filter("doc_id is not null and text is not null")
    out = spark.createDataFrame([], _SQL)
    for n, block in enumerate(item_blocks(benchmark, k, block_items, item_column, item_text_column)):
        found = _search(rows, ItemIndex(block, permutations), num, den)
        out = out.unionByName(found) if n else found
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, num: int = 80, den: int = 100, permutations: int = 32, block_items: int = 50_000, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """``docs`` without the rows that contain an item, as ``contaminations`` has it; rows with a null
    text or id are judged by their text alone.  Without items ``docs`` comes back as it is."""
    for block in item_blocks(benchmark, k, block_items, item_column, item_text_column):
        shared = docs.sparkSession.sparkContext.broadcast(ItemIndex(block, permutations))

        def values(given, shared=shared):
            hit = {row for row, *_ in found_pairs(shared.value, given.column(0), num, den)}
            return (), [r not in hit for r in range(given.num_rows)]

        docs = extended(docs, [F.coalesce(F.col(text_column).cast("string"), F.lit(""))], "", pa.schema([]), values)
    return docs


def found_pairs(index: ItemIndex, column: pa.Array, num: int, den: int) -> list[tuple[int, int, int, int]]:
    """(row, item id, contained, shingles of the item) of the contained items of each text."""
    words, out = plain_words(column), []
    for k in index.lengths:
        shingles = joined(words.hashes, k)
        maybe = np.flatnonzero(index.front(k)[(shingles >> np.uint64(44)).astype(np.int64)])
        at, known = looked_up(index.shingles[k], shingles[maybe])
        maybe = maybe[known]
        owner = np.searchsorted(words.first, maybe, "right") - 1
        inside = maybe + k <= words.first[owner + 1]
        maybe, owner = maybe[inside], owner[inside]
        for row in np.unique(owner).tolist():
            first, last = int(words.first[row]), int(words.first[row + 1]) - k + 1
            own = shingles[first:last]
            hits = maybe[owner == row] - first
            for number in sorted(index.candidates(own, hits, k)):
                item, wanted, _ = index.items[number]
                contained = int(np.isin(wanted, own[hits]).sum())
                if contained * den >= num * len(wanted):
                    out.append((row, item, contained, len(wanted)))
    return out


def _search(rows: DataFrame, index: ItemIndex, num: int, den: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                docs = part.column(0).to_pylist()
                out = [(docs[row], *rest) for row, *rest in found_pairs(shared.value, part.column(1), num, den)]
                if out:
                    yield record(_FOUND, *zip(*out))

    return map_arrow(rows, run, _SQL)
