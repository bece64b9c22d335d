"""Counting hashed keys over a whole corpus with packed exchanges.

Tasks count the keys of a slice of rows and send one packed array for each
bucket of the key space; a bucket's arrays meet in one task and are summed.
Millions of counts thus travel as a few thousand rows.  A key, however common,
is one entry of each array, so no bucket is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_rows import map_arrow, record, slices
from .text_arrays import merged_counts, summed

#: Bytes of text for each bucket.  A byte gives at most one key of 16 bytes with its count, so a
#: bucket of evenly spread keys is far below the 2 GB of one cell.
BUCKET_BYTES = 32 << 20

PACKED = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
PACKED_SQL = "bucket int, keys binary, counts binary"


def bucket_count(rows: DataFrame, text_column: str = "text") -> int:
    """Buckets for keys counted over the texts of ``rows``: by their bytes, and no fewer than shuffle partitions."""
    size = rows.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


def planes(x: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers byte by byte, all lowest bytes first: zero bytes lie together and compress away."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def packed(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending keys as planes of their steps, and planes of the counts."""
    return planes(np.diff(keys, prepend=np.uint64(0))), planes(counts)


def unpacked(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(from_planes(keys), dtype=np.uint64), from_planes(counts).astype(np.int64)


def packed_rows(keys: np.ndarray, counts: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Sorted keys cut into ranges of the 64-bit key space."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=np.uint64)
    cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    for b, (i, j) in enumerate(zip(cuts, cuts[1:])):
        if j > i:
            yield b, *packed(keys[i:j], counts[i:j])


def partial_tallies(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterable[np.ndarray]], buckets: int, slice_bytes: int = 4 << 20, hold: int = 1_000_000) -> DataFrame:
    """Packed counts of each task.  ``keys_of`` gives arrays of unsigned 64-bit keys of some rows,
    text in their last column; counts are held back until ``hold`` distinct keys have come together."""

    def run(batches):
        keys, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

        def out():
            found = list(packed_rows(keys, counts, buckets))
            if found:
                yield record(PACKED, *zip(*found))

        for batch in batches:
            for part in slices(batch, limit=slice_bytes):
                for new in keys_of(part):
                    keys, counts = merged_counts(keys, counts, *summed(new))
                if len(keys) >= hold:
                    yield from out()
                    keys, counts = keys[:0], counts[:0]
        yield from out()

    return map_arrow(rows, run, PACKED_SQL)


def total_tallies(partial: DataFrame, buckets: int, least: int = 1) -> DataFrame:
    """One packed row for each bucket: keys with a count of ``least`` or more, and their counts."""

    def run(batches):
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            return summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))

        for batch in batches:
            for bucket, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
                parts = held.setdefault(bucket, [])
                parts.append(unpacked(keys, counts))
                if sum(len(k) for k, _ in parts[1:]) > max(1 << 20, len(parts[0][0])):
                    held[bucket] = [merged(parts)]
        for bucket, parts in held.items():
            keys, counts = merged(parts)
            keep = counts >= least
            yield record(PACKED, [bucket], [keys[keep].tobytes()], [counts[keep].astype("<u8").tobytes()])

    return map_arrow(partial.repartitionById(buckets, F.col("bucket")), run, PACKED_SQL)


def count_histogram(totals: DataFrame, largest: int = 1 << 20) -> dict[int, int]:
    """How many keys have each count (counts beyond ``largest`` together); bounded by ``largest``."""
    schema = pa.schema([("count", pa.int64()), ("keys", pa.int64())])

    def run(batches):
        for batch in batches:
            for counts in batch.column(0).to_pylist():
                values, n = np.unique(np.minimum(np.frombuffer(counts, "<u8").astype(np.int64), largest), return_counts=True)
                if len(values):
                    yield record(schema, values, n)

    found = map_arrow(totals.select("counts"), run, "count long, keys long").groupBy("count").sum("keys").collect()
    return {r[0]: r[1] for r in found}


def threshold_for(histogram: dict[int, int], most: int, least: int = 1) -> int:
    """The smallest count from ``least`` on that at most ``most`` keys reach."""
    if sum(n for c, n in histogram.items() if c >= least) <= most:
        return least
    kept, threshold = 0, max(histogram) + 1
    for count in sorted(histogram, reverse=True):
        kept += histogram[count]
        if kept > most:
            break
        threshold = count
    return threshold


def gathered(totals: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (ascending) with a count of ``least`` or more; the caller has bounded their number."""

    def run(batches):
        for batch in batches:
            for bucket, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
                keep = np.frombuffer(counts, "<u8") >= least
                yield record(PACKED, [bucket], [np.frombuffer(keys, "<u8")[keep].tobytes()], [np.frombuffer(counts, "<u8")[keep].tobytes()])

    rows = sorted(map_arrow(totals, run, PACKED_SQL).collect(), key=lambda r: r.bucket)
    keys = [np.frombuffer(r["keys"], "<u8") for r in rows]
    counts = [np.frombuffer(r["counts"], "<u8").astype(np.int64) for r in rows]
    return (np.concatenate(keys), np.concatenate(counts)) if rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def gathered_short(totals: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Like ``gathered`` in 5 bytes a key: the leading 32 bits of the keys, ascending and distinct, and
    the highest count of each, 255 at most."""

    def run(batches):
        for batch in batches:
            for bucket, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
                counts = np.frombuffer(counts, "<u8")
                keep = counts >= least
                keys, counts = (np.frombuffer(keys, "<u8")[keep] >> np.uint64(32)).astype("<u4"), np.minimum(counts[keep], 255).astype("u1")
                starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
                most = np.maximum.reduceat(counts, starts) if len(keys) else counts
                yield record(PACKED, [bucket], [keys[starts].tobytes()], [most.tobytes()])

    rows = sorted(map_arrow(totals, run, PACKED_SQL).collect(), key=lambda r: r.bucket)
    if not rows:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint8)
    keys = np.concatenate([np.frombuffer(r["keys"], "<u4") for r in rows])
    counts = np.concatenate([np.frombuffer(r["counts"], "u1") for r in rows])
    if len(keys) and (keys[1:] == keys[:-1]).any():  # a key cut by the edge of two buckets
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keys, counts = keys[starts], np.maximum.reduceat(counts, starts)
    return keys, counts
