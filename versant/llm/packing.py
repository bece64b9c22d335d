"""Packing documents into fixed windows of token ids: concatenate and cut.

Pass one encodes each document, adds the end id and writes the ids beside the
document's place in its partition (a running sum).  Prefix sums over the
partitions' totals (one number for each partition) turn that into a place in
the one long sequence of all documents.  Pass two cuts that sequence at
multiples of the window, so a document lying across a border leaves a piece on
either side.  Neither pass shuffles a row, and only the very last window may
be short.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_rows import map_arrow, partition_number, record, slices
from .chunk_tokens import text_ids
from .shared import Scratch

_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n", pa.int64()), ("part", pa.int32()), ("before", pa.int64())])
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, id_column: str, text_column: str) -> DataFrame:
    """Rows (doc_id, ids, n, part, before); ids are little-endian unsigned 16-bit or, beyond that, 32-bit."""

    def run(batches):
        encode, part, before = text_ids(tokenizer), partition_number(), 0
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for rows in slices(batch):
                found = [x + end for x in encode.batch(rows.column(1).to_pylist())]
                n = np.array([len(x) // 4 for x in found], dtype=np.int64)
                starts = before + np.cumsum(n) - n
                before += int(n.sum())
                narrow = [np.frombuffer(x, "<u4") for x in found]
                narrow = [x.astype("<u2").tobytes() if x.max() < 65536 else x.tobytes() for x in narrow]
                yield record(_ENCODED, rows.column(0), narrow, n, [part] * len(n), starts)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, ids binary, n long, part int, before long")


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each piece of a document: doc_id, start (ids of the document before the piece),
    length, doc_tokens (with the end id), sequence_id, offset (place in the sequence) and ids
    (binary, little-endian unsigned 32-bit).

    A null or empty text is the end id alone.  A null id stays null; a repeated row is packed as
    often as it occurs; extra columns are ignored.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    encoded = scratch.table(encode_documents(docs, tokenizer, end_id, id_column, text_column), "encoded")
    totals = {r.part: r.total for r in encoded.groupBy("part").agg(F.sum("n").alias("total")).collect()}
    size = max(totals, default=-1) + 1
    bases = [0, *accumulate(totals.get(p, 0) for p in range(size))]
    return cut(encoded, bases, window)


def cut(encoded: DataFrame, bases: list[int], window: int) -> DataFrame:
    """bases: the ids before each partition of pass one, one number a partition."""
    shared = encoded.sparkSession.sparkContext.broadcast(bases)

    def run(batches):
        base = shared.value
        for batch in batches:
            for rows in slices(batch, 1):
                out = [[] for _ in _PIECES]
                for doc, ids, n, part, before in zip(*(c.to_pylist() for c in rows.columns)):
                    ids = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                    at, start = base[part] + before, 0
                    while start < n:
                        sequence, offset = divmod(at + start, window)
                        length = min(window - offset, n - start)
                        for column, value in zip(out, (doc, start, length, n, sequence, offset, ids[start : start + length].tobytes())):
                            column.append(value)
                        start += length
                yield record(_PIECES, *out)

    columns = encoded.select("doc_id", "ids", "n", "part", "before")
    return map_arrow(columns, run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
