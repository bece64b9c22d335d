"""Arrow helpers for operators that run on batches of rows."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are turned into Python objects at a time.
SLICE_BYTES = 1 << 20
#: Bytes of the batches that Python workers are sent, unless the session says otherwise.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def map_arrow(rows: DataFrame, run: Callable, sql: str) -> DataFrame:
    """``mapInArrow`` in batches of a few MB, after each of which the worker gives back free memory.
    The session's setting of batch bytes is set where it is unset."""
    conf = rows.sparkSession.conf
    if conf.get(_BATCH_SETTING, None) is None:
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))

    def given(batches):
        for batch in batches:
            yield batch
            del batch
            give_back()

    return rows.mapInArrow(lambda batches: run(given(batches)), sql)


def give_back() -> None:
    """Returns to the system what this process has freed."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def slices(batch: pa.RecordBatch, column: int = -1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that ``column`` has about ``limit`` bytes in each part, one row at least."""
    rows = batch.num_rows
    if rows == 0:
        return
    size = batch.column(column).nbytes
    step = max(1, min(rows, int(rows * limit / max(size, 1))))
    for at in range(0, rows, step):
        yield batch.slice(at, step)


def partition_number() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def row_priority(*columns: str):
    """A number from 0 to 1 for the values of each row, whatever files and partitions it lies in."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 52)) / F.lit(float(1 << 52))


def extended(docs: DataFrame, run_columns: list, new_sql: str, schema_new: pa.Schema, values: Callable) -> DataFrame:
    """``docs`` with new columns: ``values`` maps a batch of ``run_columns`` to the new arrays, or to
    them and a mask of the rows to keep.  New columns replace columns of the same name."""
    names = [f.name for f in schema_new]
    kept = [c for c in docs.columns if c.lower() not in names]
    n_kept, n_in = len(kept), len(run_columns)
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    # plain names on the way, as column names may hold dots
    inputs = docs.select(*[F.col(quoted(c)).alias(f"kept_{i}") for i, c in enumerate(kept)], *[c.alias(f"in_{i}") for i, c in enumerate(run_columns)])
    out_names = [f"kept_{i}" for i in range(n_kept)] + names

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                arrays, mask = values(part.select(range(n_kept, n_kept + n_in)))
                made = [pa.array(a, type=f.type) for a, f in zip(arrays, schema_new)]
                whole = pa.RecordBatch.from_arrays([*part.columns[:n_kept], *made], names=out_names)
                yield whole if mask is None else whole.filter(pa.array(mask))

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in inputs.schema.fields[:n_kept]]
    return map_arrow(inputs, run, ", ".join([*fields, new_sql] if new_sql else fields)).toDF(*kept, *names)
