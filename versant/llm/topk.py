"""Exact top-k search: tiled matrix products and tree merging of top lists.

Queries are packed into blocks and all rows into shards, each a matrix of
bounded size.  Every (block, shard) pair is one tile: a matrix product, then a
partial selection of each query's best k.  A task merges the lists of its tiles
as it goes; the tasks' lists are merged by groups and then over groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_rows import map_arrow, partition_number, record
from .shared import Scratch

_MATRIX = pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("number", pa.int32()), ("ids", pa.binary()), ("values", pa.binary())])
_MATRIX_SQL = "dim int, part int, number int, ids binary, values binary"
_BEST = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("part", pa.int32())])
_EXACT = float(1 << 53)
_LONG = 1 << 63


def quantized(vectors: DataFrame, scale: float, id_column: str, vector_column: str) -> DataFrame:
    """vec_id and the components as floor(scale * x); rows that hold a null or non-finite component are left out."""
    v = F.col("vector")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    sound = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    return sound.select("vec_id", F.transform(v, lambda x: F.floor(x * F.lit(scale)).cast("double")).alias("vector"))


def matrices(rows: DataFrame, tile_bytes: int = 4 << 20) -> DataFrame:
    """Packs vectors of one dimension together, ``tile_bytes`` of doubles a row at most, without a shuffle."""

    def run(batches):
        part, number, held = partition_number(), 0, {}

        def packed(dim: int):
            nonlocal number
            ids, values = zip(*held.pop(dim))
            number += 1
            return record(_MATRIX, [dim], [part], [number], [np.concatenate(ids).tobytes()], [np.concatenate(values).tobytes()])

        for batch in batches:
            column = batch.column(1)
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy()
            starts = np.cumsum(sizes) - sizes
            ids = batch.column(0).to_numpy()
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                step = max(1, tile_bytes // (8 * max(dim, 1)))
                for k in range(0, len(at), step):
                    chosen = at[k : k + step]
                    values = flat[(starts[chosen, None] + np.arange(dim)).ravel()].astype("<f8")
                    held.setdefault(dim, []).append((ids[chosen].astype("<i8"), values))
                    if sum(len(i) for i, _ in held[dim]) >= step:
                        yield packed(dim)
        for dim in list(held):
            yield packed(dim)

    return map_arrow(rows, run, _MATRIX_SQL)


def products(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers; beyond 64 bits the nearest long."""
    if not queries.shape[1]:
        return np.zeros((len(queries), len(shard)), dtype=np.int64)
    most = np.abs(queries).max() * np.abs(shard).max() * queries.shape[1]
    if most < _EXACT:
        return (queries @ shard.T).astype(np.int64)
    a, b = (np.array([[int(x) for x in row] for row in m], dtype=object) for m in (queries, shard))
    return np.clip(a @ b.T, -_LONG, _LONG - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k highest scores; ties go to smaller ids."""
    width = scores.shape[1]
    if width > k:
        edge = np.partition(scores, width - k, axis=1)[:, width - k]
        row, col = np.nonzero(scores >= edge[:, None])
    else:
        row, col = (x.ravel() for x in np.indices(scores.shape))
    order = np.lexsort((ids[col], ~scores[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    return row[keep], col[keep]


def top_k(vectors: DataFrame, query_every: int, k: int = 5, scale: float = 256.0, spread: int = 16, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id is divisible by ``query_every``
    the k rows with the highest integer inner product, all if there are fewer, ties to the smaller id.

    Rows with the query's id are not its candidates.  Null ids, null vectors and vectors that hold
    null or non-finite components take no part; vectors of another dimension are no candidates; a
    repeated row is a candidate as often as it occurs; a query id is answered once, by the smallest
    of its vectors if there are several.  Extra columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    rows = quantized(vectors, scale, id_column, vector_column)
    shards = scratch.table(matrices(rows), "shards")
    chosen = rows.filter(F.pmod("vec_id", F.lit(query_every)) == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    blocks = scratch.table(matrices(chosen).select("dim", "part", "number", F.col("ids").alias("query_ids"), F.col("values").alias("query_values")), "blocks")

    def run(batches):
        lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for dim, ids, values, query_ids, query_values in zip(*(c.to_pylist() for c in batch.columns)):
                ids, query_ids = np.frombuffer(ids, "<i8"), np.frombuffer(query_ids, "<i8")
                scores = products(np.frombuffer(query_values, "<f8").reshape(len(query_ids), dim), np.frombuffer(values, "<f8").reshape(len(ids), dim))
                own = np.flatnonzero(np.isin(query_ids, ids))
                for q in own.tolist():
                    scores[q, ids == query_ids[q]] = -_LONG
                row, col = best(scores, ids, k)
                for q, a, b in zip(query_ids.tolist(), np.searchsorted(row, np.arange(len(query_ids))).tolist(), np.searchsorted(row, np.arange(len(query_ids)), "right").tolist()):
                    found, ranked = ids[col[a:b]], scores[row[a:b], col[a:b]]
                    found, ranked = found[found != q], ranked[found != q]
                    if q in lists:
                        found, ranked = np.append(lists[q][0], found), np.append(lists[q][1], ranked)
                        order = np.lexsort((found, ~ranked))[:k]
                        found, ranked = found[order], ranked[order]
                    lists[q] = found, ranked
                if len(lists) > 200_000:
                    yield from flushed(lists)
        yield from flushed(lists)

    def flushed(lists: dict):
        if lists:
            sizes = [len(f) for f, _ in lists.values()]
            columns = np.repeat(list(lists), sizes), np.concatenate([f for f, _ in lists.values()]), np.concatenate([s for _, s in lists.values()])
            yield record(_BEST, *columns, [partition_number() % spread] * sum(sizes))
            lists.clear()

    # every shard meets every block on a grid of tasks: shards are copied to its columns and blocks to its
    # rows, with the sides in the proportion that moves the fewest bytes
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    across = max(1, min(tasks, round((tasks * blocks.count() / max(shards.count(), 1)) ** 0.5)))
    down = -(-tasks // across)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = shards.withColumn("down", F.pmod(F.hash("part", "number"), F.lit(down))).withColumn("across", every(across))
    right = blocks.withColumn("across", F.pmod(F.hash("part", "number"), F.lit(across))).withColumn("down", every(down)).drop("part", "number")
    tiles = left.join(right, ["dim", "down", "across"]).select("dim", "ids", "values", "query_ids", "query_values")
    lists = map_arrow(tiles, run, "query_id long, vec_id long, score long, part int")
    for keys in (["query_id", "part"], ["query_id"]):
        w = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return lists.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
