"""Exact Jaccard self-join of documents on word shingles: size-aware, heavy and light.

Documents with equal shingle sets are one class from the start.  Linked classes
are found through keys that two linked sets must share:

* Light sets, those of fewer shingles than the boundary, enumerate subsets of
  fixed size.  Sets of sizes a and b that link have at least
  c = ceil(t (a + b) / (1 + t)) shingles in common, so they share one of their
  subsets of that size.
* Heavy sets are looked up in inverted lists.  Under any common order of all
  shingles two linked sets share one of their first n - ceil(t n) + 1.  The
  order is by number of documents, rarest first, as far as counts are at hand:
  all documents are counted for a fixed part of the hash space, and the
  commonest shingles of it, up to a stated number, are known to every task
  (32 bits of their hash and a count up to 255; a chance meeting of two costs work, never a link).
* The boundary is the size at which the measured cost of the two ways is least.
  Sets just below it do both, so that they meet heavy partners.

Members of a list form a star; stars that overlap form groups; all pairs that
can link lie in one group.  Large groups are cut by set size into blocks of a
bounded number of rows; every pair of blocks whose sizes can link is a tile of
its own, so a group of any size is spread over many tasks.  This is done twice.
First only sizes and parity bitmaps move, which bound the overlap of two sets
from above (a matrix product over +1 and -1, for chunks of rows of like size);
the pairs that pass make smaller groups.  Then the sets of those move, pairs
that pass again are compared shingle by shingle, and pairs already connected
are skipped.
A tile gives a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow_rows import map_arrow, record, slices
from .components import connected_components
from .shared import Scratch, hot_join
from .tallies import PACKED, PACKED_SQL, bucket_count, count_histogram, gathered, gathered_short, packed, packed_rows, threshold_for, total_tallies
from .text_arrays import Lookup, Words, merged_counts, mix, shingle_sets, summed

#: Part of the hash space of shingles, from 0, for which documents are counted.
_COUNTED = np.uint64(1 << 62)
#: Place in the order of shingles that aren't counted.
_UNCOUNTED = 8

_POSTED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("posts", pa.list_(pa.int64())), ("parities", pa.binary())])
_POSTED_SQL = "doc_id long, n long, key binary, posts array<long>, parities binary"
_SETS = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("shingles", pa.binary())])
_SETS_SQL = "doc_id long, key binary, shingles binary"
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_BITS = pa.schema([("bits", pa.binary())])
#: Most bits of the filter of group members, whatever their number.
_MOST_BITS = 1 << 27
#: Most bits of a set's parities.
_MOST_PARITIES = 1 << 15
#: Sets of this size or more can't be light, as their subsets are too many.
_LIGHTEST = 64
#: In place of a bucket's number: counts of set sizes.
_SIZES = -1


def least_overlap(a: int, b: int, num: int, den: int) -> int:
    """Fewest common shingles with which sets of sizes a and b link: common / union >= num / den."""
    return -(-num * (a + b) // (num + den))


def subset_sizes(n: int, num: int, den: int) -> list[int]:
    """Sizes of the subsets by which a light set of n shingles meets its partners."""
    partners = range(-(-num * n // den), n * den // num + 1)
    return sorted({least_overlap(n, m, num, den) for m in partners})


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def boundary(sizes: dict[int, int], list_cost: float, num: int, den: int, largest: int = _LIGHTEST) -> int:
    """Sets below the returned size are light: the size with the least total of subsets to enumerate
    and list entries to scan, list_cost for each of a heavy set's lists."""
    light = lambda n: sum(comb(n, c) for c in subset_sizes(n, num, den))
    heavy = lambda n: prefix_length(n, num, den) * list_cost
    best, least, saved = 1, 0.0, 0.0
    for n in range(1, largest):
        saved += sizes.get(n, 0) * (light(n) - heavy(n))
        if saved < least:
            best, least = n + 1, saved
    return best


def subset_keys(shingles: np.ndarray, num: int, den: int) -> list[int]:
    """A key for each subset of each size: the wrapped sum of its mixed shingles, and its size."""
    n, mixed = len(shingles), [int(x) for x in mix(shingles)]
    total, out = sum(mixed), []
    for c in subset_sizes(n, num, den):
        if c > n:
            continue
        salt = int(mix(np.array([c + 1], dtype=np.uint64))[0])
        for left_out in combinations(mixed, n - c):
            out.append((total - sum(left_out) ^ salt) & 0xFFFFFFFFFFFFFFFF)
    return out


def scan(docs: DataFrame, k: int, buckets: int, hold: int = 1_000_000) -> DataFrame:
    """First pass: packed counts of the documents that hold each shingle of the counted part of the hash
    space, and under bucket ``_SIZES`` packed counts of the set sizes up to ``_LIGHTEST``."""

    def run(batches):
        keys, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        sizes = np.zeros(_LIGHTEST + 1, dtype=np.int64)

        def out():
            found = list(packed_rows(keys << np.uint64(2), counts, buckets))
            if found:
                yield record(PACKED, *zip(*found))

        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(Words(part.column(0)), k)
                sizes += np.bincount(np.minimum([len(s) for s in sets], _LIGHTEST), minlength=_LIGHTEST + 1)
                counted = np.concatenate([s[: np.searchsorted(s, _COUNTED)] for s in sets])
                keys, counts = merged_counts(keys, counts, *summed(counted))
                if len(keys) >= hold:
                    yield from out()
                    keys, counts = keys[:0], counts[:0]
        yield from out()
        yield record(PACKED, [_SIZES], *([x] for x in packed(np.arange(_LIGHTEST + 1, dtype=np.uint64), sizes)))

    return map_arrow(docs.select("text"), run, PACKED_SQL)


def post(docs: DataFrame, k: int, num: int, den: int, light_below: int, known: tuple[np.ndarray, np.ndarray], known_from: int) -> DataFrame:
    """Second pass: number of shingles, key of the set, posts (the keys by which each document meets
    others) and the bitmap of parities.  Shingles that are counted and have but one document are in no list of two."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def keys_of(shingles: np.ndarray, find: Lookup, seen: np.ndarray) -> list[int]:
        n, out = len(shingles), []
        if n < light_below:
            out += subset_keys(shingles, num, den)
        if n * den >= light_below * num:
            counted = int(np.searchsorted(shingles, _COUNTED))
            rank = np.full(n, _UNCOUNTED, dtype=np.int64)
            at, found = find((shingles[:counted] >> np.uint64(30)).astype(np.uint32))
            rank[:counted] = np.where(found, seen[at], 1) if len(seen) else 1
            first = np.argsort(rank, kind="stable")[: prefix_length(n, num, den)]
            if known_from <= 2:
                first = first[(rank[first] > 1) | (first >= counted)]
            out += shingles[first].tolist()
        return out

    def run(batches):
        table, seen = shared.value
        find = Lookup(table, seen)
        for batch in batches:
            for part in slices(batch):
                sets, ids = shingle_sets(Words(part.column(1)), k), part.column(0).to_pylist()
                posts = [np.array(keys_of(s, find, seen), dtype=np.uint64).view(np.int64) if doc is not None and len(s) else None for doc, s in zip(ids, sets)]
                bitmaps = [parities(s, num, den).tobytes() if p is not None and len(p) else None for s, p in zip(sets, posts)]
                yield record(_POSTED, ids, [len(s) for s in sets], [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], posts, bitmaps)

    return map_arrow(docs, run, _POSTED_SQL)


def member_filter(members: DataFrame, column: str) -> np.ndarray:
    """A bitmap of hashed ids, 64 bits for each up to a fixed size; it lets through all members and,
    the more there are, the more others, which the join that follows sorts out."""
    bits = 1 << 16
    while bits < min(64 * members.count(), _MOST_BITS):
        bits *= 2

    def run(batches):
        mine = np.zeros(bits, dtype=bool)
        for batch in batches:
            mine[_places(batch.column(0).to_numpy(), bits)] = True
        yield record(_BITS, [zlib.compress(np.packbits(mine).tobytes(), 1)])

    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in map_arrow(members.select(column).coalesce(32), run, "bits binary").toLocalIterator():
        out |= np.frombuffer(zlib.decompress(row.bits), np.uint8)
    return out


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def sets_of(docs: DataFrame, k: int, members: np.ndarray) -> DataFrame:
    """Third pass: the sets of the documents that the filter lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(members)

    def run(batches):
        chosen = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for part in slices(batch):
                ids = part.column(0)
                may = chosen[_places(ids.fill_null(0).to_numpy(), len(chosen))] & ids.is_valid().to_numpy(zero_copy_only=False)
                part = part.filter(pa.array(may))
                if part.num_rows:
                    sets = shingle_sets(Words(part.column(1)), k)
                    yield record(_SETS, part.column(0), [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [s.tobytes() for s in sets])

    return map_arrow(docs.select("doc_id", "text"), run, _SETS_SQL)


class Forest:
    """Union by smaller number, over 0..n-1."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up


def parities(shingles: np.ndarray, num: int, den: int) -> np.ndarray:
    """A packed bitmap: for each value of the lowest bits of a shingle, whether an odd number of shingles has
    it.  Two bitmaps differ in no more places than there are shingles that only one of the two sets has.
    There are 8 bits or more for each shingle by which a linked set may differ, up to a fixed number."""
    bits = 256
    while bits < min(16 * len(shingles) * (den - num) // (den + num), _MOST_PARITIES):
        bits *= 2
    return np.packbits(np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1)


class Parities:
    """Rows by size, in chunks of a bounded number of bits; the bitmaps of a chunk are folded to its least width."""

    def __init__(self, bitmaps: list[np.ndarray], sizes: np.ndarray, rows: np.ndarray, chunk: int):
        rows = rows[np.argsort(sizes[rows], kind="stable")]
        step = max(1, min(chunk, (1 << 22) // (8 * len(bitmaps[rows[-1]]))))
        self.rows = [rows[i : i + step] for i in range(0, len(rows), step)]
        self.least, self.most = [int(sizes[r[0]]) for r in self.rows], [int(sizes[r[-1]]) for r in self.rows]
        self.widths = [min(len(bitmaps[r]) for r in part) for part in self.rows]
        self._packed = [np.stack([_folded(bitmaps[r][None, :], w)[0] for r in part]) for part, w in zip(self.rows, self.widths)]

    def signs(self, n: int, width: int) -> np.ndarray:
        """+1 and -1 for the rows of chunk ``n``, folded to so many bytes of bits."""
        return np.unpackbits(_folded(self._packed[n], width), axis=1).astype(np.float32) * 2 - 1


def _folded(packed: np.ndarray, width: int) -> np.ndarray:
    return packed if packed.shape[1] == width else np.bitwise_xor.reduce(packed.reshape(len(packed), -1, width), axis=1)


def possible_pairs(mine: Parities, theirs: Parities, sizes: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that may link as far as sizes and parities tell, chunk by chunk; within one side each pair once."""
    for i, a in enumerate(mine.rows):
        for j in range(i if mine is theirs else 0, len(theirs.rows)):
            b = theirs.rows[j]
            if mine.most[i] * den < theirs.least[j] * num or theirs.most[j] * den < mine.least[i] * num:
                continue
            width = min(mine.widths[i], theirs.widths[j])
            apart = (8 * width - mine.signs(i, width) @ theirs.signs(j, width).T) / 2  # no more than the shingles that only one of the two has
            one, other = sizes[a][:, None], sizes[b][None, :]
            able = (apart * (num + den) <= (one + other) * (den - num)) & (np.minimum(one, other) * den >= np.maximum(one, other) * num)
            x, y = np.nonzero(able)
            x, y = a[x], b[y]
            if mine is theirs and i == j:
                x, y = x[x < y], y[x < y]
            yield x, y


def spanning_pairs(n: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]], linked: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Spanning forest over 0..n-1 of those pairs that are ``linked``, which connected pairs aren't asked for."""
    forest, links = Forest(n), []
    for x, y in pairs:
        while len(x):
            roots = forest.roots()
            open_ = roots[x] != roots[y]
            x, y = x[open_], y[open_]
            # one partner of each row, then look again which pairs are still open
            _, now = np.unique(x, return_index=True)
            for p, q in zip(x[now].tolist(), y[now].tolist()):
                if forest.find(p) != forest.find(q) and linked(p, q):
                    forest.join(p, q)
                    links.append((p, q))
            rest = np.ones(len(x), dtype=bool)
            rest[now] = False
            x, y = x[rest], y[rest]
    return links


def linking_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, num: int, den: int, chunk: int = 512) -> list[tuple[int, int]]:
    """Spanning forest of the links between rows of ``left`` and ``right``, or within ``left``."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)

    def linked(p: int, q: int) -> bool:
        common = sizes[p] + sizes[q] - len(np.union1d(sets[p], sets[q]))
        return den * common >= num * (sizes[p] + sizes[q] - common)

    return _between([parities(s, num, den) for s in sets], sizes, left, right, num, den, chunk, linked)


def _between(bitmaps, sizes, left, right, num, den, chunk, linked) -> list[tuple[int, int]]:
    mine = Parities(bitmaps, sizes, left, chunk)
    theirs = mine if right is None else Parities(bitmaps, sizes, right, chunk)
    return spanning_pairs(len(sizes), possible_pairs(mine, theirs, sizes, num, den), linked)


def near_pairs(bitmaps: list[np.ndarray], sizes: np.ndarray, left: np.ndarray, right: np.ndarray | None, num: int, den: int, chunk: int = 512) -> list[tuple[int, int]]:
    """Spanning forest of the pairs that may link, as far as sizes and parities tell."""
    return _between(bitmaps, sizes, left, right, num, den, chunk, lambda p, q: True)


def solve_tile(table: pa.Table, solve: Callable) -> pa.Table:
    """Pairs (a, b) of nodes within one tile: within each group, between its two blocks.  ``solve`` finds
    the pairs of rows from the groups' data and sizes."""
    group, block = table.column("group").to_numpy(), table.column("block").to_numpy()
    node, sizes = table.column("node").to_numpy(), table.column("n").to_numpy()
    data = table.column("data").to_pylist()
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    out: list[tuple[int, int]] = []
    order = np.argsort(group, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        left, right = (np.arange(len(rows)), None) if i == j else (np.flatnonzero(block[rows] == i), np.flatnonzero(block[rows] == j))
        if len(rows) > 1 and len(left) and (right is None or len(right)):
            out += [(int(node[rows[p]]), int(node[rows[q]])) for p, q in solve([data[r] for r in rows], sizes[rows], left, right)]
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())}, schema=_EDGES)


def size_level(n: Column, num: int, den: int) -> Column:
    """Levels of set size so wide that linked sets are at most one level apart."""
    return F.floor(F.log(n.cast("double")) / (math.log(den / num) * 1.001 if num < den else 1e-9))


def block_ranges(grouped: DataFrame, tile_shingles: int, tile_sets: int) -> DataFrame:
    """group, level, weight, whole, blocks, first, low, high: whether the group is one block; if not, its
    levels' blocks, numbered by size from ``first``, and the range [low, high) of blocks within one level."""
    parts = lambda n, c: F.ceil(F.greatest(n / F.lit(tile_shingles), c / F.lit(tile_sets))).cast("long")
    levels = grouped.groupBy("group", "level").agg(F.sum("n").alias("weight"), F.count("*").alias("sets"))
    levels = levels.withColumn("blocks", parts(F.col("weight"), F.col("sets")))
    whole, by_size = Window.partitionBy("group"), Window.partitionBy("group").orderBy("level")
    levels = levels.withColumn("whole", parts(F.sum("weight").over(whole), F.sum("sets").over(whole)) == 1).withColumn("first", F.sum("blocks").over(by_size) - F.col("blocks"))
    near = lambda step, f: F.when(f("level").over(by_size) == F.col("level") + step, f("blocks").over(by_size)).otherwise(F.lit(0))
    return levels.withColumn("low", F.col("first") - near(-1, F.lag)).withColumn("high", F.col("first") + F.col("blocks") + near(1, F.lead))


def laid_out(sized: DataFrame, scratch: Scratch, name: str, buckets: int, tile_shingles: int, tile_sets: int) -> DataFrame:
    """``sized`` with pack, block, low and high: the tiles of a row are (pack, block with each block of [low, high))."""
    weights = scratch.table(block_ranges(sized, tile_shingles, tile_sets), f"{name}-weights")
    small = weights.filter("whole").agg(F.sum("weight")).first()[0] or 0
    packs = max(4 * buckets, -(-small // (1 << 17)))
    w = weights.select(F.col("group").alias("weighed"), F.col("level").alias("weighed_level"), "whole", "blocks", "first", "low", "high")
    placed = sized.join(w, (F.col("group") == F.col("weighed")) & (F.col("level") == F.col("weighed_level")))
    block = F.when(F.col("whole"), F.lit(0)).otherwise(F.col("first") + F.pmod(F.xxhash64("node"), F.col("blocks")))
    pack = F.when(F.col("whole"), F.pmod(F.xxhash64("group"), F.lit(packs))).otherwise(-1 - F.col("group"))
    low, high = (F.when(F.col("whole"), F.lit(n).cast("long")).otherwise(F.col(c)) for n, c in ((0, "low"), (1, "high")))
    placed = scratch.table(placed.select(*sized.columns, pack.alias("pack"), block.alias("block"), low.alias("tile_low"), high.alias("tile_high")), name)
    scratch.drop(f"{name}-weights")
    return placed


def tiles_of(placed: DataFrame) -> DataFrame:
    rows = placed.withColumn("other", F.explode(F.sequence("tile_low", F.col("tile_high") - 1)))
    return rows.select("pack", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "group", "block", "node", "n", "data")


def link_documents(docs: DataFrame, k: int, num: int, den: int, max_known: int = 8_000_000, tile_shingles: int = 1 << 20, tile_sets: int = 4096, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row: documents link when the Jaccard similarity of
    their sets of k-word shingles is num / den or more; component_id is the smallest id reachable.

    Words are runs of other than ASCII white space, A-Z in lower case.  A text of fewer than k words
    is one shingle; null texts and texts without words have none and link with nothing (component_id
    is their own id).  A null id gives a null component_id and links with nothing.  Repeated rows
    are equal sets and link; each row is returned.  Extra columns are ignored; an empty table gives
    no rows.  ``max_known`` bounds the counts that tasks share, ``tile_shingles`` and ``tile_sets`` a
    block; they change costs only, never results.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    buckets = bucket_count(rows)

    totals = scratch.table(total_tallies(scan(rows, k, buckets), buckets, least=2), "totals")
    shingles = totals.filter(F.col("bucket") != _SIZES)
    seen = count_histogram(shingles)
    known_from = threshold_for(seen, max_known, least=2)
    keys, counts = gathered_short(shingles, known_from)
    light, many = gathered(totals.filter(F.col("bucket") == _SIZES), 1)
    listed = sum(c * n for c, n in seen.items())
    list_cost = max(1.0, sum(min(c, 1 << 20) ** 2 * n for c, n in seen.items()) / listed) if listed else 1.0
    light_below = boundary(dict(zip(light.tolist(), many.tolist())), list_cost, num, den)

    posted = scratch.table(post(rows, k, num, den, light_below, (keys, counts), known_from), "posted")
    scratch.drop("totals")
    members = scratch.table(posted.select("doc_id", "n", "key"), "members")
    classes = scratch.table(members.filter("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("node"), F.count("*").alias("rows")), "classes")
    one = classes.select(F.col("key").alias("class_key"), F.col("node").alias("class_node"))
    mine = posted.filter(F.size("posts") > 0).join(one, (F.col("doc_id") == F.col("class_node")) & (F.col("key") == F.col("class_key")))
    sets = scratch.table(mine.select(F.col("doc_id").alias("node"), "key", "n", "posts", "parities"), "sets")
    scratch.drop("posted")
    entries = sets.select("node", F.explode("posts").alias("post"))
    hubs = scratch.table(entries.groupBy("post").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub < last").select(F.col("post").alias("hub_post"), "hub"), "hubs")
    stars = entries.join(hubs, entries["post"] == hubs["hub_post"]).filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    groups = connected_components(stars, scratch, "groups").select(F.col("component").alias("group"), F.col("node").alias("grouped_node"))

    # sizes and parities of each group leave few of its pairs; the groups of those are what sets move to
    sized = groups.join(sets, F.col("grouped_node") == F.col("node")).select("group", "node", "n", F.col("parities").alias("data"), size_level(F.col("n"), num, den).alias("level"))
    sized = scratch.table(sized, "sized")
    tiles = tiles_of(laid_out(sized, scratch, "rough", buckets, 16 * tile_shingles, tile_sets))
    bitmaps = lambda rows: [np.frombuffer(x, np.uint8) for x in rows]
    near = tiles.groupBy("pack", "i", "j").applyInArrow(lambda t: solve_tile(t, lambda rows, n, a, b: near_pairs(bitmaps(rows), n, a, b, num, den)), "a long, b long")
    groups = connected_components(near, scratch, "near").select(F.col("component").alias("group"), F.col("node").alias("grouped_node"))
    scratch.drop("groups-*", "hubs", "sized", "rough")

    sized = groups.join(sets, F.col("grouped_node") == F.col("node")).select("group", "node", F.col("key").alias("member_key"), "n", size_level(F.col("n"), num, den).alias("level"))
    sized = scratch.table(sized, "sized")
    scratch.drop("near-*", "sets")
    placed = laid_out(sized, scratch, "placed", buckets, tile_shingles, tile_sets)
    found = sets_of(rows, k, member_filter(placed, "node"))
    # an id may stand for several texts; the key tells which of them is the member
    tiles = tiles_of(found.join(placed, (F.col("doc_id") == F.col("node")) & (F.col("key") == F.col("member_key"))).withColumnRenamed("shingles", "data"))
    exact = lambda rows, n, a, b: linking_pairs([np.frombuffer(x, "<u8") for x in rows], a, b, num, den)
    links = scratch.table(tiles.groupBy("pack", "i", "j").applyInArrow(lambda t: solve_tile(t, exact), "a long, b long"), "links")

    linked = connected_components(links, scratch, "linked").withColumnRenamed("node", "linked_node")
    named = classes.join(linked, classes["node"] == linked["linked_node"], "left").select(F.col("key").alias("class_key"), F.coalesce("component", "node").alias("component"), "rows")
    named = scratch.table(named, "named")
    scratch.drop("classes", "sized", "placed", "links", "linked-*")
    joined = hot_join(members, named, "key", "class_key", "rows")
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))
