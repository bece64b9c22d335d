"""Token ids in binary shard files with a minimal perfect hash index.

A shard file, all numbers little-endian:

* the ids of its documents one after another, unsigned, ``width`` bytes each
* the places of the documents, unsigned 64-bit, one more than documents
* their keys, signed 64-bit, ascending
* the hash levels: for each level its bits (unsigned 64-bit words)
* for each slot a fingerprint and the document number, unsigned 32-bit each
* the footer as JSON, its length (unsigned 32-bit) and the magic ``VTIDS001``

The levels form a minimal perfect hash of the distinct keys: on each level a
key that has its bit to itself gets it, the others go on to the next; the
number of set bits before a key's bit is its slot.  The slot's fingerprint
tells a key that is present from one that is not, so a look-up reads one slot,
one place and one run of ids, however large the shard.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .arrow_rows import map_arrow, record, slices
from .chunk_tokens import text_ids
from .files import reader, writer
from .shared import Scratch

MAGIC = b"VTIDS001"
_SHARDS = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_null", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer over keys and a seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys by levels of bits."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # unsigned 64-bit words
        counts = [np.bitwise_count(bits).astype(np.int64) for bits in levels]
        self._before = [np.cumsum(c) - c for c in counts]
        totals = np.array([c.sum() for c in counts], dtype=np.int64)
        self._base = np.cumsum(totals) - totals

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys.astype(np.uint64)
        while len(left):
            words = -(-len(left) // 48)
            at = mix(left, len(levels)) % np.uint64(words * 64)
            alone = np.bincount(at.astype(np.int64), minlength=words * 64) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at.astype(np.int64)]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key that is not in the set any slot, or -1."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(left):
                break
            at = mix(keys[left], level) % np.uint64(len(bits) * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            found = (bits[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(bits[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            slot = self._base[level] + self._before[level][word] + below
            out[left[found]] = slot[found]
            left = left[~found]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 977) >> np.uint64(32)).astype("<u4")


class ShardWriter:
    """Takes documents in ascending order of their keys (nulls first); payload goes out at once."""

    def __init__(self, path: str, width: int):
        self.path, self._width, self._out = path, width, writer(path)
        self._keys, self._sizes, self._nulls = [], [], 0

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self._out.write(ids.astype(f"<u{self._width}").tobytes())
        self._nulls += key is None
        self._keys.append(-(1 << 63) if key is None else key)
        self._sizes.append(len(ids))

    def close(self) -> tuple:
        keys = np.array(self._keys, dtype="<i8")
        places = np.concatenate([[0], np.cumsum(np.array(self._sizes, dtype=np.int64))]).astype("<u8")
        distinct, first = np.unique(keys[self._nulls :], return_index=True)
        hashed = PerfectHash.build(distinct)
        slots = np.zeros((len(distinct), 2), dtype="<u4")
        if len(distinct):
            slots[hashed.slots(distinct)] = np.column_stack([fingerprints(distinct), first + self._nulls])
        parts = [places, keys, *hashed.levels, slots]
        for part in parts:
            self._out.write(part.tobytes())
        footer = {"width": self._width, "docs": len(keys), "nulls": self._nulls, "ids": int(places[-1]), "levels": [len(x) for x in hashed.levels], "slots": len(distinct)}
        text = json.dumps(footer).encode()
        self._out.write(text + len(text).to_bytes(4, "little") + MAGIC)
        self._out.close()
        ends = (int(distinct[0]), int(distinct[-1])) if len(distinct) else (None, None)
        return self.path, len(keys), int(places[-1]), self._nulls, *ends


class Shard:
    """An open shard file; holds the index, reads payload when asked."""

    def __init__(self, path: str):
        self._file = reader(path)
        end = self._file.size()
        tail = self._file.read_at(12, end - 12)
        if tail[4:] != MAGIC:
            raise ValueError(f"{path} is not a token shard")
        length = int.from_bytes(tail[:4], "little")
        self.footer = f = json.loads(self._file.read_at(length, end - 12 - length))
        at = f["ids"] * f["width"]

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(self._file.read_at(n * np.dtype(kind).itemsize, at), kind)
            at += found.nbytes
            return found

        self.places, self.keys = take(f["docs"] + 1, "<u8").astype(np.int64), take(f["docs"], "<i8")
        self._hash = PerfectHash([take(n, "<u8") for n in f["levels"]])
        self._slots = take(2 * f["slots"], "<u4").reshape(-1, 2)

    def find(self, key: int) -> list[int]:
        """Numbers of the documents with this key."""
        slot = int(self._hash.slots(np.array([key]))[0])
        if slot < 0 or self._slots[slot, 0] != fingerprints(np.array([key]))[0]:
            return []
        at, found = int(self._slots[slot, 1]), []
        while at < len(self.keys) and self.keys[at] == key:
            found.append(at)
            at += 1
        return found

    def check_index(self, at: int, last: int) -> None:
        """Looks up the keys of the documents [at, last) and compares what the index says with the scan."""
        nulls = self.footer["nulls"]
        wanted = np.unique(self.keys[max(at, nulls) : last])
        if not len(wanted):
            return
        slots = self._hash.slots(wanted)
        first = np.searchsorted(self.keys[nulls:], wanted) + nulls
        if (slots < 0).any() or (self._slots[slots, 0] != fingerprints(wanted)).any() or (self._slots[slots, 1] != first).any():
            raise ValueError("the index of a token shard differs from its keys")

    def key(self, number: int) -> int | None:
        return None if number < self.footer["nulls"] else int(self.keys[number])

    def ids(self, number: int, last: int | None = None) -> np.ndarray:
        """Ids of one document, or of all up to ``last``."""
        width, (a, b) = self.footer["width"], self.places[[number, last or number + 1]].tolist()
        return np.frombuffer(self._file.read_at((b - a) * width, a * width), f"<u{width}")


class TokenStore:
    """The shards of one write, in ascending order of keys, with the ids before each of them."""

    def __init__(self, spark: SparkSession, manifest: list[dict]):
        self.spark, self.manifest = spark, manifest
        self._open: dict[str, Shard] = {}

    def get(self, key: int) -> list[np.ndarray]:
        """Ids of every document with this key, read by the index."""
        out = []
        for m in self.manifest:
            if m["first"] is not None and m["first"] <= key <= m["last"]:
                shard = self._open.setdefault(m["path"], None) or Shard(m["path"])
                self._open[m["path"]] = shard
                out += [shard.ids(n) for n in shard.find(key)]
        return out

    def read(self) -> DataFrame:
        """doc_id, start (ids of all documents before it), n_tokens and ids (binary, little-endian unsigned 32-bit)."""
        shared = self.spark.sparkContext.broadcast(self.manifest)

        def run(batches):
            for batch in batches:
                for n in batch.column(0).to_pylist():
                    m = shared.value[n]
                    shard, at = Shard(m["path"]), 0
                    while at < m["n_docs"]:
                        limit = shard.places[at] + (2 << 20)
                        last = max(at + 1, int(np.searchsorted(shard.places, limit, "right")) - 1)
                        shard.check_index(at, last)
                        flat = shard.ids(at, last).astype("<u4")
                        places = shard.places[at : last + 1]
                        inside = (places - places[0]).tolist()
                        ids = [flat[a:b].tobytes() for a, b in zip(inside, inside[1:])]
                        keys = [shard.key(k) for k in range(at, last)]
                        yield record(_DOCS, keys, places[:-1] + m["start"], np.diff(places), ids)
                        at = last

        count = len(self.manifest)
        return map_arrow(self.spark.range(0, count, 1, max(count, 1)), run, "doc_id long, start long, n_tokens long, ids binary")


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, width: int | None = None, id_column: str = "doc_id", text_column: str = "text", shards: int | None = None, shard_bytes: int = 512 << 20) -> TokenStore:
    """Encodes whole texts, appends ``end_id`` to each and writes shards in ascending order of the id:
    one for each ``shard_bytes`` of text, and one for each shuffle partition at least.

    Rows go to shards by range of (id, hash of the text), so an id that very many rows share fills
    several shards; rows with equal ids are in the order of that hash.  Null ids come first and
    have no key in the index; null texts are the end id alone; extra columns are ignored; an empty
    table gives a store without shards.  Each task names its file anew and only files of tasks that
    ended well enter the manifest, so repeated tasks leave no trace in it.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-store", keep=True)
    width = width or (2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else 4)
    if not shards:
        size = docs.select(F.sum(F.octet_length(F.col(text_column).cast("string")))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    folder = scratch.path("shards")

    def run(batches):
        encode, out, number = text_ids(tokenizer), None, 0
        for batch in batches:
            for rows in slices(batch, 1):
                out = out or ShardWriter(f"{folder}/{uuid.uuid4().hex}.ids", width)
                number = rows.column(2)[0].as_py()
                for key, ids in zip(rows.column(0).to_pylist(), encode.batch(rows.column(1).to_pylist())):
                    out.add(key, np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id)))
        if out:
            yield record(_SHARDS, *([x] for x in (number, *out.close())))

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    placed = rows.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    placed = placed.select("doc_id", "text", F.spark_partition_id().alias("part"))
    manifest = map_arrow(placed, run, "part int, path string, n_docs long, n_ids long, n_null long, first long, last long")  # a row a shard
    found, start = [], 0
    for row in sorted(manifest.collect(), key=lambda r: r.part):
        found.append(row.asDict() | {"start": start})
        start += row.n_ids
    return TokenStore(spark, found)
