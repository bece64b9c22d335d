"""Language-model scores by prediction by partial matching over bytes.

Training counts every string of ``order`` + 1 bytes of the normalized training
texts (packed exchange).  The strings are the leaves of a byte-context trie;
shorter contexts are their suffixes' sums.  All counts are kept, in tables cut
by a hash of the two bytes before a string's last: a bucket thus holds all that
orders 2 and above know of its strings, and orders 1 and 0, 65,536 and 256
strings at most, go to every task.  The ``max_grams`` commonest strings' final
values go to every task as well; all other strings meet their bucket's trie by
a packed exchange, so scores do not depend on ``max_grams``.

A byte's probability: from its longest known context, the escape estimate of
method D (half a count of each distinct successor) leads to the next shorter one, where the successors already ruled out are excluded from all sums; below
the empty context every remaining byte is equally likely.

A text is normalized to its words (A-Z in lower case) with one space between
and one line feed, which no word contains, as its end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_rows import map_arrow, record, slices
from .shared import Scratch, id_remainder
from .tallies import PACKED, PACKED_SQL, bucket_count, count_histogram, gathered, partial_tallies, threshold_for, total_tallies
from .text_arrays import Lookup, Words, looked_up, summed

END, GAP = 10, 32
#: Bytes that can occur in a normalized text: all but the five white-space bytes that are neither.
ALPHABET = 252


def normalized(words: Words, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end, each after ``lead`` end bytes that are context only; where each begins."""
    rows = len(words.first) - 1
    n_words = np.diff(words.first)
    lengths = np.zeros(rows, dtype=np.int64)
    owner = np.repeat(np.arange(rows), n_words)
    np.add.at(lengths, owner, words.sizes)
    lengths += np.maximum(n_words, 1) + lead  # a gap after each word but the last, and the end
    begins = np.concatenate([[0], np.cumsum(lengths)])
    out = np.full(begins[-1], END, dtype=np.uint8)
    if len(words.sizes):
        step = words.sizes + 1
        ahead = np.cumsum(step) - step
        at = begins[owner] + lead + ahead - ahead[words.first[owner]]
        inside = np.arange(len(words.letters)) - np.repeat(words.starts, words.sizes)
        out[np.repeat(at, words.sizes) + inside] = words.letters
        last = np.zeros(len(at), dtype=bool)
        last[words.first[1:][n_words > 0] - 1] = True
        out[(at + words.sizes)[~last]] = GAP
    return out, begins


def grams(text: np.ndarray, begins: np.ndarray, order: int) -> np.ndarray:
    """For each byte of each text the string of ``order`` + 1 bytes that ends with it, as a number."""
    if not len(text):
        return np.zeros(0, dtype=np.uint64)
    key = np.zeros(max(len(text) - order, 0), dtype=np.uint64)
    for j in range(order + 1):
        key = (key << np.uint64(8)) | text[j : j + len(key)]
    keep = np.ones(len(text), dtype=bool)
    keep[(begins[:-1, None] + np.arange(order)).ravel()] = False
    return key[keep[order:]]


@dataclass
class Level:
    """One order of the trie: its strings with counts, and its contexts."""

    strings: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    kinds: np.ndarray


def spread(strings: np.ndarray) -> np.ndarray:
    """The strings, of 6 bytes at most, under 16 bits of hash of the two bytes before their last."""
    before = (strings >> np.uint64(8)) & np.uint64(0xFFFF)
    return (((before * np.uint64(40503)) & np.uint64(0xFFFF)) << np.uint64(48)) | strings


def unspread(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strings of spread keys in ascending order, and the order that makes it."""
    strings = keys & np.uint64((1 << 48) - 1)
    order = np.argsort(strings, kind="stable")
    return strings[order], order


class Trie:
    """``below``, if given, are the lowest levels, counted over more strings than these."""

    def __init__(self, strings: np.ndarray, counts: np.ndarray, order: int, below: list[Level] | None = None):
        self.order, self.levels = order, list(below or [])
        for k in range(order, len(below or []) - 1, -1):
            contexts, starts = np.unique(strings >> np.uint64(8), return_index=True)
            total = np.add.reduceat(counts, starts) if len(starts) else counts
            kinds = np.diff(np.append(starts, len(strings)))
            self.levels.insert(len(below or []), Level(strings, counts, contexts, total, kinds.astype(np.int32)))
            if k:
                strings, counts = summed(strings & np.uint64((1 << 8 * k) - 1), counts)
        # for each context of order k > 0: how often its successors follow its suffix
        self.ruled_out = [np.zeros(0, dtype=np.int64)]
        for k in range(1, order + 1):
            level, below = self.levels[k], self.levels[k - 1]
            at, _ = looked_up(below.strings, level.strings & np.uint64((1 << 8 * k) - 1))
            starts = np.searchsorted(level.strings >> np.uint64(8), level.contexts)
            self.ruled_out.append(np.add.reduceat(below.counts[at], starts) if len(starts) else below.counts[:0])

    def log10(self, strings: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each string after the bytes before it."""
        n = len(strings)
        out, open_, excluded, excluded_kinds = np.zeros(n), np.ones(n, dtype=bool), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            tail = strings & np.uint64((1 << 8 * (k + 1)) - 1)
            context, known = looked_up(level.contexts, tail >> np.uint64(8))
            if not len(level.contexts):
                continue
            total, kinds = level.total[context] - excluded, level.kinds[context] - excluded_kinds
            use = known & open_ & (kinds > 0)
            at, there = looked_up(level.strings, tail)
            hit = use & there
            out[hit] += np.log10((level.counts[at[hit]] - 0.5) / total[hit])
            escape = use & ~there
            out[escape] += np.log10(0.5 * kinds[escape] / total[escape])
            open_ &= ~hit
            if k:
                excluded = np.where(known, self.ruled_out[k][context], excluded)
            excluded_kinds = np.where(known, level.kinds[context], excluded_kinds)
        out[open_] -= np.log10(np.maximum(ALPHABET - excluded_kinds[open_], 1))
        return out


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("row", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("tail", pa.binary()), ("tail_n", pa.binary()), ("strings", pa.binary()), ("strings_n", pa.binary())])
_SCORED_SQL = "doc_id long, held_out boolean, row long, n_tokens long, n_known long, base double, score double, tail binary, tail_n binary, strings binary, strings_n binary"


def score_documents(docs: DataFrame, modulus: int = 7, remainder: int = 2, order: int = 5, max_grams: int = 1_000_000, max_words: int = 500_000, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row.

    Rows with crc32(id) mod ``modulus`` = ``remainder`` are held out of all counts.  ``base_score``
    sums log10((c + 1) / (N + V + 1)) over words and the end, c being the count in the training
    rows: the ``max_words`` commonest words' counts go to every task, the rarer words meet their
    counts by a packed exchange, so every count is exact whatever the size of the vocabulary.
    ``score`` is the log10 probability of the normalized text by the trie of all training strings:
    likewise the ``max_grams`` commonest strings' values go to every task, the others are exchanged.

    A null text counts as empty: one end token.  A null id counts as the empty id.  Repeated rows
    count as often as they occur; extra columns are ignored; an empty table gives no rows.
    """
    if not 2 <= order <= 5:
        raise ValueError("order must be 2 to 5")
    spark = docs.sparkSession
    scratch = Scratch(spark, "ppm")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), (id_remainder(id_column, modulus) == remainder).alias("held_out"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    training = rows.filter(~F.col("held_out")).select("text")

    buckets = bucket_count(rows)

    def word_keys(part):
        yield Words(part.column(part.num_columns - 1)).hashes

    def gram_keys(part):
        yield spread(grams(*normalized(Words(part.column(part.num_columns - 1)), order), order))

    words = scratch.table(total_tallies(partial_tallies(training, word_keys, buckets), buckets), "words")
    strings = scratch.table(total_tallies(partial_tallies(training, gram_keys, buckets, slice_bytes=2 << 20), buckets), "strings")
    histogram, deep = count_histogram(words), count_histogram(strings)
    n_rows = training.count()
    totals = map_arrow(words, _sums, "n long, v long").groupBy().sum("n", "v").first()
    n, v = (totals[0] or 0) + n_rows, (totals[1] or 0) + (n_rows > 0)
    common_from = threshold_for(histogram, max_words)
    common = spark.sparkContext.broadcast(gathered(words, common_from))
    whole_vocabulary = common_from <= 1
    cached = spark.sparkContext.broadcast(_common_values(strings, threshold_for(deep, max_grams)))
    lowest = spark.sparkContext.broadcast(_lowest_levels(strings))
    floor = float(n + v + 1)

    def run(batches):
        keys, counts = common.value
        gram_table, gram_counts, gram_values = cached.value
        find, find_gram = Lookup(keys, counts), Lookup(gram_table, gram_counts)
        logs = np.log10((counts + 1) / floor)
        end = np.log10((n_rows + 1) / floor)
        for batch in batches:
            for part in slices(batch, 2, 2 << 20):
                found = Words(part.column(2))
                owner = np.repeat(np.arange(part.num_rows), np.diff(found.first))
                at, known = find(found.hashes)
                value = np.where(known, logs[at], 0.0) if len(keys) else np.zeros(len(at))
                base = np.bincount(owner, weights=value, minlength=part.num_rows) + end
                n_known = np.bincount(owner, weights=known, minlength=part.num_rows).astype(np.int64) + (n_rows > 0)
                tails, tail_n = _tails(found, known, whole_vocabulary, floor, base)
                text, begins = normalized(found, order)
                asked = spread(grams(text, begins, order))
                starts = begins - order * np.arange(part.num_rows + 1)
                at, known = find_gram(asked)
                points = np.where(known, gram_values[at], 0.0) if len(gram_table) else np.zeros(len(at))
                owner = np.repeat(np.arange(part.num_rows), np.diff(starts))
                rare, rare_n = _packed_by_row(asked[~known], owner[~known], part.num_rows)
                yield record(_SCORED, part.column(0), part.column(1), part.column(3), np.diff(found.first) + 1, n_known, base, np.add.reduceat(points, starts[:-1]), tails, tail_n, rare, rare_n)

    def word_values(keys, counts):
        def values(asked):
            at, known = looked_up(keys, asked)
            c = np.where(known, counts[at], 0) if len(keys) else np.zeros(len(asked))
            return np.log10((c + 1) / floor), known

        return values

    def string_values(keys, counts):
        strings, by = unspread(keys)
        trie = Trie(strings, counts[by].astype(np.int64), order, lowest.value)

        def values(asked):
            each, inverse = np.unique(asked & np.uint64((1 << 48) - 1), return_inverse=True)
            return trie.log10(each)[inverse], np.zeros(len(asked), dtype=bool)

        return values

    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    scored = scratch.table(map_arrow(numbered, run, _SCORED_SQL), "scored")
    rare = _exchanged(scored.select("row", "strings", "strings_n"), strings, buckets, string_values).select("row", F.lit(0.0).alias("rare_base"), F.lit(0).cast("long").alias("rare_known"), F.col("value").alias("rare_score"))
    if not whole_vocabulary:
        rare = rare.unionByName(_exchanged(scored.select("row", "tail", "tail_n"), words, buckets, word_values).select("row", F.col("value").alias("rare_base"), F.col("known").alias("rare_known"), F.lit(0.0).alias("rare_score")))
    rare = rare.groupBy(F.col("row").alias("rare_row")).agg(*[F.sum(c).alias(c) for c in ("rare_base", "rare_known", "rare_score")])
    scored = scored.drop("tail", "tail_n", "strings", "strings_n").join(rare, F.col("row") == F.col("rare_row"), "left")
    base, known, score = F.coalesce("rare_base", F.lit(0.0)), F.coalesce("rare_known", F.lit(0)), F.coalesce("rare_score", F.lit(0.0))
    return scored.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + base).alias("base_score"), (F.col("score") + score).alias("score"))


def _sums(batches):
    schema = pa.schema([("n", pa.int64()), ("v", pa.int64())])
    for batch in batches:
        for counts in batch.column(2).to_pylist():
            counts = np.frombuffer(counts, "<u8")
            yield record(schema, [int(counts.sum())], [len(counts)])


def _common_values(strings: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spread keys (ascending) of the strings with a count of ``least`` or more, their counts and their
    log10 probabilities after their contexts, all of whose strings are in the same bucket."""
    schema = pa.schema([*PACKED, ("values", pa.binary())])

    def run(batches):
        for batch in batches:
            for bucket, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
                keys, counts = np.frombuffer(keys, "<u8"), np.frombuffer(counts, "<u8").astype(np.int64)
                keep = counts >= least
                _, context, inverse = np.unique(keys >> np.uint64(8), return_index=True, return_inverse=True)
                total = np.add.reduceat(counts, context)[inverse] if len(keys) else counts
                values = np.log10((counts[keep] - 0.5) / total[keep])
                yield record(schema, [bucket], [keys[keep].tobytes()], [counts[keep].astype("<u8").tobytes()], [values.astype("<f8").tobytes()])

    rows = sorted(map_arrow(strings, run, PACKED_SQL + ", values binary").collect(), key=lambda r: r.bucket)
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in (("keys", "<u8"), ("counts", "<i8"), ("values", "<f8")))


def _lowest_levels(strings: DataFrame) -> list[Level]:
    """Orders 0 and 1 over all buckets: 256 and 65,536 strings at most."""
    schema = pa.schema([("string", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            for keys, counts in zip(*(c.to_pylist() for c in batch.columns[1:])):
                yield record(schema, *summed(np.frombuffer(keys, "<u8") & np.uint64(0xFFFF), np.frombuffer(counts, "<u8")))

    found = sorted((r[0], r[1]) for r in map_arrow(strings, run, "string long, n long").groupBy("string").sum("n").collect())
    return Trie(np.array([s for s, _ in found], np.uint64), np.array([n for _, n in found], np.int64), 1).levels


def _tails(found: Words, known: np.ndarray, whole: bool, floor: float, base: np.ndarray) -> tuple[list, list]:
    """Words of each row whose count is not at hand, with their number in the row; with the whole
    vocabulary at hand they are unknown words, and go into ``base`` at once."""
    tails, numbers = [], []
    missing = np.flatnonzero(~known)
    cuts = np.searchsorted(missing, found.first)
    for r, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
        if whole or a == b:
            base[r] -= (b - a) * np.log10(floor)
            tails.append(b"")
            numbers.append(b"")
        else:
            keys, n = np.unique(found.hashes[missing[a:b]], return_counts=True)
            tails.append(keys.tobytes())
            numbers.append(n.astype("<u4").tobytes())
    return tails, numbers


def _packed_by_row(keys: np.ndarray, owner: np.ndarray, rows: int) -> tuple[list, list]:
    """The distinct keys of each row and how often each occurs in it."""
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]))) if len(keys) else np.zeros(0, np.int64)
    numbers = np.diff(np.append(first, len(keys))).astype("<u4")
    cuts = np.searchsorted(owner[first], np.arange(rows + 1)).tolist()
    keys = keys[first].astype("<u8")
    return [keys[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], [numbers[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


def _exchanged(asking: DataFrame, table: DataFrame, buckets: int, values_by: Callable) -> DataFrame:
    """row, value, known: sums over the keys that each row of ``asking`` (row, keys, counts) packs.
    ``values_by`` makes of a bucket's keys and counts a function from keys to values and whether each is known."""
    asked_schema = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("rows", pa.binary())])
    answer_schema = pa.schema([("row", pa.int64()), ("value", pa.float64()), ("known", pa.int64())])
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=np.uint64)

    def ask(batches):
        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                tails = [np.frombuffer(x, "<u8") for x in part.column(1).to_pylist()]
                keys = np.concatenate(tails)
                numbers = np.concatenate([np.frombuffer(x, "<u4") for x in part.column(2).to_pylist()])
                rows = np.repeat(part.column(0).to_numpy(), [len(x) for x in tails])
                order = np.argsort(keys, kind="stable")
                keys, numbers, rows = keys[order], numbers[order], rows[order]
                cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                out = [(b, keys[i:j].tobytes(), numbers[i:j].tobytes(), rows[i:j].astype("<i8").tobytes()) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
                if out:
                    yield record(asked_schema, *zip(*out))

    def answer(batches):
        current, values_of = None, None
        for batch in batches:
            for bucket, keys, counts, rows in zip(*(c.to_pylist() for c in batch.columns)):
                if rows is None:
                    current, values_of = bucket, values_by(np.frombuffer(keys, "<u8"), np.frombuffer(counts, "<u8"))
                    continue
                if bucket != current:  # no key of the table is in this bucket
                    current, values_of = bucket, values_by(np.zeros(0, np.uint64), np.zeros(0, np.uint64))
                keys, numbers, rows = np.frombuffer(keys, "<u8"), np.frombuffer(counts, "<u4"), np.frombuffer(rows, "<i8")
                values, known = values_of(keys)
                each, inverse = np.unique(rows, return_inverse=True)
                yield record(answer_schema, each, np.bincount(inverse, weights=numbers * values), np.bincount(inverse, weights=numbers * known).astype(np.int64))

    names = asking.columns
    asked = map_arrow(asking.filter(F.octet_length(names[1]) > 0), ask, PACKED_SQL + ", rows binary")
    both = table.withColumn("rows", F.lit(None).cast("binary")).unionByName(asked)
    dealt = both.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", F.col("rows").isNotNull())
    return map_arrow(dealt, answer, "row long, value double, known long")
