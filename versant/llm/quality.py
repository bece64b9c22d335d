"""Quality classification from weak labels.

Heuristic labellers vote good, bad or nothing on each text.  The counts of all
vote patterns over the whole corpus (at most 3 to the number of labellers) are
enough for expectation-maximisation to estimate each labeller's accuracy and
the share of good texts.  The posterior of a text's pattern is its soft label,
from which a linear scorer over hashed byte pairs is trained.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_rows import extended, map_arrow, record, row_priority, slices
from .text_arrays import Words, bytes_of

GOOD, NONE, BAD = 2, 1, 0
#: A labeller is taken to alarm on no more than this share of good texts; it keeps the two classes
#: from changing places where one kind of bad text has a single labeller of its own.
FALSE_ALARMS = 0.0005
LABELLERS = ("symbols", "capitals", "marks", "repeats", "word length", "sentences", "letters")

_SHORT = 400

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#$%&*@^~|<>=+_{}[]\\`"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord("!"), ord("|"), ord("?")]] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True

_TALLY = pa.schema([("pattern", pa.int32()), ("n", pa.int64()), ("priority", pa.float64()), ("features", pa.binary())])
_TALLY_SQL = "pattern int, n long, priority double, features binary"
_ADDED = pa.schema([("quality_score", pa.float64()), ("keep", pa.bool_())])


def _vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return np.where(bad, BAD, np.where(good, GOOD, NONE))


def votes(column: pa.Array) -> np.ndarray:
    """A row of votes for each text, in the order of LABELLERS; empty texts get none."""
    raw, places = bytes_of(column)
    rows = len(places) - 1

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags[raw], dtype=np.int64)])
        return np.diff(sums[places])

    words = Words(column)
    n = np.diff(words.first)
    solid = np.maximum(np.diff(places) - total(_BLANK), 1)
    owner = np.repeat(np.arange(rows), n)
    again = (words.hashes[1:] == words.hashes[:-1]) & (owner[1:] == owner[:-1])
    repeats = np.bincount(owner[1:][again], minlength=rows) / np.maximum(n, 1)
    ascii_letters = np.maximum(total(_LETTER & (np.arange(256) < 128)), 1)
    symbols, capitals, marks, letters = total(_SYMBOL) / solid, total(_UPPER) / ascii_letters, total(_MARK) / solid, total(_LETTER) / solid
    dots, length = total(np.arange(256) == ord(".")), solid / np.maximum(n, 1)
    never = np.zeros(rows, dtype=bool)
    out = np.column_stack([
        _vote(never, symbols > 0.08),
        _vote(never, (capitals > 0.5) & (n >= 5)),
        _vote(never, marks > 0.08),
        _vote(never, (n >= 5) & (repeats > 0.2)),
        _vote(never, (length > 25) | (length < 1.5)),
        _vote((dots > 0) | (n < 20), (n >= 20) & (dots == 0)),
        _vote(letters > 0.8, letters < 0.6),
    ])
    out[n == 0] = NONE
    return out


def pattern_numbers(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


def features(column: pa.Array, width: int) -> np.ndarray:
    """Hashed features of each text: shares of byte pairs, as a vector of length 1 (less for texts
    under ``_SHORT`` bytes, of which they say little), and the labellers' votes by name."""
    raw, places = bytes_of(column)
    rows = len(places) - 1
    owner = np.repeat(np.arange(rows, dtype=np.int64), np.diff(places))
    out = np.zeros(rows * width, dtype=np.int64)
    if len(raw) > 1:
        with np.errstate(over="ignore"):
            pair = (raw[:-1].astype(np.uint32) * np.uint32(256) + raw[1:] + np.uint32(1)) * np.uint32(2654435769)
        slot = (pair >> np.uint32(32 - int(width).bit_length() + 1)).astype(np.int64)
        inside = owner[:-1] == owner[1:]
        out = np.bincount((owner[:-1] * width + slot)[inside], minlength=rows * width)
    out = out.reshape(rows, width).astype(np.float32)
    trust = np.sqrt(np.minimum(np.diff(places) / _SHORT, 1.0))[:, None].astype(np.float32)
    out *= trust / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-9)
    with np.errstate(over="ignore"):
        names = np.arange(1, 1 + 3 * len(LABELLERS), dtype=np.uint32) * np.uint32(2246822519)
    slots = (names >> np.uint32(32 - int(width).bit_length() + 1)).astype(np.int64).reshape(-1, 3)
    cast = slots[np.arange(len(LABELLERS)), votes(column)]
    np.add.at(out, (np.arange(rows)[:, None], cast), np.float32(0.5))
    return out


@dataclass
class LabelModel:
    good: float  # share of good texts
    table: np.ndarray  # class (bad, good) by labeller by vote: probability

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes."""
        logs = np.log([1 - self.good, self.good])[:, None] + sum(np.log(self.table[:, j, patterns[:, j]]) for j in range(patterns.shape[1]))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))

    def accuracies(self) -> dict[str, float]:
        """How often each labeller is right when it votes."""
        prior = np.array([1 - self.good, self.good])
        right = prior[0] * self.table[0, :, BAD] + prior[1] * self.table[1, :, GOOD]
        wrong = prior[0] * self.table[0, :, GOOD] + prior[1] * self.table[1, :, BAD]
        return dict(zip(LABELLERS, (right / (right + wrong)).tolist()))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """Expectation-maximisation over vote patterns and their counts, starting from the view that a
    text is bad if any labeller says so."""
    p = np.where((patterns == BAD).any(axis=1), 0.05, 0.95)
    model = LabelModel(0.8, np.full((2, patterns.shape[1], 3), 1 / 3))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - p), counts * p])
        table = np.stack([[[(weight[c] * (patterns[:, j] == v)).sum() + 1.0 for v in range(3)] for j in range(patterns.shape[1])] for c in range(2)])
        table /= table.sum(axis=2, keepdims=True)
        alarms = np.minimum(table[1, :, BAD], FALSE_ALARMS)
        table[1] *= ((1 - alarms) / (1 - table[1, :, BAD]))[:, None]
        table[1, :, BAD] = alarms
        model = LabelModel(float(np.clip(weight[1].sum() / max(weight.sum(), 1e-9), 1e-3, 1 - 1e-3)), table)
        p = model.posterior(patterns)
    return model


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray
    bias: float
    width: int

    def score(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(column, self.width) @ self.weights + self.bias, -60, 60)))


def train_linear(x: np.ndarray, p: np.ndarray, rounds: int = 400, rate: float = 2.0, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by gradient steps of adaptive size, both classes at equal weight."""
    w, b = np.zeros(x.shape[1], dtype=np.float32), 0.0
    share = np.clip(p.mean(), 1e-3, 1 - 1e-3)
    weight = (p / share + (1 - p) / (1 - share)) / 2
    seen, seen_b = np.full(x.shape[1], 1e-8, dtype=np.float32), 1e-8
    for _ in range(rounds):
        error = (1 / (1 + np.exp(-np.clip(x @ w + b, -60, 60))) - p) * weight / len(p)
        slope = x.T @ error.astype(np.float32) + decay * w
        seen, seen_b = seen + slope**2, seen_b + error.sum() ** 2
        w, b = w - rate * slope / np.sqrt(seen), b - rate * 0.1 * float(error.sum() / np.sqrt(seen_b))
    return w, b


def fit(docs: DataFrame, sample: int = 4096, width: int = 2048, text_column: str = "text") -> QualityModel:
    """Counts vote patterns over all documents, estimates the label model, and trains the scorer on
    about ``sample`` distinct texts, a bound that doesn't grow with the corpus; they are chosen by
    their hash, whatever the order and the files of the rows.  Null texts are empty."""
    rows = docs.select(row_priority(text_column).alias("priority"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    share = sample / max(docs.count(), 1)

    def run(batches):
        tally: dict[int, int] = {}
        sent: set[float] = set()
        for batch in batches:
            for part in slices(batch):
                pattern = pattern_numbers(votes(part.column(1)))
                for v, n in zip(*(x.tolist() for x in np.unique(pattern, return_counts=True))):
                    tally[v] = tally.get(v, 0) + n
                priority = part.column(0).to_numpy()
                _, once = np.unique(priority, return_index=True)
                chosen = np.array([i for i in np.sort(once).tolist() if priority[i] < share and priority[i] not in sent], dtype=np.int64)
                if len(chosen):
                    sent.update(priority[chosen].tolist())
                    x = features(part.column(1).take(pa.array(chosen)), width).astype(np.float16)
                    yield record(_TALLY, pattern[chosen], [0] * len(chosen), priority[chosen], [r.tobytes() for r in x])
        if tally:
            yield record(_TALLY, list(tally), list(tally.values()), [None] * len(tally), [None] * len(tally))

    counted, kept = {}, {}
    for r in map_arrow(rows, run, _TALLY_SQL).collect():
        if r["features"] is None:
            counted[r["pattern"]] = counted.get(r["pattern"], 0) + r["n"]
        else:
            kept[r["priority"]] = (r["pattern"], r["features"])
    if not counted:
        return QualityModel(LabelModel(0.5, np.full((2, len(LABELLERS), 3), 1 / 3)), np.zeros(width, np.float32), 0.0, width)
    split = lambda numbers: np.array(numbers)[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    labels = estimate(split(list(counted)), np.array(list(counted.values()), dtype=np.float64))
    if not kept:
        return QualityModel(labels, np.zeros(width, np.float32), float(np.log(labels.good / (1 - labels.good))), width)
    chosen = [kept[p] for p in sorted(kept)]
    x = np.stack([np.frombuffer(f, np.float16).astype(np.float32) for _, f in chosen])
    w, b = train_linear(x, labels.posterior(split([pattern for pattern, _ in chosen])))
    return QualityModel(labels, w, b, width)


def _scores(model: QualityModel, column: pa.Array) -> np.ndarray:
    return np.concatenate([model.score(column.slice(at, 1024)) for at in range(0, len(column), 1024)])


def classify(docs: DataFrame, model: QualityModel, keep_from: float = 0.5, text_column: str = "text") -> DataFrame:
    """``docs`` with quality_score (0 to 1) and keep.  Null texts are empty and score as the bias
    says; repeated rows score alike; columns named like the new ones give way to them.  An empty
    table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def values(given):
        score = _scores(shared.value, given.column(0))
        return (score, score >= keep_from), None

    return extended(docs, [F.coalesce(F.col(text_column).cast("string"), F.lit(""))], "quality_score double, keep boolean", _ADDED, values)


def only_good(docs: DataFrame, model: QualityModel, keep_from: float = 0.5, text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, that ``classify`` keeps."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return extended(docs, [F.coalesce(F.col(text_column).cast("string"), F.lit(""))], "", pa.schema([]), lambda given: ((), _scores(shared.value, given.column(0)) >= keep_from))
