"""Solvers against brute force and by what must hold of any result."""

import random
import tracemalloc

import pytest

from versant.operators import solve
from versant.operators.solve import Row, Segment, Unit

UNITS = [Unit(i + 1, t) for i, t in enumerate(["الحمد لله رب العالمين", "الرحمن الرحيم", "مالك يوم الدين", "اياك نعبد واياك نستعين"])]
SEGMENTS = [Segment("الحمد لله رب", 0, 2), Segment("العالمين", 2, 3), Segment("الرحمن الرحيم", 3.5, 5), Segment("مالك يوم الدين", 5.5, 8), Segment("اياك نعبد واياك", 8, 10), Segment("نستعين", 10, 11)]


def brute(n, m, most, price):
    best = None

    def go(at, j, total):
        nonlocal best
        if j == m:
            best = total if best is None else min(best, total)
            return
        for k in range(1, most + 1):
            if at + k <= n:
                go(at + k, j + 1, total + price(at, at + k, j))

    go(0, 0, 0)
    return best


def test_cheapest_runs_against_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        n, m, most, known = rng.randint(1, 7), rng.randint(1, 4), rng.randint(1, 4), {}
        price = lambda a, b, j: known.setdefault((a, b, j), rng.randint(0, 9))  # noqa: B023, E731
        runs, want = solve.cheapest_runs(n, m, most, price), brute(n, m, most, price)
        if want is not None:
            assert sum(price(a, b, j) for j, (a, b) in enumerate(runs)) == want
            assert all(a < b for a, b in runs) and all(x[1] == y[0] for x, y in zip(runs, runs[1:]))


def test_strategies_find_all_units():
    for strategy in ("dp", "greedy", "hybrid", "auto", "words"):
        rows = solve.align_full(SEGMENTS, UNITS, [(3.0, 3.4)], strategy=strategy)
        assert [r.unit.number for r in rows] == [1, 2, 3, 4]
        assert all(0 <= r.score <= 1 and r.start < r.end for r in rows)
        assert all(a.end <= b.start for a, b in zip(rows, rows[1:]))
    assert solve.align_full([], UNITS) == [] and solve.align_full(SEGMENTS, []) == []


def test_fewer_segments_than_units_makes_blocks():
    rows = solve.align_dp([Segment(" ".join(u.text for u in UNITS[:2]), 0, 6)], UNITS[:2])
    assert [(r.start, r.end) for r in rows] == [(0, 4.0), (4.0, 6.0)] and all(r.overlap for r in rows)


def test_low_runs():
    assert solve.runs_below([0.95, 0.62, 0.58, 0.92], 0.75, 2) == [(1, 3)]
    assert solve.runs_below([0.95, 0.5, 0.92, 0.91], 0.75, 2) == []


def test_overlaps_and_snaps():
    rows = [Row(UNITS[0], 0, 3, "", 0.9), Row(UNITS[1], 2, 5, "", 0.9)]
    fixed = solve.fix_overlaps(rows)
    assert (fixed[0].end, fixed[1].start) == (2.5, 2.5)
    snapped = solve.snap_to_silences(rows, [(2.6, 2.8)])
    assert (snapped[0].end, snapped[1].start) == (2.6, 2.8)
    assert solve.claim_breaths([1.0, 1.1], [(1.0, 1.6)]) == [0, None]


def test_sequence_alignment_keeps_order():
    assert solve.align_sequences(["alpha", "beta", "gamma"], ["alpha", "gama"]) == [0, None, 1]


def test_words_without_a_way_to_all_units_fall_back():
    units = [Unit(1, "a b c d e f g h i j"), Unit(2, "k l m n o p q r s t")]
    rows = solve.align_full([Segment("a b", 0, 1), Segment("k l", 1, 2)], units, strategy="words")
    assert [r.unit.number for r in rows] == [1, 2]


def turns_of(n, letters, seed=4):
    """A recording of n turns, every other one a unit."""
    rng = random.Random(seed)
    text = lambda: " ".join("".join(rng.choice("abcdeé.أإ") for _ in range(rng.randint(1, 9))) for _ in range(letters // 6))
    parts = [Segment(text(), 4.0 * i, 4.0 * i + 3) for i in range(n)]
    return parts, [Unit(i + 1, s.text) for i, s in enumerate(parts) if i % 2 == 0]


def test_runs_of_texts_are_the_cheapest(monkeypatch):
    rng = random.Random(5)
    text = lambda: "".join(rng.choice("ab cdé!. أإ\n") for _ in range(rng.choice([0, 1, 3, 10, 40])))
    for _ in range(300):
        n, m, most = rng.randint(1, 12), rng.randint(1, 6), rng.choice([1, 2, 3, 6, 8, 14])
        texts = [text() for _ in range(n)]
        units = [rng.choice([text(), rng.choice(texts)]) for _ in range(m)]
        spared = solve.np.array([rng.choice([0.0, 0.15]) for _ in range(n + 1)])
        monkeypatch.setattr(solve, "_BLOCK", rng.choice([1, 5, 50, 1 << 15]))
        want = solve.cheapest_runs(n, m, most, lambda a, b, j: solve.cost(" ".join(texts[a:b]), units[j]) - spared[b])  # noqa: B023
        assert solve.cheapest_text_runs(texts, units, most, spared) == want


def test_runs_and_spans_are_not_compared_one_by_one(monkeypatch):
    calls, known = [], solve.indel_ratio
    monkeypatch.setattr(solve, "indel_ratio", lambda a, b: calls.append(1) or known(a, b))
    parts, units = turns_of(40, 60)
    for strategy in ("dp", "words"):
        solve.forget()
        calls.clear()
        rows = solve.align_full(parts, units, strategy=strategy)
        assert len(rows) == len(units) and len(calls) < 20 * len(units)


def test_long_sequences_are_matched_in_little_memory(monkeypatch):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    some = [word() for _ in range(300)]
    heard = [rng.choice(some) for _ in range(3000)]
    reference = [rng.choice(some) for _ in range(700)]
    tracemalloc.start()
    found = solve.align_sequences(reference, heard)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 10e6  # 38 MB with a worth and a total kept for each pair
    monkeypatch.setattr(solve, "_CELLS", 10_000)
    assert solve.align_sequences(reference, heard) == found and sum(j is not None for j in found) > 300


def test_sequences_are_matched_as_all_pairs_say(monkeypatch):
    rng = random.Random(3)
    for _ in range(300):
        some = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(8)]
        a, b = [rng.choice(some) for _ in range(rng.randint(0, 12))], [rng.choice(some) for _ in range(rng.randint(0, 20))]
        worth = [[s if (s := solve.indel_ratio(x, y)) >= 0.6 else -1.0 for y in b] for x in a]
        best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                best[i][j] = max(best[i - 1][j - 1] + worth[i - 1][j - 1], best[i - 1][j], best[i][j - 1])
        monkeypatch.setattr(solve, "_CELLS", rng.choice([1, 30, 1 << 21]))
        monkeypatch.setattr(solve, "_BLOCK", rng.choice([1, 4, 1 << 15]))
        found = [(i, j) for i, j in enumerate(solve.align_sequences(a, b)) if j is not None]
        assert all(x[1] < y[1] for x, y in zip(found, found[1:]))
        assert abs(sum(worth[i][j] for i, j in found) - best[-1][-1]) < 1e-9


@pytest.mark.parametrize("strategy", ["dp", "greedy", "hybrid"])
def test_texts_of_runs_are_not_kept(strategy):
    parts, units = turns_of(60, 600)
    solve.forget()
    tracemalloc.start()
    rows = solve.align_full(parts, units, [(s.end, s.end + 0.25) for s in parts], strategy=strategy)
    most, kept = tracemalloc.get_traced_memory()[1], solve.plain.cache_info().currsize
    tracemalloc.stop()
    solve.forget()
    assert len(rows) == len(units) and kept > 0 == solve.plain.cache_info().currsize
    assert most < 25e6  # 45 to 71 MB where each run's text is kept
