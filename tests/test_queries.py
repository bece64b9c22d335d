"""Queries against their SQL in DuckDB on the smallest tables."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from versant.functions import similarity
from versant.operators import boundaries, solve
from versant.plans import report
from versant.operators.solve import plain as T_plain
from versant.plans.queries import ORACLE_SQL, QUERIES, _pairs
from versant.plans.roles import FRAMES_SQL, RESULTS_SQL, SILENCES_SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rounded(rows):
    return sorted(str([round(float(v), 5) if isinstance(v, float) or type(v).__name__ == "Decimal" else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    got = QUERIES[name](spark, FOLDER)
    names = sorted(got.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = con.sql(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert want and rounded([tuple(r) for r in got.select(*names).collect()]) == rounded(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def whole_turns(spark, folder=FOLDER):
    turns = {}
    for r in sorted(spark.read.parquet(f"{folder}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn, r.text)):
        turns.setdefault(r.conv_id, []).append(r)
    return turns


@pytest.mark.parametrize("name,strategy,options", [("align_dp", "dp", {}), ("align_greedy", "greedy", {}), ("align_hybrid", "hybrid", {}), ("align_words", "words", {}), ("align_raw", "dp", {"fix_drift": False, "snap_silence": False, "repair": False})])
def test_alignment_takes_whole_texts(spark, name, strategy, options):
    want = []
    for recording, turns in whole_turns(spark).items():
        at, parts = 0, []
        for r in turns:
            parts.append(solve.Segment(r.text, at / 16, (at + len(r.text)) / 16))
            at += len(r.text)
        units = [solve.Unit(r.turn + 1, r.text) for r in turns if r.role == "user"]
        found = solve.align_full(parts, units, [(s.end - 0.125, s.end + 0.125) for s in parts], strategy=strategy, **options)
        want += [(recording, r.unit.number, r.text, r.start, r.end, r.score) for r in found]
    got = [(r.recording, r.unit_no, r.text, r.start_s, r.end_s, r.score) for r in QUERIES[name](spark, FOLDER).collect()]
    assert sorted(got) == sorted(want) and any(len(w[2]) > 1000 for w in want)


def test_words_are_whole_and_numbered_apart(spark, tmp_path):
    rng = random.Random(6)
    turns = [(7, t, role, " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n))) for t, (role, n) in enumerate([("user", 30), ("assistant", 40), ("user", 1100), ("assistant", 20), (None, 3)])]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    mine, other, at = [], [], 0
    for _, _, role, text in turns:
        for word in text.split():
            at += 1
            (mine if role == "user" else other).append((at, word))
    found = solve.align_sequences([w for _, w in mine], [w for _, w in other])
    want = [(7, i, None if j is None else other[j][0]) for (i, _), j in zip(mine, found)]
    assert sorted(map(tuple, QUERIES["match_words"](spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)
    rows = sorted(QUERIES["word_gap_smoothing"](spark, str(tmp_path)).collect(), key=lambda r: r.place)
    assert [r.place for r in rows] == list(range(1, at + 1))
    assert [r.unit for r in rows] == [t for _, t, _, text in turns for _ in text.split()]


@pytest.mark.parametrize("name", ["indel_similarity", "indel_native"])
def test_indel_of_whole_texts(spark, tmp_path, name):
    rng = random.Random(8)
    start = "the same twenty letters and "
    texts = [start + "".join(rng.choice("abc é") for _ in range(rng.randint(0, 40))) for _ in range(8)] + ["", "x", start]
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    want = [(i, 2 * common(a, b) / (len(a) + len(b))) for i, (a, b) in enumerate(zip(texts, texts[1:]))]
    pairs = spark.createDataFrame(list(enumerate(zip(texts, texts[1:]))), "turn long, p struct<a: string, b: string>")
    native = pairs.select("turn", similarity.indel_native(F.col("p.a"), F.col("p.b")).alias("ratio"))
    found = native if name == "indel_native" else QUERIES[name](spark, str(tmp_path))
    got = sorted((r.turn, r.ratio) for r in found.collect())
    assert [i for i, _ in got] == [i for i, _ in want] and [x for _, x in got] == pytest.approx([x for _, x in want])
    assert any(0.5 < x < 1 for _, x in got)


def test_no_rows_are_left_out(spark):
    assert QUERIES["csv_lines"](spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/events.parquet").count()
    assert QUERIES["word_multiset"](spark, FOLDER).filter("n = 1").count() > 0


def test_csv_ties_go_away_from_zero(spark):
    rows = spark.createDataFrame([(1, 0.125, 0.375, "x"), (2, -0.125, 2.5, "x")], "u long, s double, e double, t string")
    assert [r[0] for r in rows.select(report.csv_line("u", "s", "e", "t")).collect()] == ['1,0.13,0.38,"x"', '2,-0.13,2.50,"x"']


def timed_rows(con):
    rows = {}
    for user, number, start, end in con.sql(f"WITH {RESULTS_SQL} SELECT user_id, unit_no, start_s, end_s FROM res ORDER BY user_id, unit_no").fetchall():
        rows.setdefault(user, []).append([number, start, end])
    return rows


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return found


def test_snapping_by_definition(spark, con):
    quiet, energy, want, want_energy = {}, {}, [], []
    for user, a, b in con.sql(f"WITH {SILENCES_SQL} SELECT user_id, silence_start, silence_end FROM sil ORDER BY ALL").fetchall():
        quiet.setdefault(user, []).append((a, b))
    for user, t, rms in con.sql(f"WITH {FRAMES_SQL} SELECT user_id, t * 12, rms FROM frames ORDER BY ALL").fetchall():
        energy.setdefault(user, []).append((t, rms))
    for user, rows in timed_rows(con).items():
        plain, level = [list(r) for r in rows], [list(r) for r in rows]
        for x, y in zip(plain, plain[1:]):
            border = (x[2] + y[1]) / 2
            a, b = min(quiet.get(user, [(1e9, 1e9)]), key=lambda s: abs((s[0] + s[1]) / 2 - border))
            if abs((a + b) / 2 - border) <= 2 and a > x[1] and b < y[2]:
                x[2], y[1] = round(a, 2), round(b, 2)
        for x, y in zip(level, level[1:]):
            border = (x[2] + y[1]) / 2
            near = [e for e in energy[user] if abs(e[0] - border) <= 1]
            t = min(near, key=lambda e: e[1])[0] if near else None
            if t is not None and x[1] + 0.1 < t < y[2] - 0.1:
                x[2] = y[1] = round(t, 3)
        want += [(user, *r) for r in plain]
        want_energy += [(user, *r) for r in level]
    assert sorted(map(tuple, QUERIES["snap_silences"](spark, FOLDER).collect())) == sorted(want)
    assert sorted(map(tuple, QUERIES["snap_energy"](spark, FOLDER).collect())) == sorted(want_energy)
    assert want != want_energy


def test_breaths_are_claimed_once_each(spark, con):
    quiet, want = {}, []
    for user, a, b in con.sql(f"WITH {SILENCES_SQL} SELECT user_id, silence_start, silence_end FROM sil ORDER BY ALL").fetchall():
        quiet.setdefault(user, []).append((a, b))
    for user, rows in timed_rows(con).items():
        free = list(quiet.get(user, []))
        for number, _, end in rows:
            able = [x for x in free if min(abs(x[0] - end), abs(x[1] - end)) <= 0.8 or x[0] - 0.5 <= end <= x[1] + 0.5]
            taken = min(able, key=lambda x: (min(abs(x[0] - end), abs(x[1] - end)), free.index(x)), default=None)
            if taken:
                free.remove(taken)
            want.append((user, number, taken[1] - taken[0] if taken else 0.0, taken is not None))
    got = sorted(map(tuple, QUERIES["claim_breaths"](spark, FOLDER).collect()))
    assert got == sorted(want) and any(r[3] for r in got) and not all(r[3] for r in got)


def test_pair_scores_by_definition(spark):
    pairs = {(r.conv_id, r.turn): (T_plain(r.a), T_plain(r.b)) for r in _pairs(spark, FOLDER).collect()}
    phonetic = {(r.conv_id, r.turn): r.phonetic for r in QUERIES["phonetic_similarity"](spark, FOLDER).collect()}
    borders = {(r.conv_id, r.turn): (r.starts, r.ends) for r in QUERIES["boundary_match"](spark, FOLDER).collect()}
    assert set(pairs) == set(phonetic) == set(borders)
    for key, (a, b) in pairs.items():
        x, y = a.split(), b.split()
        n = min(3, len(y))
        assert phonetic[key] == pytest.approx(similarity.phonetic_text(a, b))
        ends = similarity.indel_ratio(" ".join(x[-n:]), " ".join(y[-n:])) >= 0.6
        assert borders[key] == (similarity.indel_ratio(" ".join(x[:n]), " ".join(y[:n])) >= 0.6, ends)


def test_gaps_are_closed_alike_in_pieces(spark, monkeypatch):
    rows = spark.range(203).selectExpr("case when id < 200 then 1 else 2 + id % 3 end as recording", "id as place", "id div 7 as unit", "double(id) * 0.5 as s", "double(id) * 0.5 + (id % 5) / 6d as e")
    results = []
    for size in (1, 64, 1000):
        monkeypatch.setattr(boundaries, "_PIECE", size)
        results.append(sorted(map(tuple, boundaries.smooth_gaps(rows, "recording", "place", "unit", "s", "e", F.lit(0.0)).collect())))
    assert results[0] == results[1] == results[2] and sorted(r[1] for r in results[0]) == list(range(203))
    assert all(a[4] <= b[3] + 1e-9 for a, b in zip(results[0], results[0][1:]) if a[0] == b[0])
