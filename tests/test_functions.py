"""Text functions, similarity and costs on literal values."""

import random

import pytest
from pyspark.sql import functions as F

from versant.functions import costs, similarity
from versant.functions import text as T
from versant.operators import solve


def values(spark, rows, schema, **columns):
    return [r.asDict() for r in spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in columns.items()]).collect()]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _next(row, x, b)
    return row[-1]


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[-1]))
    return out


def test_indel_is_twice_the_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 12))) for _ in range(2))
        want = 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0
        assert similarity.indel_ratio(a, b) == pytest.approx(want)


def test_phonetic_golden_values():
    assert similarity.phonetic_word("تب", "طب") == pytest.approx(0.925)
    assert similarity.phonetic_word("تب", "كب") == pytest.approx(0.5)
    assert similarity.phonetic_word("", "كب") == 0.0
    assert similarity.phonetic_text("", "") == 0.0


def test_normalize(spark):
    rows = [("بِسْمِ اللَّهِ الرَّحْمَٰنِ الرَّحِيمِ",), ("أَعُوذُ!",), ("",), (None,), ("  a,  b\t",)]
    got = [r["n"] for r in values(spark, rows, "t string", n=T.normalize("t"))]
    assert got == ["بسم الله الرحمن الرحيم", "اعوذ", "", "", "a b"]
    assert [solve.plain(t or "") for (t,) in rows] == got


def test_words_and_overlap(spark):
    rows = [("بسم الله", "الله الرحمن"), ("a b", "a b"), ("", "x"), ("a", "")]
    got = values(spark, rows, "a string, b string", m=T.multiset_append("a", "b"), last=T.last_words("a", 1), c=T.coverage_ratio("a", "b"), j=T.word_jaccard("a", "b"))
    assert got[0]["m"].asDict() == {"merged": "بسم الله الرحمن", "overlap": True}
    assert got[1]["m"].asDict() == {"merged": "a b", "overlap": True}
    assert [g["last"] for g in got] == ["الله", "b", "", "a"]
    assert got[3]["c"] == 0.0 and got[1]["c"] == 1.0 and got[2]["j"] == 0.0
    for a, b in rows[:2]:
        assert solve.append_without_overlap(a, b)[1] is True


def test_types_and_file_names(spark):
    both = "أعوذ بالله من الشيطان الرجيم بسم الله الرحمن الرحيم"
    got = values(spark, [("ayah", both)], "k string, t string", s=T.segment_type("k", "t"), t=T.text_type("t"))
    assert got[0]["s"] == "basmala" and got[0]["t"]["kind"] == "istiadha" and got[0]["t"]["id"] == 0
    paths = [("001.mp3",), ("36.mp3",), ("surah_1_v2.mp3",), ("reciter_3_v5.mp3",), ("/path/to/audio/001.mp3",), ("000.mp3",), ("200.mp3",), ("no_number.mp3",)]
    assert [r["g"] for r in values(spark, paths, "p string", g=T.group_number("p"))] == [1, 36, 1, 3, 1, None, None, None]


def test_costs_agree(spark):
    rng = random.Random(3)
    rows = [(rng.random(), rng.random() * 2) for _ in range(50)]
    got = values(spark, rows, "s double, c double", k=costs.segment_cost(F.col("s"), F.col("c"), F.lit(False)))
    for (s, c), g in zip(rows, got):
        assert g["k"] == pytest.approx(costs.segment_cost_of(s, c, False))


def test_native_indel_agrees(spark):
    rng = random.Random(4)
    rows = [tuple("".join(rng.choice("abcd") for _ in range(rng.randint(0, 8))) for _ in range(2)) for _ in range(30)]
    got = values(spark, rows, "a string, b string", n=similarity.indel_native(F.col("a"), F.col("b")), p=similarity.indel("a", "b", normalized=False))
    assert all(g["n"] == pytest.approx(g["p"]) for g in got)
