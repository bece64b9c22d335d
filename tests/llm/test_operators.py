"""The operators against brute force, with nulls, empty and repeated rows and extra columns."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from versant.llm import decontaminate, jaccard_join, language_id, packing, ppm, quality, rank_merge, token_store, topk, warc
from versant.llm.chunk_tokens import TextIds
from versant.llm.components import connected_components
from versant.llm.shared import Scratch, id_remainder
from versant.llm.text_arrays import Words, shingle_sets

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECES = [" ", "  ", "\n", "\t", "a", "the", "É", "ß", "İ", "Σ", "1", "23", "²", "<|endoftext|>", "<", "|>", " ", " ", "é", "中文", "!", "...", "'s", "\x1c", "\r\n", "\x85", "🙂", "Word"]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def docs_of(spark, texts, first=0):
    rows = [(first + i, t, "x", i) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "a text without id", "x", 0)], "doc_id long, text string, ids string, start int")


TEXTS = ["", None, "   ", "one", "The cat sat on the mat.", "The cat sat on the mat.", "x" * 3000, "a b " * 2000, *odd_texts(40)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_are_the_librarys(path):
    library, ours = Tokenizer.from_file(path), TextIds(path)
    for t in odd_texts(3000):
        assert np.frombuffer(ours(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_at_line_feeds_and_marks_with_a_full_cache(path):
    library, ours, rng = Tokenizer.from_file(path), TextIds(path), random.Random(2)
    ours._pieces._capacity = 8
    parts = [*PIECES, *[" ", "\n"] * 8, "Die", "word", "ñu", "x", ",", ".", "'", "'re", "$$$", "\n\n", " \n", "\n ", "\u00a0", "\u2028", "\u0301", "÷"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(ours(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_common_pieces_outlast_a_full_cache(path):
    ours, asked = TextIds(path), []
    pieces = ours._pieces
    model, pieces._capacity = pieces._model, 100
    pieces._model = type("Asked", (), {"tokenize": lambda self, word: asked.append(word) or model.tokenize(word)})()
    letters = [chr(97 + i % 26) + chr(97 + i // 26 % 26) + chr(97 + i // 676) for i in range(2020)]
    common, rare = letters[:20], letters[20:]
    for at in range(0, 2000, 50):
        ours(" ".join(["", *common, *rare[at : at + 50]]))
    assert len(asked) == 2020  # each word once


def test_cache_holds_a_word_once_and_no_pairs_of_lines():
    words = [chr(97 + i % 26) + chr(97 + i // 26) for i in range(40)]
    ours = TextIds(BYTE)
    for word in words:
        ours(" ".join(["", *[f"{word}\n{other}" for other in words]]))
    assert len(ours._pieces) + len(ours._pieces._words) <= 3 * len(words) + 1


def test_token_counts(spark):
    library = Tokenizer.from_file(BYTE)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in rank_merge.token_counts(docs_of(spark, TEXTS), BYTE).collect())
    want = sorted((False, i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(TEXTS))
    assert got[:-1] == want and got[-1][0]
    assert rank_merge.token_counts(docs_of(spark, TEXTS).limit(0), BYTE).count() == 0


def test_packing_holds_every_id_once(spark):
    library = Tokenizer.from_file(BYTE)
    rows = packing.pack(docs_of(spark, TEXTS), BYTE, window=64).collect()
    for i, t in enumerate(TEXTS):
        want = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in mine for x in np.frombuffer(r.ids, "<u4").tolist()] == want
        assert all(r.doc_tokens == len(want) and r.length == len(r.ids) // 4 for r in mine)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for n, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or n == max(sequences)


def test_token_store_round_trip(spark):
    library = Tokenizer.from_file(WORD)
    texts = [*TEXTS, *odd_texts(60, 5)]
    docs = docs_of(spark, texts).unionByName(docs_of(spark, ["again"], 4))
    store = token_store.write_tokens(docs, WORD, end_id=1, shards=3)
    rows = sorted(store.read().collect(), key=lambda r: r.start)
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    keys = [r.doc_id for r in rows if r.doc_id is not None]
    assert keys == sorted(keys) and len(rows) == docs.count()
    for i, t in enumerate(texts):
        want = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert any(x.tolist() == want for x in store.get(i))
    assert len(store.get(4)) == 2 and store.get(10**9) == []


def test_token_store_writes_shards_alone(spark):
    store = token_store.write_tokens(docs_of(spark, TEXTS), WORD, end_id=1, shards=3)
    folder = Path(store.manifest[0]["path"].removeprefix("file://")).parents[1]
    assert sorted(map(str, (f for f in folder.rglob("*") if f.is_file()))) == sorted(m["path"].removeprefix("file://") for m in store.manifest)


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(0).integers(-(2**62), 2**62, 5000))
    assert sorted(token_store.PerfectHash.build(keys).slots(keys).tolist()) == list(range(len(keys)))


def test_warc_round_trip_at_any_split(spark):
    html = ["<p>one</p>", "<p>one</p>", None, "", "é" * 5000, "<p>one</p>", *[f"<p>{i}</p>" * i for i in range(60)]]
    pages = spark.createDataFrame([(i, None if i == 3 else f"http://x/{i} é%\n", h, 1) for i, h in enumerate(html)], "page_id long, url string, html string, digest int")
    files = [f["path"] for f in warc.write_archives(pages, Scratch(spark, "t"), archive_bytes=2000)]
    smallest = {}
    for i, h in enumerate(html):
        smallest.setdefault(h or "", i)
    for split in (97, 1 << 20):
        rows = {r.page_id: r for r in warc.read_archives(spark, files, split).collect()}
        assert len(rows) == len(html)
        for i, h in enumerate(html):
            r, first = rows[i], smallest[h or ""]
            assert (r.record_type, r.refers_to) == (("response", None) if first == i else ("revisit", first))
            assert r.payload_bytes == len((h or "").encode()) and r.payload_digest == warc.digest((h or "").encode())
            assert r.url == (None if i == 3 else f"http://x/{i} é%\n")
    big = {r.page_id: r for r in warc.read_archives(spark, [f["path"] for f in warc.write_archives(pages, Scratch(spark, "t"), min_bytes=1)]).collect()}
    assert big[3].record_type == "response" and big[1].record_type == "revisit"


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(120)] + [(120, None), (121, [1.0, None] + [0.0] * 4), (122, [float("nan")] * 6), (123, [1.0, 2.0]), (100, [1.0] * 6), (130, [3e9] * 6), (131, [3e9] * 6)]
    got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 50).collect())
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for q in {i for i, _ in sound if i % 50 == 0}:
        own = next(v for i, v in sound if i == q)
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in sound if i != q and len(v) == len(own))[:5]
        if q != 100:  # two rows have this id; one of them is the query
            want |= {(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)}
    assert {g for g in got if g[0] != 100} == want and sum(g[0] == 100 for g in got) == 5


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def test_words_and_shingles():
    texts = [t or "" for t in TEXTS]
    found = Words(pa.array(texts))
    assert np.diff(found.first).tolist() == [len(words_of(t)) for t in texts]
    for t, s in zip(texts, shingle_sets(found, 3)):
        w = words_of(t)
        want = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
        assert len(s) == len(want)


def near_texts(rng):
    texts = ["", None, "a b", "a b", "A  b\n"]
    for size in (6, 12, 13, 25, 60, 200):
        base = [f"w{rng.randint(0, 400)}" for _ in range(size)]
        for _ in range(9):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + size // 40)):
                copy[rng.randrange(size)] = f"z{rng.randint(0, 9)}"
            texts.append(" ".join(copy[rng.randint(0, 1) :]))
    return texts


def word_sets(texts, k):
    sets = []
    for t in texts:
        w = words_of(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return sets


def components_of(sets, num, den):
    label, changed = list(range(len(sets))), True
    while changed:
        changed = False
        for i in range(len(sets)):
            for j in range(len(sets)):
                if label[j] < label[i] and sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                    label[i], changed = label[j], True
    return label


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 80, 100)])
def test_jaccard_join(spark, k, num, den):
    texts = near_texts(random.Random(7))
    sets = word_sets(texts, k)
    rows = jaccard_join.link_documents(docs_of(spark, texts), k, num, den, tile_shingles=300).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows if r.doc_id is not None) == [(i, len(s), c) for i, (s, c) in enumerate(zip(sets, components_of(sets, num, den)))]
    assert [r.component_id for r in rows if r.doc_id is None] == [None]


@pytest.mark.parametrize("light,settings", [(1, {"tile_sets": 3}), (14, {"max_known": 50}), (None, {"max_known": 0, "tile_shingles": 200})])
def test_jaccard_join_settings_change_costs_only(spark, monkeypatch, light, settings):
    texts = near_texts(random.Random(11))
    sets = word_sets(texts, 3)
    if light:
        monkeypatch.setattr(jaccard_join, "boundary", lambda *_: light)
    rows = jaccard_join.link_documents(docs_of(spark, texts), 3, 90, 100, **settings).filter("doc_id is not null").collect()
    assert {r.doc_id: r.component_id for r in rows} == dict(enumerate(components_of(sets, 90, 100)))


def test_jaccard_join_of_odd_tables(spark):
    rows = [(4, "One two three four", 1, "x"), (4, "one two three four", 1, "x"), (2, "one two three four", 2, "y"), (4, "other words here", 3, None), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, key string")
    got = sorted(map(tuple, jaccard_join.link_documents(docs, 3, 90, 100).collect()), key=str)
    assert got == sorted([(4, 2, 2), (4, 2, 2), (2, 2, 2), (4, 1, 4), (None, 0, None)], key=str)
    assert jaccard_join.link_documents(docs.limit(0), 3, 90, 100).count() == 0


def test_a_tile_with_one_long_set_stays_small():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in [*[200] * 4000, 10_000]]
    sets.append(np.unique(np.append(sets[5][:-3], np.uint64(9))))
    tracemalloc.start()
    found = jaccard_join.linking_pairs(sets, np.arange(0, len(sets), 2), np.arange(1, len(sets), 2), 90, 100)
    found += jaccard_join.linking_pairs(sets, np.arange(1, len(sets), 2), None, 90, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [{5, 4001}] == [set(p) for p in found] and peak < 120 << 20


def test_subset_keys_meet():
    for n in range(1, 31):
        for m in range(1, n + 1):
            c = jaccard_join.least_overlap(n, m, 90, 100)
            if c <= m:
                assert c in jaccard_join.subset_sizes(n, 90, 100) and c in jaccard_join.subset_sizes(m, 90, 100)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), *[(20, i) for i in range(21, 60)], *[(i, i + 1) for i in range(100, 140)], (5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    assert {got[i] for i in (1, 2, 3)} == {1} and {got[i] for i in (6, 7, 8, 9)} == {6} and {got[i] for i in range(100, 141)} == {100} and got[59] == 20


def test_contamination(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randint(0, 5000)}"
    items = [(i, " ".join(word() for _ in range(n)), 1) for i, n in enumerate((3, 6, 20, 40, 130))] + [(90, None, 1), (91, "  ", 1)]
    texts = [None, ""]
    for i, t, _ in items[:5]:
        noise = [word() for _ in range(3000)]
        texts += [" ".join(noise[:1500] + t.upper().split() + noise[1500:]), " ".join(noise), " ".join(noise[:9]) + ", " + t.replace(" ", ", ")]
        half = t.split()
        texts.append(" ".join(noise[:50] + half[: len(half) // 2] + noise[50:99]))
    bench = spark.createDataFrame(items, "item_id long, text string, doc_id int")
    docs = docs_of(spark, texts)
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminations(docs, bench).collect()}
    want = {(2 + 4 * i + j, i) for i in range(5) for j in (0, 2)}
    assert found == want
    left = {r.doc_id for r in decontaminate.without_contaminated(docs, bench).collect()}
    assert left == {None, *range(len(texts))} - {d for d, _ in want}
    assert decontaminate.contaminations(docs, bench.limit(0)).count() == 0


def test_language_id(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = id_remainder("doc_id", 4) == 2
    model = language_id.fit(docs, ~held, per_language=64)
    rows = language_id.identify(docs.select("doc_id", "lang", "text", held.alias("held")), model).collect()
    held_out = [r for r in rows if r.held]
    assert sum(r.lang == r.lang_pred for r in held_out) >= 0.98 * len(held_out) and all(0 <= r.score <= 1 for r in rows)
    odd = language_id.identify(spark.createDataFrame([(1, None), (2, ""), (3, "12 !?")], "doc_id long, text string"), model).collect()
    assert {(r.lang_pred, r.score) for r in odd} == {("und", 0.0)}
    empty = language_id.fit(docs.limit(0), ~held)
    assert {r.lang_pred for r in language_id.identify(docs.limit(3), empty).collect()} == {"und"}


def test_quality(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.fit(docs)
    keep = {r.doc_id: r.keep for r in quality.classify(docs, model).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    good = [keep[r.doc_id] for r in labels if r.quality == 1]
    bad = [keep[r.doc_id] for r in labels if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)
    assert quality.classify(docs.limit(0), quality.fit(docs.limit(0))).count() == 0


def test_lm_scores(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [(5, None), (None, ""), (9, "  ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in [*words_of(t), "\n"])
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i), len(words_of(t)) + 1, sum(w in counts for w in [*words_of(t), "\n"]), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*words_of(t), "\n"]), 5)) for i, t in rows)
    for most in (500_000, 200):
        got = ppm.score_documents(docs, max_words=most).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
        assert all(r.score < 0 for r in got)


def test_trie_probabilities_sum_to_one():
    text, begins = ppm.normalized(Words(pa.array(["the cat", "the hat", "", "é then"])), 3)
    keys, counts = np.unique(ppm.grams(text, begins, 3), return_counts=True)
    trie = ppm.Trie(keys, counts.astype(np.int64), 3)
    alphabet = [b for b in range(256) if b not in (9, 11, 12, 13)]
    for context in (0x746865, 0x0A0A0A, 0xFF01FF):
        assert (10 ** trie.log10(np.array([(context << 8) | b for b in alphabet], np.uint64))).sum() == pytest.approx(1.0)


def test_lm_scores_use_every_string(spark):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 25))) for _ in range(60)]
    texts[3] += " zq xylophone"
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    line = lambda t: b"\n" * 5 + (" ".join(words_of(t)) + "\n").encode()
    after = {}
    for t, out in zip(texts, held):
        b = line(t)
        for i in range(5, len(b) if not out else 0):
            for k in range(6):
                after.setdefault(b[i - k : i], Counter())[b[i]] += 1

    def log10(context, byte):
        total, gone = 0.0, set()
        for k in range(5, -1, -1):
            seen = after.get(context[5 - k :], {})
            left = {x: c for x, c in seen.items() if x not in gone}
            if left:
                n = sum(left.values())
                if byte in left:
                    return total + math.log10((left[byte] - 0.5) / n)
                total += math.log10(0.5 * len(left) / n)
            gone |= set(seen)
        return total - math.log10(252 - len(gone))

    want = {i: sum(log10(b[j - 5 : j], b[j]) for j in range(5, len(b))) for i, b in enumerate(map(line, texts))}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (1_000_000, 40, 0):
        got = {r.doc_id: r.score for r in ppm.score_documents(docs, max_grams=most).collect()}
        assert got == pytest.approx(want)
    assert {r.score for r in ppm.score_documents(docs, modulus=1, remainder=0).filter("n_tokens = 1").collect()} <= {-math.log10(252)}


def test_token_store_notices_a_broken_index(spark):
    store = token_store.write_tokens(docs_of(spark, odd_texts(30)), WORD, end_id=1, shards=1)
    path = store.manifest[0]["path"].removeprefix("file://")
    assert store.read().count() == 31
    shard = token_store.Shard(path)
    data = bytearray(open(path, "rb").read())
    at = bytes(data).rindex(shard._slots.tobytes())
    data[at + 4 : at + 8] = (int(shard._slots[0, 1]) ^ 1).to_bytes(4, "little")
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="differs from its keys"):
        store.read().collect()
