"""What must not depend on files, partitions, order or repetition; finds that are not records; long words."""

import gzip
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from versant.llm import decontaminate, language_id, quality, rank_merge, tallies, token_store, topk, warc
from versant.llm.shared import Scratch, shared_folder

FOLDER = "/root/testdata/sf0.001"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def test_models_do_not_depend_on_the_layout(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    other = docs.repartition(5).union(docs.limit(40)).orderBy(F.desc("text"))
    a, b = (language_id.fit(d, F.lit(True), per_language=512) for d in (docs, other))
    assert a.languages == b.languages and np.allclose(a.weights, b.weights) and (a.landmarks == b.landmarks).all()
    few = language_id.fit(docs, F.lit(True), most_languages=2)
    assert len(few.languages) == 2
    shuffled = docs.repartition(5).orderBy(F.desc("text"))
    a, b = (quality.fit(d, sample=100) for d in (docs, shuffled))
    assert np.allclose(a.weights, b.weights, atol=1e-4) and a.labels.good == pytest.approx(b.labels.good)


def test_posteriors_follow_from_the_label_model():
    rng = np.random.default_rng(2)
    patterns = rng.integers(0, 3, (50, len(quality.LABELLERS)))
    model = quality.estimate(patterns, np.ones(50), rounds=5)
    for p, found in zip(patterns, model.posterior(patterns)):
        good, bad = model.good, 1 - model.good
        for j, v in enumerate(p):
            good, bad = good * model.table[1, j, v], bad * model.table[0, j, v]
        assert found == pytest.approx(good / (good + bad), abs=1e-9)


def test_new_columns_replace_clashing_ones(spark):
    docs = spark.createDataFrame([(1, "some text here", "own", 0.5), (1, "some text here", "own", 0.5), (None, None, None, None)], "doc_id long, text string, Score string, keep double")
    model = language_id.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"), F.lit(True), per_language=16)
    rows = language_id.identify(docs, model).collect()
    assert rows[0] == rows[1] and rows[0].score >= 0 and rows[2].lang_pred == "und" and rows[0].keep == 0.5
    only = language_id.only_identified(docs, model, least=0.0).collect()
    assert [tuple(r) for r in only] == [(1, "some text here", "own", 0.5)] * 2
    classified = quality.classify(docs, quality.fit(docs))
    assert classified.columns == ["doc_id", "text", "Score", "quality_score", "keep"] and classified.count() == 3


def test_a_repeated_query_id_has_one_answer(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [256.0, 0.0]), (2, [0.0, 128.0]), (3, [1.0, 1.0])]
    answers = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(seed + 1)
        answers.add(tuple(sorted(map(tuple, topk.top_k(vectors, query_every=50, k=2).collect()))))
    assert answers == {((0, 1, 2, 128 * 65536), (0, 2, 3, 65536))}


def test_top_k_on_any_grid(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(400)]
    want = []
    for q in range(0, 400, 4):
        scored = sorted((-int(np.dot(np.array(rows[q][1]) * 256, np.array(v) * 256)), i) for i, v in rows if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:3])]
    for partitions in ("1", "4", "30"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7), query_every=4, k=3).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert sorted(map(tuple, got)) == sorted(want)


def test_finds_that_are_no_records_are_passed_over(tmp_path):
    page = warc.pack_record(3, "http://x", b"payload" * 50, None, False)
    stray = [b"\x1f\x8b\x08", b"\x1f\x8b\x08\x00garbage", gzip.compress(b"WARC/1.1 but no header"), gzip.compress(b"plain text" * 9), b"x" * 5000]
    whole = b"".join([stray[0], page, stray[1], stray[2], page, stray[3], stray[4], page])
    path = tmp_path / "a.warc.gz"
    path.write_bytes(whole)
    for split in (len(whole), 700, 64):
        found = [r for a in range(0, len(whole), split) for r in warc.read_range(str(path), a, min(a + split, len(whole)), chunk=256)]
        assert [warc.parse_record(r)[0] for r in found] == [3, 3, 3]
    path.write_bytes(page[:-20])
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.read_range(str(path), 0, len(page)))


def test_repeated_pages_and_foreign_paths(spark):
    pages = spark.createDataFrame([(1, "u", "same"), (1, "u", "same"), (2, "v", "same"), (None, None, None)], "page_id long, url string, html string")
    files = warc.write_archives(pages, Scratch(spark, "t"))
    for given in (files, [f["path"] for f in files]):
        rows = [(r.page_id, r.record_type, r.refers_to) for r in warc.read_archives(spark, given).collect()]
        assert sorted(rows, key=str) == sorted([(1, "response", None), (1, "response", None), (2, "revisit", 1), (None, "response", None)], key=str)
    assert warc.read_archives(spark, []).count() == 0


def test_keys_on_shard_borders(spark):
    docs = spark.createDataFrame([(7, f"text {i}") for i in range(40)] + [(i, "x") for i in range(5)], "doc_id long, text string")
    store = token_store.write_tokens(docs, WORD, end_id=1, shard_bytes=16)
    assert len(store.manifest) > 4 and sum(m["n_docs"] for m in store.manifest) == 45
    library = Tokenizer.from_file(WORD)
    want = sorted([*library.encode(f"text {i}", add_special_tokens=False).ids, 1] for i in range(40))
    assert sorted(x.tolist() for x in store.get(7)) == want and len(store.get(3)) == 1 and store.get(99) == []


def test_long_words():
    library, ours = Tokenizer.from_file(BYTE), rank_merge.TokenCounter(BYTE)
    rng = random.Random(3)
    texts = ["".join(rng.choice(alphabet) for _ in range(200_000)) for alphabet in ("etaoinshr", "a", "ab", "ABCdef0123+/=", "éèü")]
    assert ours(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    merger = rank_merge.RankMerger(BYTE)
    words = ["".join(rng.choice("aab") for _ in range(rng.randint(1, 700))).encode() for _ in range(40)]
    assert merger.counts(words).tolist() == merger._by_rounds(words).tolist() == merger._by_links(words).tolist()


def test_containment_near_the_bar(spark):
    rng = random.Random(12)
    word = lambda: f"w{rng.randint(0, 3000)}"
    items, texts = [], []
    for i in range(60):
        n = rng.choice((3, 8, 15, 30, 70))
        item = [word() for _ in range(n)]
        items.append((i, " ".join(item)))
        copy = list(item)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(n)] = "zz"
        texts.append(" ".join([word() for _ in range(rng.randint(0, 400))] + copy + [word() for _ in range(rng.randint(0, 400))]))
    bench = spark.createDataFrame([*items, items[0], (None, "null id")], "item_id long, text string")
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")

    def shingles(text, k):
        w = re.findall("[0-9a-z]+", text)
        return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}

    want = []
    for d, t in [*enumerate(texts), (0, texts[0])]:
        for i, x in [*items, items[0]]:
            k = min(5, len(x.split()))
            own = shingles(x, k)
            if 100 * len(own & shingles(t, k)) >= 80 * len(own):
                want.append((d, i, len(own & shingles(t, k)), len(own)))
    got = [tuple(r) for r in decontaminate.contaminations(docs, bench, block_items=25).collect()]
    assert sorted(got) == sorted(want) and len(want) > 15


def test_packed_counts_come_back():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 999).astype(np.uint64) * np.uint64(2))
    counts = rng.integers(1, 1 << 40, len(keys))
    found = [tallies.unpacked(k, c) for _, k, c in tallies.packed_rows(keys, counts, 7)]
    assert (np.concatenate([k for k, _ in found]) == keys).all() and (np.concatenate([c for _, c in found]) == counts).all()
    assert [len(x) for x in tallies.unpacked(*tallies.packed(keys[:0], counts[:0]))] == [0, 0]


def test_clusters_must_name_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})

    with pytest.raises(RuntimeError, match="must name a folder"):
        shared_folder(Session)
