"""The pipeline's stages, each on the one before's output, against plain Python."""

import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from versant.llm.shared import hot_join

FOLDER = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def plain_shingles(text):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    columns, outputs = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == columns
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        outputs.append({r.doc_id: r.text for r in rows})
    identified, good, distinct, clean = outputs
    assert sum(i in identified for i in labels) == len(labels)
    kept = [labels[i] for i in good if i in labels]
    assert sum(kept) >= 0.95 * sum(labels.values()) and kept.count(0) <= 0.2 * list(labels.values()).count(0)

    sets = {i: shingles(t) for i, t in good.items()}
    label, changed = {i: i for i in sets}, True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if label[j] < label[i] and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    label[i], changed = label[j], True
    assert set(distinct) == {i for i in label if label[i] == i}

    items = [plain_shingles(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    dirty = {i for i, t in distinct.items() if any(5 * len(s & plain_shingles(t)) >= 4 * len(s) for s in items if s)}
    assert set(clean) == set(distinct) - dirty

    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in clean.items()}
    assert {r.doc_id: r.doc_tokens for r in pieces} == sizes and sum(r.length for r in pieces) == sum(sizes.values())
    assert np.max([r.offset + r.length for r in pieces]) <= 1024


def test_clashing_ids_keep_every_distinct_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(5, a), (5, b), (3, a), (None, c), (None, c), (None, b + " more"), (7, ""), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.keep_distinct(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(3, a), (5, b), (None, c), (7, ""), (7, None)], key=str)


def test_stages_of_odd_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    text = docs.select("text").first().text
    odd = [(None, text, 0.123, "a"), (5, text, 0.2, None), (5, text, 0.2, None), (6, None, 0.3, "b"), (7, "", 0.4, "c"), (8, "x " * 50_000, 0.5, "d")]
    extra = spark.createDataFrame(odd, "doc_id long, text string, score double, lang_pred string")
    docs = docs.selectExpr("doc_id + 100 AS doc_id", "text", "cast(doc_id AS double) AS score", "'own' AS lang_pred").union(extra)
    docs = docs.selectExpr("*", "lang_pred AS lang", "'q' AS keep", "'r' AS row_number", "'s' AS `a.b`")
    before = {tuple(r) for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, FOLDER)
        assert rows.columns == docs.columns and {tuple(r) for r in rows.collect()} <= before
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
    kept = sorted(map(tuple, corpus_pipeline.keep_distinct(spark, extra, FOLDER).collect()), key=str)
    assert kept == sorted([odd[1], *odd[3:]], key=str)
    assert corpus_pipeline.pack(spark, docs.limit(0), FOLDER).count() == 0
    pieces = corpus_pipeline.pack(spark, extra, FOLDER).collect()
    assert sum(r.length for r in pieces if r.doc_id in (6, 7)) == 2


def test_hot_join_is_a_left_join(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}") for i in range(3000)] + [(-1, None)], "id long, key string")
    table = rows.filter("key <> 'k6'").groupBy("key").count().selectExpr("key AS name", "count AS rows", "concat(key, '!') AS value")
    want = {(r.id, r.value) for r in rows.join(table, rows.key == table.name, "left").collect()}
    got = hot_join(rows, table, "key", "name", "rows").collect()
    assert len(got) == 3001 and {(r.id, r.value) for r in got} == want
