"""The queries that apply the operators to whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard_join, language_id, packing, ppm, quality, rank_merge, token_store, topk, warc
from .shared import Scratch, id_remainder, read_table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = id_remainder("doc_id", 4) == 2
    model = language_id.fit(docs, ~held_out)
    return language_id.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, quality.fit(docs)).drop("text")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = rank_merge.token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=5, num=80, den=100)


OP4_SQL = r"""
WITH words AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents WHERE doc_id IS NOT NULL UNION ALL SELECT 'b', item_id, text FROM benchmark WHERE item_id IS NOT NULL),
     w AS (SELECT kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2f\x3a-\x60\x7b-\x7f]+'), lambda x: x <> '') AS words FROM words),
     s AS (SELECT DISTINCT kind, id, unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) AS shingle FROM w WHERE len(words) >= 5),
     n AS (SELECT id, count(*) AS item_shingles FROM s WHERE kind = 'b' GROUP BY id),
     c AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS contained FROM s b JOIN s d ON b.kind = 'b' AND d.kind = 'd' AND b.shingle = d.shingle GROUP BY ALL)
SELECT doc_id, item_id, contained::BIGINT AS contained, item_shingles::BIGINT AS item_shingles FROM c JOIN n ON c.item_id = n.id WHERE 100 * contained >= 80 * item_shingles
"""


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), window=1024, end_id=0)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(read_table(spark, sf_dir, "documents"), modulus=7, remainder=2)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_documents(read_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS words FROM documents),
     s AS (SELECT doc_id, CASE WHEN len(words) >= 3 THEN list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))
                               WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS set FROM w),
     e AS (SELECT doc_id, len(set) AS n, unnest(set) AS shingle FROM s),
     p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
           GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
     r AS (SELECT doc_id AS node, doc_id AS far FROM s UNION SELECT r.node, p.y FROM r JOIN p ON r.far = p.x),
     c AS (SELECT node, min(far) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, len(set)::BIGINT AS n_shingles, component_id FROM s JOIN c ON s.doc_id = c.node
"""


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_archives(read_table(spark, sf_dir, "pages"), Scratch(spark, "warc"), min_bytes=0)
    return warc.read_archives(spark, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS original FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(hex, (1 + 5 * (i // 4))::INTEGER, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM d
"""


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), query_every=50, k=5, scale=256.0)


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
           FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.write_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return store.read().select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_quality": op2_quality,
    "op3_token_counts": op3_token_counts,
    "op4_decontaminate": op4_decontaminate,
    "op5_packing": op5_packing,
    "op6_lm_score": op6_lm_score,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_warc": op8_warc,
    "op9_top_k": op9_top_k,
    "op10_token_store": op10_token_store,
}

ORACLE_SQL: dict[str, str] = {"op4_decontaminate": OP4_SQL, "op7_jaccard_join": OP7_SQL, "op8_warc": OP8_SQL, "op9_top_k": OP9_SQL}
