"""From raw documents to packed sequences: five stages over the table ``documents``.

Each stage works on all that the one before it kept, is written as Parquet and
read again.  All but the last return the columns of ``documents``.  Documents
that a stage rejects are gone for the stages after it; the last returns a row
for each piece of a packed document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versant.llm import decontaminate, jaccard_join, language_id, packing, quality
from versant.llm.shared import Scratch, hot_join, id_remainder, read_table


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification: documents without letters (null and empty texts among them) or without
    a clear language go.  Ids play no part but in choosing the rows to learn from."""
    model = language_id.fit(docs, id_remainder("doc_id", 4) != 2)
    return language_id.only_identified(docs, model, least=0.3)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents under its threshold go; a null text is judged as an empty one."""
    return quality.only_good(docs, quality.fit(docs))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates at 0.8 over five-word shingles: of each group the row with the smallest id stays,
    a null id counting as the largest.  Texts without words, null ones among them, are in no group and
    stay.  Rows are told apart by a number of their own, as ids may clash or be null."""
    scratch = Scratch(spark, "distinct")
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    doc_id, text = names[docs.columns.index("doc_id")], names[docs.columns.index("text")]
    numbered = scratch.table(plain.withColumn("row_number", F.monotonically_increasing_id()), "numbered")
    links = jaccard_join.link_documents(numbered, k=5, num=80, den=100, id_column="row_number", text_column=text).select(F.col("doc_id").alias("linked"), "component_id")
    ids = numbered.select("row_number", F.col(doc_id).alias("id"))
    grouped = scratch.table(ids.join(links, F.col("row_number") == F.col("linked")).select("row_number", "id", "component_id"), "grouped")
    first = grouped.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row_number")).alias("first"), F.count("*").alias("rows"))
    first = first.filter("rows > 1").select(F.col("component_id").alias("group"), F.col("first.row_number").alias("first_row"), "rows")
    first = scratch.table(first.select("group", "first_row", "rows"), "first")
    copies = hot_join(grouped, first, "component_id", "group", "rows").filter("row_number <> first_row").select("row_number")
    return without_rows(numbered, scratch.table(copies, "copies"), "row_number").drop("row_number").toDF(*docs.columns)


def without_rows(docs: DataFrame, gone: DataFrame, number: str, most_slots: int = 1 << 21) -> DataFrame:
    """``docs`` without the rows whose ``number`` is in ``gone``.  The hashed slots of these numbers, at most
    ``most_slots``, go to every task; only rows that fall into one of them are joined, so texts that
    certainly stay aren't shuffled."""
    slots = 1 << 10
    while slots < min(64 * gone.count(), most_slots):
        slots *= 2
    slot = F.pmod(F.xxhash64(number), F.lit(slots)).cast("int")
    taken = F.broadcast(gone.select(slot.alias("taken")).distinct())
    sure = docs.join(taken, slot == F.col("taken"), "left_anti")
    maybe = docs.join(taken, slot == F.col("taken"), "left_semi")
    return sure.union(maybe.join(gone, number, "left_anti").select(*docs.columns))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that contain a test item go; null texts contain none."""
    return decontaminate.without_contaminated(docs, read_table(spark, sf_dir, "benchmark"), k=5, num=80, den=100)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing into sequences of 1024 ids: a row for each piece; a null text is its end id alone."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), window=1024, end_id=0)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("language_id", keep_identified),
    ("quality", keep_good),
    ("jaccard_join", keep_distinct),
    ("decontaminate", keep_uncontaminated),
    ("packing", pack),
]

#: The classifiers and the packing order are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = scratch.table(docs, name)
            scratch.drop(*[earlier for earlier, _ in STAGES[:n]])
    return docs
