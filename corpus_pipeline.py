"""A training corpus from raw documents: language identification, toxicity, near-duplicates, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents. Texts, labels and ids may be null, tables may be empty and may have
further columns: those are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from tidemark.llm import language, near_dedup, packing, toxicity
from tidemark.llm.store import dropped, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document with at least this toxicity score goes.
TOXIC = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or in none of the languages that documents name; keeps those with a letter where none names its own."""
    return language.known(docs, language.train(docs, evidence=True), COLUMNS)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops toxic documents; learns from the labels of those that are here."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, COLUMNS).where(F.col("score") < TOXIC).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group (five-word shingles, similarity 0.8 or more).

    Where doc_ids are null or clash, each row is a document of its own: unlike rows all stay, of a group the row with the
    least doc_id does, and one without doc_id only if none has any. Ties go to the least hash of the row.
    """
    docs = docs.select(*COLUMNS)
    if not docs.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count():
        kept = near_dedup.near_duplicates(docs, words=5, percent=80).where("kept").select("doc_id")
        # hashing the ids spares a sort of the texts
        return docs.join(kept.hint("shuffle_hash"), "doc_id").select(*COLUMNS)
    rows = written(docs.withColumn("row__", F.monotonically_increasing_id()), "near-rows")
    found = near_dedup.near_duplicates(rows.select(F.col("row__").alias("doc_id"), "text"), words=5, percent=80)
    order = rows.select("row__", F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64(*COLUMNS), "row__").alias("order__"))
    kept = found.select(F.col("doc_id").alias("row__"), "component_id").join(order, "row__").groupBy("component_id").agg(F.min("order__").alias("order__"))
    return rows.join(kept.select("order__.row__").hint("shuffle_hash"), "row__").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 1024 tokens: a row per piece, with its ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), added=True)


STAGES = [("language_id", language_id), ("toxicity", toxicity_filter), ("near_dedup", near_duplicates), ("packing", pack)]

#: Learned models and a byte-pair encoder are beyond SQL. Tests hold near-duplicates and packing against brute-force versions, the
#: learned stages against labels, and their models against plain ones (tests/llm/test_plain_twins.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if n:
            dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
