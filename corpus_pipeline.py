"""Corpus pipeline: raw documents to token ids, five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
to the shared folder and read again as the next one's input. All but the last
return the columns of ``documents``.

1. language_id    documents whose language no prototype tells go: no letter,
                  letters that training never met, or a cosine far under
                  that of texts of their length
2. near_dedup     one document of each near-duplicate group stays
3. secret_scan    documents that hold a secret, or linked parts of one, go
4. source_mix     documents come 0, 1 or 2 times, so that sources meet their targets
5. sentencepiece  piece ids of every document, a row per chunk

Nulls, empty texts, repeated rows and empty tables: as each operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revq.llm import language, minhash, mixing, secrets
from revq.llm import sentencepiece as pieces
from revq.llm.common import table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs, F.lit(True))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.without_secrets(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = pieces.encode(docs)
    return made.select("doc_id", "chunk", "n_chunks", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("sentencepiece", sentencepiece),
]

ORACLE_SQL = None  # sketched links and best paths are not SQL; tests/llm holds a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
