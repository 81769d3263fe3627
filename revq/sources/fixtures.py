"""Table loading and the derived ``reviews_in`` relation.

``reviews_in`` turns the driver's ``documents`` table into review rows (see
FIXTURES.md §2). Every operator downstream reads it, so its cost grows with
``documents``. Only the needed columns are read; the projection is narrow
(no shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def reviews_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw review batch derived from ``documents`` (about 30% repeat a key).

    Columns: arrival_seq, product_id, reviewer_id, review_id, rating, title,
    text, date (raw text), source, ingested_at (TIMESTAMP_NTZ), processed.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars")
    return from_documents(d)


def from_documents(d: DataFrame) -> DataFrame:
    doc = F.col("doc_id")
    b = F.when(doc % 10 >= 7, doc - 7).otherwise(doc)
    y = d.withColumn("b", b)
    x = y.select(
        F.col("doc_id").alias("arrival_seq"),
        F.concat(F.lit("prod_"), (F.col("b") % 4).cast("string")).alias("product_id"),
        F.concat(F.lit("u"), F.col("b").cast("string")).alias("reviewer_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("b") % 60).cast("int"))
        .cast("string")
        .alias("date"),
        F.date_add(F.lit("2024-01-03").cast("date"), (doc % 60).cast("int"))
        .cast("timestamp_ntz")
        .alias("ingested_at"),
        F.when(doc % 23 == 0, F.lit(None).cast("int"))
        .when(doc % 29 == 0, F.lit(0))
        .otherwise((F.lit(1) + F.col("n_chars") % 5).cast("int"))
        .alias("rating"),
        F.substring_index("text", "\n", 1).alias("title"),
        "text",
        "source",
        F.when(doc % 10 == 0, F.lit(0)).otherwise(F.lit(1)).alias("processed"),
    )
    from revq.functions.keys import review_key

    return x.select(
        "arrival_seq",
        "product_id",
        "reviewer_id",
        review_key("reviewer_id", "date", "product_id").alias("review_id"),
        "rating",
        "title",
        "text",
        "date",
        "source",
        "ingested_at",
        "processed",
    )


# Portable SQL of the same relation (Spark SQL and DuckDB); used by oracles.
REVIEWS_IN_SQL = """
SELECT doc_id AS arrival_seq, product_id, reviewer_id,
       md5(concat(reviewer_id, date, product_id)) AS review_id,
       rating, title, text, date, source, ingested_at, processed
FROM (SELECT doc_id, text, source,
   concat('prod_', CAST(b % 4 AS STRING))                               AS product_id,
   concat('u', CAST(b AS STRING))                                       AS reviewer_id,
   CAST(DATE '2024-01-01' + CAST(b % 60 AS INT) AS STRING)              AS date,
   CAST(DATE '2024-01-03' + CAST(doc_id % 60 AS INT) AS TIMESTAMP)      AS ingested_at,
   CASE WHEN doc_id % 23 = 0 THEN NULL WHEN doc_id % 29 = 0 THEN 0
        ELSE CAST(1 + n_chars % 5 AS INT) END                           AS rating,
   split_part(text, chr(10), 1)                                         AS title,
   CASE WHEN doc_id % 10 = 0 THEN 0 ELSE 1 END                          AS processed
 FROM (SELECT d.*, CASE WHEN doc_id % 10 >= 7 THEN doc_id - 7 ELSE doc_id END AS b
       FROM documents d) y) x
"""
