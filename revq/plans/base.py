"""The batch plan as one lazy DataFrame chain: documents -> reviews -> mentions.

``reviews`` is the store after a de-duplicating load into an empty store,
with the rows marked processed carrying the rule classifier's labels. The
rules are a projection on the scan, below the dedup (no join, no text shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revq.operators.classify import classify_rules
from revq.operators.dedup import first_per_key
from revq.operators.mentions import theme_mentions
from revq.schema import QUOTE_CHARS
from revq.sources.fixtures import reviews_in


def classify_processed(store: DataFrame) -> DataFrame:
    """Labels only on rows with ``processed = 1``; NULL labels elsewhere."""
    c = classify_rules(store)
    done = F.col("processed") == 1
    return (
        c.withColumn("sentiment", F.when(done, F.col("sentiment")))
        .withColumn("themes", F.when(done, F.col("themes")))
        .withColumn("confidence", F.when(done, F.col("confidence")))
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store: first row per key, classified where processed.

    The rules look at one row only, so they run on the scan; the dedup above
    shuffles the labels, and text and title are pruned where no query asks
    for them.
    """
    return first_per_key(classify_processed(reviews_in(spark, sf_dir)))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return theme_mentions(reviews(spark, sf_dir))


# columns the report sections need; text only where quotes are rendered
REPORT_COLS = [
    "arrival_seq", "review_id", "product_id", "source", "rating", "date",
    "ingested_at", "processed", "sentiment", "themes",
]


def report_reviews(spark: SparkSession, sf_dir: str, with_text: bool = False) -> DataFrame:
    """The columns the report sections need; of the text no more than a quote can show.

    Nothing runs before the query's own action: the sections read narrow,
    already classified rows, and equal exchanges are reused by the planner.
    """
    r = reviews_in(spark, sf_dir)
    if with_text:
        r = r.withColumn("quoted", F.substring("text", 1, QUOTE_CHARS + 1))
    r = first_per_key(classify_processed(r))
    if with_text:
        return r.select(*REPORT_COLS, F.col("quoted").alias("text"))
    return r.select(*REPORT_COLS)
