"""Store statistics.

``stats_grouping_sets`` computes every breakdown in one scan with GROUPING
SETS; ``grouping_id`` separates a real NULL group (e.g. unprocessed rows have
NULL sentiment) from the rolled-up NULL of another set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revq.functions.text import safe_pct
from revq.operators.joins import join_dimension

DIMS = ["product_id", "sentiment", "source", "processed"]


def stats_overview(reviews: DataFrame) -> DataFrame:
    """total / processed / unprocessed in one pass."""
    return reviews.agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.count_if(F.col("processed") == 1).alias("processed_count"),
        F.count_if(F.col("processed") == 0).alias("unprocessed_count"),
    )


def count_by(reviews: DataFrame, col: str, drop_null: bool = False) -> DataFrame:
    r = reviews.filter(F.col(col).isNotNull()) if drop_null else reviews
    return r.groupBy(col).agg(F.count(F.lit(1)).alias("cnt"))


def stats_grouping_sets(reviews: DataFrame) -> DataFrame:
    """Long form (dimension, value, cnt) of all breakdowns, one scan."""
    r = reviews.select(*[F.col(c).cast("string").alias(c) for c in DIMS])
    g = r.groupingSets([[c] for c in DIMS] + [[]], *DIMS).agg(
        F.count(F.lit(1)).alias("cnt"), F.grouping_id().alias("gid")
    )
    n = len(DIMS)
    dim = F.lit("total")
    val = F.lit(None).cast("string")
    for i, c in enumerate(DIMS):
        gid = (1 << n) - 1 - (1 << (n - 1 - i))
        dim = F.when(F.col("gid") == gid, F.lit(c)).otherwise(dim)
        val = F.when(F.col("gid") == gid, F.col(c)).otherwise(val)
    return g.select(dim.alias("dimension"), val.alias("value"), "cnt")


def stats_pct(counts: DataFrame, label: str) -> DataFrame:
    """Share of total with a bar: pct = round(100*cnt/total) (half-even).

    ``sum() over ()`` runs over the already aggregated (small) counts.
    """
    w = Window.partitionBy()
    total = F.sum("cnt").over(w)
    pct = safe_pct(F.col("cnt"), total)
    return counts.select(
        label,
        "cnt",
        pct.alias("pct"),
        F.repeat(F.lit("█"), F.floor(pct / 5).cast("int")).alias("bar"),
    )


def products_dim(reviews: DataFrame) -> DataFrame:
    """Product dimension derived from the store: (product_id, name)."""
    return (
        reviews.select("product_id")
        .distinct()
        .select("product_id", F.regexp_replace("product_id", "^prod_", "Product ").alias("name"))
    )


def stats_named(reviews: DataFrame, products: DataFrame) -> DataFrame:
    """Counts per product with the display name; name defaults to the id."""
    c = count_by(reviews, "product_id")
    j = join_dimension(c, products, "product_id", "left")
    return j.select("product_id", F.coalesce("name", "product_id").alias("name"), "cnt")


def ingestion_log(reviews: DataFrame) -> DataFrame:
    """One log row per (run date, product): new rows and the running total.

    Each distinct ingest day of the store is one run. The running total is a
    window over the already aggregated rows (runs x products, small).
    """
    runs = reviews.groupBy(
        F.to_date("ingested_at").alias("run_date"), "product_id"
    ).agg(F.count(F.lit(1)).alias("new_reviews"))
    w = Window.partitionBy("product_id").orderBy("run_date").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return runs.withColumn("total_reviews", F.sum("new_reviews").over(w))


def last_ingestion(log: DataFrame) -> DataFrame:
    return log.agg(F.max("run_date").alias("last_run"))


def freshness(log: DataFrame, as_of: str, max_age_days: int = 6) -> DataFrame:
    """Stale when no run exists or the last run is more than ``max_age_days`` old."""
    last = last_ingestion(log)
    age = F.datediff(F.lit(as_of).cast("date"), F.col("last_run"))
    return last.select(
        "last_run",
        age.alias("days_since"),
        (F.col("last_run").isNull() | (age > max_age_days)).alias("is_stale"),
    )
