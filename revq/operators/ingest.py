"""Ingest-side operators: normalise a batch (S5, S6, P10-P12, U1), the
overlap check (U2), per-run logs (W4, W5, A20, K10) and the JSON run-log
sink/source (S8, W5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from revq.functions.keys import review_key
from revq.operators.joins import join_dimension
from revq.operators.dedup import dedup_append, ingest_counts
from revq.schema import RUN_LOG_SCHEMA

REVIEW_COLS = [
    "review_id",
    "product_id",
    "source",
    "rating",
    "title",
    "text",
    "date",
    "reviewer_id",
]


def normalize_reviews(
    batch: DataFrame,
    product_id: str | None = None,
    source: str | None = None,
    since: str | None = None,
) -> DataFrame:
    """Enrich a scraped batch: lower-cased source, key, non-empty body.

    ``product_id`` / ``source`` given as arguments override row values (the
    reference relabels rows with its call arguments). Missing columns read
    as their defaults ('' text, 0 rating); an explicit NULL stays NULL.
    ``since`` keeps only reviews dated after the last run (parsed dates).
    """
    b = batch
    defaults = {"title": F.lit(""), "text": F.lit(""), "date": F.lit(""), "rating": F.lit(0), "reviewer_id": F.lit("")}
    for c, v in defaults.items():
        if c not in b.columns:
            b = b.withColumn(c, v)
    if product_id is not None:
        b = b.withColumn("product_id", F.lit(product_id))
    b = b.withColumn("source", F.lower(F.lit(source) if source is not None else F.col("source")))
    b = b.filter(F.col("text") != "")
    if since is not None:
        b = b.filter(F.col("date").try_cast("date") > F.lit(since).cast("date"))
    b = b.withColumn("review_id", review_key("reviewer_id", "date", "product_id"))
    extra = [c for c in b.columns if c not in REVIEW_COLS]
    return b.select(*REVIEW_COLS, *extra)


# --- fixed values: texts that mark a URL as not configured ------------------
URL_PLACEHOLDERS = ["PRODUCT_ID_HERE", "product-url-here"]
# --- end of fixed values ---------------------------------------------------


def configured(url: F.Column) -> F.Column:
    """The URL is neither blank nor a placeholder."""
    u = F.coalesce(url, F.lit(""))
    ok = u != ""
    for mark in URL_PLACEHOLDERS:
        ok = ok & ~u.contains(mark)
    return ok


def configured_sources(config: DataFrame) -> DataFrame:
    """(product_id, source, url) rows whose source can be read."""
    return config.filter(configured(F.col("url")))


def source_counts(config: DataFrame, accepted: DataFrame) -> DataFrame:
    """New reviews of every (product, source) of ``config``: what ``accepted``
    holds for a configured one, 0 for a skipped one or one without reviews.
    The count runs on the narrow keys before it meets the configuration."""
    new = accepted.groupBy(F.col("product_id").alias("_p"), F.lower("source").alias("_s")).agg(F.count(F.lit(1)).alias("n"))
    c = config.withColumn("configured", configured(F.col("url")))
    same = F.col("configured") & F.col("product_id").eqNullSafe(F.col("_p")) & F.lower("source").eqNullSafe(F.col("_s"))
    return c.join(new, same, "left").select(
        "product_id", "source", "configured", F.coalesce("n", F.lit(0)).cast("long").alias("new_reviews")
    )


def union_batches(batches: list[DataFrame]) -> DataFrame:
    """One batch of several sources' batches; a column that one of them
    lacks is NULL there."""
    whole = batches[0]
    for b in batches[1:]:
        whole = whole.unionByName(b, allowMissingColumns=True)
    return whole


def overlap_proof(batch: DataFrame, store: DataFrame) -> DataFrame:
    """One row: attempted, new, caught as already stored, caught inside the
    batch, NULL keys. Key-level counts (partial aggregate) are joined to the
    key-unique store, so a hot key never meets the store row by row."""
    accepted = dedup_append(batch, store)
    per_key = batch.filter(F.col("review_id").isNotNull()).groupBy("review_id").agg(F.count(F.lit(1)).alias("n"))
    stored = store.select("review_id").distinct().withColumn("_s", F.lit(1))
    in_store = per_key.join(stored, "review_id", "inner").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("already_stored"))
    att = batch.agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(F.col("review_id").isNull()).alias("null_keys"),
    )
    new = accepted.agg(F.count(F.lit(1)).alias("new_count"))
    one = F.lit(1).alias("_one")
    j = (
        att.select("*", one)
        .join(new.select("*", one), "_one")
        .join(in_store.select("*", one), "_one")
    )  # three one-row aggregates side by side
    return j.select(
        "attempted",
        "new_count",
        "already_stored",
        (F.col("attempted") - F.col("new_count") - F.col("already_stored") - F.col("null_keys")).alias("in_batch_duplicates"),
        "null_keys",
    )


def ingest_summary(batch: DataFrame, store: DataFrame | None) -> DataFrame:
    """K10 per (product, source): attempted / new / skipped, and the product's
    total in the store after the load (A21)."""
    accepted = dedup_append(batch, store)
    counts = ingest_counts(batch, accepted, ["product_id", "source"])
    after = accepted.select("product_id") if store is None else store.select("product_id").unionByName(accepted.select("product_id"))
    totals = after.groupBy("product_id").agg(F.count(F.lit(1)).alias("total_in_db"))
    return counts.join(totals, "product_id", "left").withColumn(
        "total_in_db", F.coalesce("total_in_db", F.lit(0)).cast("long")
    )


def run_rows(store: DataFrame) -> DataFrame:
    """W5 as it is stored: a row per (run date, product, source) with its new reviews.

    Each ingest day of the store is one run. The rows are a hash aggregate;
    no run and no product is ever one value.
    """
    return store.groupBy(F.to_date("ingested_at").alias("run_date"), "product_id", "source").agg(F.count(F.lit(1)).alias("source_new"))


def run_totals(rows: DataFrame) -> DataFrame:
    """(run_date, product_id, source, source_new, product_new, total_new, total_in_db) of stored run rows.

    Product sums are aggregated and joined; the running total is a window over
    a row per run.
    """
    products = rows.groupBy("run_date", "product_id").agg(F.sum("source_new").alias("product_new"))
    runs = rows.groupBy("run_date").agg(F.sum("source_new").alias("total_new"))
    w = Window.orderBy("run_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = runs.withColumn("total_in_db", F.sum("total_new").over(w))
    out = join_dimension(join_dimension(rows, products, ["run_date", "product_id"]), runs, "run_date")
    return out.select("run_date", "product_id", "source", "source_new", "product_new", "total_new", "total_in_db")


def write_run_rows(rows: DataFrame, path: str) -> None:
    """JSON lines, a folder per run with one file written by an executor; a run
    written again replaces its folder, so a retried run is logged once."""
    rows.repartition("run_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").json(path)


def read_run_rows(spark: SparkSession, path: str) -> DataFrame:
    """Stored run rows; a line that cannot be read is left out by the caller's choice, not here:
    it comes as a row whose ``_corrupt_record`` is set."""
    schema = "product_id string, source string, source_new long, _corrupt_record string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.withColumn("run_date", F.col("run_date").cast("date"))


def run_log(store: DataFrame) -> DataFrame:
    """W5 entries in the nested form of log documents, one per ingest day, for
    exchange with readers of that form: a document holds its whole run, so use
    ``run_rows`` for what is kept. total_new = sum of new rows, total_in_db =
    running total."""
    per = run_rows(store)
    prod = per.groupBy("run_date", "product_id").agg(
        F.sum("source_new").alias("new_reviews"),
        F.map_from_entries(F.collect_list(F.struct("source", "source_new"))).alias("sources"),
    )
    run = prod.groupBy("run_date").agg(
        F.map_from_entries(
            F.collect_list(F.struct("product_id", F.struct("new_reviews", "sources")))
        ).alias("products"),
        F.sum("new_reviews").alias("total_new"),
    )
    w = Window.orderBy("run_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return run.select(
        "run_date",
        F.col("run_date").cast("timestamp_ntz").alias("run_timestamp"),
        "products",
        "total_new",
        F.sum("total_new").over(w).alias("total_in_db"),
    )


def flatten_run_log(log: DataFrame) -> DataFrame:
    """(run_date, product_id, source, source_new, product_new, total_new, total_in_db)."""
    p = log.select("run_date", "total_new", "total_in_db", F.explode("products").alias("product_id", "v"))
    s = p.select(
        "run_date",
        "product_id",
        F.col("v.new_reviews").alias("product_new"),
        "total_new",
        "total_in_db",
        F.explode("v.sources").alias("source", "source_new"),
    )
    return s.select("run_date", "product_id", "source", "source_new", "product_new", "total_new", "total_in_db")


def read_run_log(spark: SparkSession, path: str, document: bool = False) -> DataFrame:
    """Tolerant read: malformed text lands in ``_corrupt_record`` (kept,
    never silently dropping history).

    JSON lines in run_date folders, as ``write_run_log`` leaves them, or with
    ``document=True`` whole files that hold one array of entries or one entry.
    """
    fields = [f for f in RUN_LOG_SCHEMA.fields if document or f.name != "run_date"]
    schema = T.StructType(fields + [T.StructField("_corrupt_record", T.StringType())])
    return (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("multiLine", document)
        .json(path)
    )
