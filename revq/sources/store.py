"""Persistent review store on append-only parquet tables (W1-W4, SURVEY §1.6).

Plain parquet has no row updates, so the mutable table of the reference
becomes three append-only tables under one folder:

* ``reviews_raw``   accepted reviews, one sub-folder per load (``load=<id>``),
  sorted by ``product_id`` within files (product predicates prune row groups);
* ``review_analysis`` analysis rows; the latest per ``review_id`` wins;
* ``ingestion_log`` one row per (load, product).

A load writes only its own ``load=<id>`` folders and reads the store
without them. A folder with ``_SUCCESS`` is committed: re-running that load
is a no-op; a folder without it (a failed attempt) is read by nobody and
overwritten by the retry. So a load can be retried after any executor or
driver loss without duplicating rows. Column types come from the files; of
the folder names only the load number is read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revq.operators.classify import apply_analysis, classify_batch
from revq.operators.dedup import dedup_append
from revq.sources.files import committed, committed_parts, read_parts
from revq.sources.keyruns import KeyRuns


@dataclass
class ReviewStore:
    spark: SparkSession
    root: str
    # keep a copy of the stored keys as bucketed runs (``keyruns``); the anti
    # join of the next load then reads the keys already partitioned by
    # review_id and only the batch side is shuffled
    key_buckets: int | None = None
    fan: int = 4  # runs of keys merged at once

    def __post_init__(self):
        self.runs = KeyRuns(self.spark, f"{self.root}/review_keys", self.key_buckets, self.fan) if self.key_buckets else None

    @property
    def raw_path(self) -> str:
        return f"{self.root}/reviews_raw"

    @property
    def analysis_path(self) -> str:
        return f"{self.root}/review_analysis"

    @property
    def log_path(self) -> str:
        return f"{self.root}/ingestion_log"

    def raw(self, exclude_load: int | None = None) -> DataFrame | None:
        loads = committed_parts(self.spark, self.raw_path, "load")
        return read_parts(self.spark, self.raw_path, "load", [n for n in loads if n != exclude_load])

    def keys(self, exclude_load: int | None = None) -> DataFrame:
        """Stored keys, bucketed. The committed loads say what is stored; the
        run of a load that lacks one (bucketing was turned on later, or a
        program ended before it was written) is made from the load's rows."""
        have = self.runs.loads()
        for load in committed_parts(self.spark, self.raw_path, "load"):
            if load != exclude_load and load not in have:
                self.runs.add(load, self.spark.read.parquet(f"{self.raw_path}/load={load}"))
        self.runs.compact()
        return self.runs.keys(exclude_load)

    def append(self, batch: DataFrame, load: int, run_ts: str) -> DataFrame:
        """De-duplicating append of one load; returns the ingestion-log rows."""
        out = f"{self.raw_path}/load={load}"
        log_out = f"{self.log_path}/load={load}"
        if committed(self.spark, out) and committed(self.spark, log_out):
            return self.spark.read.parquet(log_out)
        if not committed(self.spark, out):
            stored = self.raw(exclude_load=load)
            if self.key_buckets and stored is not None:
                stored = self.keys(exclude_load=load)
            dedup_append(batch, stored).sortWithinPartitions("product_id").write.mode("overwrite").parquet(out)
        new = self.spark.read.parquet(out).groupBy("product_id").agg(F.count(F.lit(1)).alias("new_reviews"))
        total = self.raw().groupBy("product_id").agg(F.count(F.lit(1)).alias("total_reviews"))
        log = new.join(total, "product_id", "right").select(
            F.lit(run_ts).cast("timestamp_ntz").alias("run_date"),
            "product_id",
            F.coalesce("new_reviews", F.lit(0)).cast("long").alias("new_reviews"),
            "total_reviews",
        )
        log.write.mode("overwrite").parquet(log_out)
        return self.spark.read.parquet(log_out)

    def analyse(self, load: int, predicate: str | None = None, scorer=None) -> None:
        """Classify the reviews that have no analysis yet (optionally a subset
        by predicate) and append the rows (W3)."""
        out = f"{self.analysis_path}/load={load}"
        if committed(self.spark, out):
            return
        raw = self.raw()
        done = read_parts(self.spark, self.analysis_path, "load", [n for n in committed_parts(self.spark, self.analysis_path, "load") if n != load])
        if done is not None:
            raw = raw.join(done.select("review_id"), "review_id", "left_anti")
        if predicate:
            raw = raw.filter(predicate)
        a = classify_batch(raw, scorer=scorer)
        a.write.mode("overwrite").parquet(out)

    def reviews(self) -> DataFrame:
        """The ``reviews`` view: raw LEFT JOIN latest analysis."""
        raw, analysis = self.raw(), read_parts(self.spark, self.analysis_path, "load")
        if analysis is None:
            return raw.withColumn("processed", F.lit(0))
        return apply_analysis(raw, analysis.drop("load"))

    def ingestion_log(self) -> DataFrame:
        return read_parts(self.spark, self.log_path, "load")
