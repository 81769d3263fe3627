"""Incremental ingest with Structured Streaming.

``ReviewStream`` runs a file-source stream over a landing folder with
``trigger(availableNow=True)``: each run picks up only files that arrived
since the last run (the checkpoint remembers), which is the reference's
weekly re-ingest. Each micro-batch (``foreachBatch``):

1. de-duplicates against everything ever stored. The unbounded key memory
   lives in bucketed runs (``sources.keyruns``), not in state: the stored side
   of the join is read bucket by bucket and only the new batch is shuffled;
2. writes the accepted rows to ``store/epoch=<id>``;
3. optionally analyses pending rows. Pending is a table that shrinks: the keys
   of the last epoch's backlog and of the rows accepted since, less those
   analysed now. A row that a rule or a work cap leaves out stays in it and
   is analysed by a later epoch. Texts are read only from the epochs that
   still have pending rows;
4. optionally adds the mentions of the analysed rows up per (theme, product,
   review date, ingest day). The parts are additive, so a late arrival changes
   an old week without a rescan; every ``fold``-th epoch they are added up
   into one.

Every step writes a folder of its own per epoch; a folder with ``_SUCCESS``
is committed and skipped when the epoch is replayed, a partial one is
overwritten. So an epoch retried after a failure never counts a row twice.

``bounded_dedup_stream`` is the bounded-state alternative:
``withWatermark(ingested_at).dropDuplicatesWithinWatermark(review_id)``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revq.operators.classify import classify_batch
from revq.operators.dedup import dedup_append
from revq.operators.mentions import add_theme_counts, theme_counts, theme_mentions, theme_trends_of
from revq.sources.files import committed, committed_parts, read_parts
from revq.sources.keyruns import KeyRuns


@dataclass
class ReviewStream:
    landing: str  # folder where new parquet batches arrive
    store: str  # accepted reviews, one folder per epoch
    checkpoint: str
    schema: T.StructType
    analysis: str | None = None  # analyse pending rows when set
    # SQL predicate, or one per epoch: which pending rows to analyse now (None: all)
    classify_filter: str | Callable[[int], str | None] | None = None
    classify_cap: int | None = None  # at most so many rows an epoch, by arrival
    counts: str | None = None  # keep theme counts of the analysed rows when set
    key_buckets: int | None = None  # buckets of the stored keys; None: the session's shuffle partitions
    fold: int = 8  # epochs of theme counts added up at once

    # ------------------------------------------------------------ one epoch
    def _batch(self, df: DataFrame, epoch_id: int) -> None:
        spark = df.sparkSession
        self._accept(spark, df, epoch_id)
        if self.analysis is not None:
            self._analyse(spark, epoch_id)
        if self.counts is not None:
            self._count(spark, epoch_id)

    def runs(self, spark: SparkSession) -> KeyRuns:
        buckets = self.key_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        return KeyRuns(spark, f"{self.store}_keys", buckets)

    def stored_keys(self, spark: SparkSession, epoch: int) -> DataFrame:
        """Keys of the epochs before this one; a committed epoch without its run gets it now."""
        runs = self.runs(spark)
        have = runs.loads()
        for e in committed_parts(spark, self.store, "epoch"):
            if e < epoch and e not in have:
                runs.add(e, spark.read.parquet(f"{self.store}/epoch={e}"))
        runs.compact()
        return runs.keys()

    def _accept(self, spark: SparkSession, df: DataFrame, epoch: int) -> None:
        out = f"{self.store}/epoch={epoch}"
        if not committed(spark, out):
            dedup_append(df, self.stored_keys(spark, epoch)).write.mode("overwrite").parquet(out)

    def _pending(self, spark: SparkSession, epoch: int) -> DataFrame:
        """(review_id, accepted) of rows to analyse: the last backlog and all epochs accepted since."""
        past = [e for e in committed_parts(spark, f"{self.analysis}_backlog", "epoch") if e < epoch]
        since = past[-1] if past else -1
        new = [e for e in committed_parts(spark, self.store, "epoch") if since < e <= epoch]
        out = read_parts(spark, self.store, "epoch", new).select("review_id", F.col("epoch").cast("long").alias("accepted"))
        if past:
            out = out.unionByName(spark.read.parquet(f"{self.analysis}_backlog/epoch={since}"))
        return out

    def _analyse(self, spark: SparkSession, epoch: int) -> None:
        out, left = f"{self.analysis}/epoch={epoch}", f"{self.analysis}_backlog/epoch={epoch}"
        if committed(spark, out) and committed(spark, left):
            return
        pending = self._pending(spark, epoch)
        if not committed(spark, out):
            # a row per epoch that still has pending rows
            epochs = [r[0] for r in pending.select("accepted").distinct().collect()]
            rows = read_parts(spark, self.store, "epoch", epochs).withColumn("accepted", F.col("epoch").cast("long")).drop("epoch")
            rows = rows.join(pending, ["review_id", "accepted"], "left_semi")
            rule = self.classify_filter(epoch) if callable(self.classify_filter) else self.classify_filter
            if rule:
                rows = rows.filter(rule)
            if self.classify_cap is not None:
                rows = rows.orderBy("arrival_seq").limit(self.classify_cap)
            keep = [c for c in ("accepted", "arrival_seq", "product_id", "source", "date", "ingested_at") if c in rows.columns]
            classify_batch(rows, keep=keep).write.mode("overwrite").parquet(out)
        done = spark.read.parquet(out).select("review_id", "accepted")
        pending.join(done, ["review_id", "accepted"], "left_anti").write.mode("overwrite").parquet(left)

    def _count(self, spark: SparkSession, epoch: int) -> None:
        out = f"{self.counts}/epoch={epoch}"
        if not committed(spark, out):
            rows = spark.read.parquet(f"{self.analysis}/epoch={epoch}").withColumn("processed", F.lit(1))
            theme_counts(theme_mentions(rows)).write.mode("overwrite").parquet(out)
        total = f"{self.counts}_total/upto={epoch}"
        if (epoch + 1) % self.fold == 0 and not committed(spark, total):
            add_theme_counts(self.theme_counts(spark, epoch).drop("epoch")).write.mode("overwrite").parquet(total)

    # --------------------------------------------------------------- reading
    def run_available(self, spark: SparkSession) -> None:
        """Process everything that landed since the last run, then stop."""
        src = spark.readStream.schema(self.schema).parquet(self.landing)
        q = (
            src.writeStream.foreachBatch(self._batch)
            .option("checkpointLocation", self.checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        q.awaitTermination()

    def stored(self, spark: SparkSession) -> DataFrame:
        return read_parts(spark, self.store, "epoch")

    def analysed(self, spark: SparkSession) -> DataFrame:
        return read_parts(spark, self.analysis, "epoch")

    def backlog(self, spark: SparkSession) -> DataFrame:
        """(review_id, accepted) of the rows that no epoch has analysed yet."""
        last = committed_parts(spark, f"{self.analysis}_backlog", "epoch")[-1]
        return spark.read.parquet(f"{self.analysis}_backlog/epoch={last}")

    def theme_counts(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        """The parts of all epochs (to ``upto``): the last folded total and the epochs since."""
        done = [e for e in committed_parts(spark, self.counts, "epoch") if upto is None or e <= upto]
        totals = [e for e in committed_parts(spark, f"{self.counts}_total", "upto") if e < (done[-1] + 1 if upto is None else upto)]
        base = totals[-1] if totals else -1
        out = read_parts(spark, self.counts, "epoch", [e for e in done if e > base])
        if totals:
            old = spark.read.parquet(f"{self.counts}_total/upto={base}").withColumn("epoch", F.lit(base))
            out = old if out is None else out.unionByName(old)
        return out

    def theme_trends(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        """Theme trends of everything analysed so far, from the kept counts alone."""
        return theme_trends_of(self.theme_counts(spark, upto))


def _timed(src: DataFrame) -> DataFrame:
    """Watermarks take a TIMESTAMP; ``ingested_at`` may come without a zone."""
    return src.withColumn("ingested_at", F.col("ingested_at").cast("timestamp"))


def bounded_dedup_stream(src: DataFrame, delay: str = "7 days") -> DataFrame:
    """Streaming dedup with bounded state: keys are remembered only while
    their ``ingested_at`` is within the watermark delay."""
    return _timed(src).withWatermark("ingested_at", delay).dropDuplicatesWithinWatermark(["review_id"])


def weekly_counts_stream(src: DataFrame, delay: str = "1 day") -> DataFrame:
    """Calendar-week (Monday) volume per product on ingest time, emitted once
    the watermark passes the week's end (late data up to ``delay``)."""
    return (
        _timed(src).withWatermark("ingested_at", delay)
        .groupBy(F.window("ingested_at", "7 days", "7 days", "4 days").alias("w"), "product_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("week_start"), "product_id", "n")
    )
