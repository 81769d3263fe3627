"""De-duplicating append (W2, J1, R1) and the overlap check.

First arrival wins, inside a batch and against the store. The plan is built
to stay balanced when one key holds a large share of the rows (e.g. the ''
key every id-less review collapses to):

1. ``min(arrival_seq)`` per key is a HashAggregate with a map-side partial
   step, so a hot key is reduced to one row per task before the shuffle.
2. Keys already stored are removed with a ``left_anti`` join of two
   key-unique relations (no skew possible; only ``review_id`` of the store
   is read).
3. The batch is cut back to the winners with a ``left_semi`` join on
   ``(review_id, arrival_seq)``: the pair is unique, so hashing on it spreads
   the rows of a hot key over all reducers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = "review_id"
ORDER = "arrival_seq"


def first_per_key(batch: DataFrame, key: str = KEY, order: str = ORDER) -> DataFrame:
    """Rows that are the first arrival of their key; NULL keys are dropped.

    ``order`` must be unique per key (file order + position).
    """
    valid = batch.filter(F.col(key).isNotNull())
    firsts = valid.groupBy(key).agg(F.min(order).alias(order))
    return valid.join(firsts, [key, order], "left_semi")


def new_first_keys(batch: DataFrame, store: DataFrame | None, key: str = KEY, order: str = ORDER) -> DataFrame:
    """(key, first arrival) of keys that are not in the store yet."""
    firsts = batch.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(order))
    if store is not None:
        firsts = firsts.join(store.select(key), key, "left_anti")
    return firsts


def dedup_append(batch: DataFrame, store: DataFrame | None = None, key: str = KEY, order: str = ORDER) -> DataFrame:
    """Rows of ``batch`` to append: first arrival per key, key not stored."""
    winners = new_first_keys(batch, store, key, order)
    return batch.filter(F.col(key).isNotNull()).join(winners, [key, order], "left_semi")


def ingest_counts(batch: DataFrame, accepted: DataFrame, by: list[str]) -> DataFrame:
    """attempted / new / skipped per group of ``by`` columns.

    Two grouped counts (each with a map-side partial aggregate) joined on the
    small group key; no per-row join on ``review_id`` that a hot key could
    unbalance.
    """
    att = batch.groupBy(*by).agg(F.count(F.lit(1)).alias("attempted"))
    new = accepted.groupBy(*by).agg(F.count(F.lit(1)).alias("new_count"))
    return (
        att.join(new, by, "left")
        .withColumn("new_count", F.coalesce("new_count", F.lit(0)).cast("long"))
        .withColumn("skipped_count", F.col("attempted") - F.col("new_count"))
    )
