"""Exploded theme mentions and theme trends.

``theme_mentions`` is the one base relation every report section reads; the
aggregate over it is a HashAggregate with map-side partials, so a theme that
carries a third of all mentions is combined per task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revq.functions.text import py_strip
from revq.schema import UNKNOWN_SENTIMENT

MENTION_COLS = [
    "arrival_seq",
    "review_id",
    "product_id",
    "source",
    "rating",
    "sentiment",
    "date",
    "ingested_at",
]


def theme_mentions(reviews: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per (processed review, theme position); themes stripped.

    ``with_text`` keeps the review's text, which the caller has cut to what a quote shows.
    """
    # posexplode_outer + a NULL filter gives the same rows as posexplode, but
    # keeps the optimizer from inferring ``size(themes) > 0`` and pushing a
    # copy of the whole classification expression below the projection.
    r = reviews.filter(F.col("processed") == 1)
    cols = [*MENTION_COLS, "text"] if with_text else MENTION_COLS
    m = r.select(*cols, F.posexplode_outer("themes").alias("pos", "theme"))
    return m.filter(F.col("theme").isNotNull()).withColumn("theme", py_strip("theme"))


def in_period(since: str | None = None, until: str | None = None, mode: str = "observed") -> F.Column:
    """``since <= date < until`` (an open end where None).

    observed: on the raw text (as the reference does); intended: on the
    parsed date, so unparsed strings never pass.
    """
    d, bound = F.col("date"), F.lit
    if mode != "observed":
        d, bound = d.try_cast("date"), lambda x: F.lit(x).cast("date")
    hit = F.lit(True)
    if since is not None:
        hit = hit & (d >= bound(since))
    return hit if until is None else hit & (d < bound(until))


def filter_mentions(
    mentions: DataFrame,
    product_id: str | None = None,
    since: str | None = None,
    until: str | None = None,
    mode: str = "observed",
) -> DataFrame:
    """Product / review-date predicates (see ``in_period``)."""
    m = mentions if product_id is None else mentions.filter(F.col("product_id") == product_id)
    return m if since is None and until is None else m.filter(in_period(since, until, mode))


PLACES = 1 << 31  # more than a list can have


def appearance() -> F.Column:
    """One number that orders mentions by arrival, then place in the list.

    A decimal holds both whole, and a minimum of it is fixed-width, so the
    aggregates that look for the first mention hash and combine map-side.
    """
    return F.col("arrival_seq").cast("decimal(20,0)") * F.lit(PLACES) + F.col("pos")


def first_mention(df: DataFrame, key: str = "first") -> DataFrame:
    """Replace an ``appearance`` by first_seen (arrival) and first_pos (place in the list)."""
    pos = F.pmod(F.col(key), F.lit(PLACES))
    return df.withColumn("first_seen", ((F.col(key) - pos) / F.lit(PLACES)).cast("long")).withColumn("first_pos", pos.cast("int")).drop(key)


def mention_sums() -> list[F.Column]:
    """Counts of a group of mentions that add up over parts."""
    s = F.coalesce(F.col("sentiment"), F.lit(UNKNOWN_SENTIMENT))
    return [
        F.count(F.lit(1)).alias("mentions"),
        F.sum(F.coalesce(F.col("rating"), F.lit(0))).cast("long").alias("rating_sum"),
        F.count_if(s == "Positive").alias("positive"),
        F.count_if(s == "Negative").alias("negative"),
        F.count_if(s == "Neutral").alias("neutral"),
        F.count_if(~s.isin("Positive", "Negative", "Neutral")).alias("other_sentiment"),
        F.min(appearance()).alias("first"),
    ]


def theme_trends(mentions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per theme (and ``by``): mentions, rating sum/avg, sentiment counts.

    avg_rating = round(sum(coalesce(rating, 0)) / mentions, 2), half-even.
    ``first_seen`` and ``first_pos`` order ties the way first appearance does.
    """
    return _with_mean(mentions.groupBy(*(by or []), "theme").agg(*mention_sums()))


def _with_mean(sums: DataFrame) -> DataFrame:
    return first_mention(sums).withColumn("avg_rating", F.bround(F.col("rating_sum") / F.col("mentions"), 2))


PART = ["theme", "product_id", "date", "ingest_day"]


def theme_counts(mentions: DataFrame) -> DataFrame:
    """Additive parts of theme trends per (theme, product, review date, ingest day)."""
    return mentions.withColumn("ingest_day", F.to_date("ingested_at")).groupBy(*PART).agg(*mention_sums())


def add_theme_counts(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Parts added up per ``by`` (their own key by default)."""
    sums = [F.sum(c).cast("long").alias(c) for c in ("mentions", "rating_sum", "positive", "negative", "neutral", "other_sentiment")]
    return parts.groupBy(*(PART if by is None else by)).agg(*sums, F.min("first").alias("first"))


def theme_trends_of(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``theme_trends`` from kept parts: equal to a scan of all mentions behind them."""
    return _with_mean(add_theme_counts(parts, [*(by or []), "theme"]))


def theme_sentiment(mentions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Long form sentiment breakdown (theme, sentiment, n) — the A8 map."""
    by = list(by or [])
    s = F.coalesce(F.col("sentiment"), F.lit(UNKNOWN_SENTIMENT)).alias("sentiment")
    return mentions.groupBy(*by, "theme", s).agg(F.count(F.lit(1)).alias("n"))


def theme_by_source(mentions: DataFrame) -> DataFrame:
    """Theme x source counts, for claims tagged '(source, n=X)' (Z7)."""
    return mentions.groupBy("theme", "source").agg(F.count(F.lit(1)).alias("n"))


def themes_from_json(col: str = "themes_json") -> F.Column:
    """ARRAY<STRING> from stored JSON text; NULL, '' and invalid JSON give NULL
    (such rows are skipped by ``theme_mentions``, as the reference does)."""
    c = F.col(col)
    return F.when(c.isNotNull() & (c != ""), F.from_json(c, "array<string>"))
