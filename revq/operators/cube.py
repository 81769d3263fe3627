"""One cube that every section of the global report reads (K1-K6, K9).

``review_cube`` is the only pass over the reviews: a review gives one row for
itself, one per theme mention and, if it is a low-rated processed one, one for
its theme list; all are aggregated per (kind, product, label) with partials
before the shuffle. What leaves it has at most products x (themes + theme
lists) rows. ``rollup`` adds these up to the levels the sections show: the
whole store, product, theme and theme list. Neither repeats a read, so a plan
built on them holds the text once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revq.functions.text import py_strip
from revq.operators.mentions import appearance, first_mention
from revq.schema import UNKNOWN_SENTIMENT

REVIEW, MENTION, PATTERN = "review", "mention", "pattern"
SUMS = ["rating_sum", "rated", "positive", "negative", "neutral"]


def _facts(max_rating: int) -> F.Column:
    """What one review counts for: itself, its mentions, its theme list."""

    def fact(kind: str, label: F.Column, pos: F.Column) -> F.Column:
        return F.struct(F.lit(kind).alias("kind"), label.cast("string").alias("label"), pos.cast("int").alias("pos"))

    none = F.lit(None)
    done = (F.col("processed") == 1) & F.col("themes").isNotNull()
    mentions = F.transform("themes", lambda t, i: fact(MENTION, t, i))
    mentions = F.filter(mentions, lambda x: x["label"].isNotNull())
    low = done & (F.col("rating") <= max_rating)
    empty = F.array().cast("array<struct<kind:string,label:string,pos:int>>")
    return F.concat(
        F.array(fact(REVIEW, none, none)),
        F.when(done, mentions).otherwise(empty),
        F.when(low, F.array(fact(PATTERN, F.to_json("themes"), none))).otherwise(empty),
    )


def review_cube(reviews: DataFrame, full: bool = False, quote_product: str | None = None, max_rating: int = 2) -> DataFrame:
    """(kind, product_id, label, n, sums, first mention); a theme list is a label as JSON.

    ``full`` adds the date extent and ``quote``, the first negative review of
    the theme (of one fixed product where ``quote_product`` is given); texts
    in the state make that aggregate sort, without them it hashes.
    """
    cols = ["arrival_seq", "product_id", "rating", "sentiment", *(["date", "text"] if full else [])]
    # outer, so that no copy of the classification is pushed below as a filter on the list's size
    facts = reviews.select(*cols, F.explode_outer(_facts(max_rating)).alias("f"))
    label = F.when(F.col("f.kind") == MENTION, py_strip("f.label")).otherwise(F.col("f.label"))
    facts = facts.select(*cols, "f.kind", label.alias("label"), "f.pos")
    mood = F.coalesce("sentiment", F.lit(UNKNOWN_SENTIMENT))
    texts = []
    if full:
        quoted = (F.col("kind") == MENTION) & (mood == "Negative")
        if quote_product is not None:
            quoted = quoted & (F.col("product_id") == quote_product)
        first = F.when(quoted, F.struct("arrival_seq", "text"))
        texts = [F.min("date").alias("earliest"), F.max("date").alias("latest"), F.min(first).alias("quote")]
    return facts.groupBy("kind", "product_id", "label").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce("rating", F.lit(0))).cast("long").alias("rating_sum"),
        F.count("rating").alias("rated"),
        F.count_if(mood == "Positive").alias("positive"),
        F.count_if(mood == "Negative").alias("negative"),
        F.count_if(mood == "Neutral").alias("neutral"),
        F.min(appearance()).alias("first"),
        *texts,
    )


def rollup(cube: DataFrame) -> DataFrame:
    """(level, product_id, label, sums ...): level is 'all', 'product', 'theme' or 'pattern'.

    A product also has ``worst`` and ``best``: its theme with the most negative
    and positive mentions (then more mentions, then first seen).
    """

    def level(name: str, own: bool) -> F.Column:
        by_product, by_label = name == "product", name in ("theme", "pattern")
        return F.struct(
            F.lit(name).alias("level"), F.lit(own).alias("own"),
            F.when(F.lit(by_product), F.col("product_id")).alias("product_id"),
            F.when(F.lit(by_label), F.col("label")).alias("label"),
        )

    kind = F.col("kind")
    levels = (
        F.when(kind == REVIEW, F.array(level("all", True), level("product", True)))
        .when(kind == MENTION, F.array(level("theme", True), level("product", False)))
        .otherwise(F.array(level("pattern", True)))
    )
    rows = cube.select("*", F.explode_outer(levels).alias("to"))
    own, of_product = F.col("to.own"), ~F.col("to.own")

    def top(col: str) -> F.Column:
        place = F.struct(col, F.col("n").alias("mentions"), F.negative("first"), F.col("label").alias("theme"))
        return F.max(F.when(of_product & (F.col(col) > 0), place))

    added = [F.sum(F.when(own, F.col(c))).alias(c) for c in SUMS]
    texts = []
    if "quote" in cube.columns:
        texts = [f(F.when(own, F.col(c))).alias(c) for f, c in ((F.min, "earliest"), (F.max, "latest"), (F.min, "quote"))]
    levels = rows.groupBy(*(F.col(f"to.{c}").alias(c) for c in ("level", "product_id", "label"))).agg(
        F.sum(F.when(own, F.col("n"))).alias("reviews"),
        *added,
        F.min(F.when(own, F.col("first"))).alias("first"),
        top("negative").alias("worst"),
        top("positive").alias("best"),
        *texts,
    )
    return first_mention(levels)


def mean_rating(total: str, rated: str) -> F.Column:
    """Mean to one decimal, half-even; no rating, or a mean of 0, shows as 0.0."""
    return F.coalesce(F.bround(F.when(F.col(rated) > 0, F.col(total) / F.col(rated)), 1), F.lit(0.0))
