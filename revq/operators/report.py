"""Global report sections.

All sections derive from two relations: the store ``reviews`` and its theme
aggregate ``trends`` (output of ``theme_trends``). Everything after the
aggregate works on at most (products x themes) rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revq.functions.text import safe_pct, truncate
from revq.operators import cube as CB
from revq.operators.joins import join_dimension
from revq.schema import CRITICAL_NEG_SHARE, NO_QUOTE, NO_VALUE, QUOTE_CHARS, WIN_POS_SHARE



def trend_order() -> list:
    """Theme order of the reference: mentions desc, then first appearance."""
    return [F.desc("mentions"), F.asc("first_seen"), F.asc("first_pos")]


def date_extent(reviews: DataFrame) -> DataFrame:
    """MIN/MAX of the raw date text (observed) and of the parsed date (intended)."""
    d = F.col("date").try_cast("date")
    return reviews.agg(
        F.min("date").alias("earliest"),
        F.max("date").alias("latest"),
        F.min(d).alias("earliest_date"),
        F.max(d).alias("latest_date"),
    )


def product_summary(reviews: DataFrame, products: DataFrame) -> DataFrame:
    """Per product: rows, mean rating (NULL out, 0 in), positive share of all rows."""
    agg = reviews.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.sum("rating").cast("long").alias("rating_sum"),
        F.count("rating").alias("rated_reviews"),
        F.count_if(F.col("sentiment") == "Positive").alias("positive"),
        F.count_if(F.col("sentiment") == "Negative").alias("negative"),
        F.count_if(F.col("sentiment") == "Neutral").alias("neutral"),
    )
    j = join_dimension(products, agg, "product_id", "left")
    zero = F.lit(0).cast("long")
    total = F.coalesce("total_reviews", zero)
    avg = F.when(F.col("rated_reviews") > 0, F.col("rating_sum") / F.col("rated_reviews"))
    return j.select(
        "product_id",
        "name",
        total.alias("total_reviews"),
        F.coalesce("rating_sum", zero).alias("rating_sum"),
        F.coalesce("rated_reviews", zero).alias("rated_reviews"),
        # falsy mean (NULL or 0) prints as 0.0
        F.coalesce(F.bround(avg, 1), F.lit(0.0)).alias("avg_rating"),
        F.coalesce("positive", zero).alias("positive"),
        F.coalesce("negative", zero).alias("negative"),
        F.coalesce("neutral", zero).alias("neutral"),
        safe_pct(F.coalesce("positive", zero), total).alias("positive_pct"),
    )


def top_complaint_praise(trends_by_product: DataFrame, products: DataFrame) -> DataFrame:
    """Both arg-max themes of each product in one aggregate; 'N/A' when none > 0.

    Strict '>' over the trend order means: highest count, then more mentions,
    then first seen. A maximum of structs says the same without a window, and
    is combined before the shuffle.
    """

    def top(col: str) -> F.Column:
        place = F.struct(col, "mentions", F.negative("first_seen"), F.negative("first_pos"), "theme")
        return F.max(F.when(F.col(col) > 0, place))

    best = trends_by_product.groupBy("product_id").agg(top("negative").alias("worst"), top("positive").alias("best"))
    return join_dimension(products.select("product_id"), best, "product_id", "left").select(
        "product_id",
        F.coalesce("worst.theme", F.lit(NO_VALUE)).alias("top_complaint"),
        F.coalesce("best.theme", F.lit(NO_VALUE)).alias("top_praise"),
    )


def exec_summary(reviews: DataFrame, products: DataFrame) -> DataFrame:
    """K1: one row per product with the five summary metrics, from one pass over the reviews."""
    c = CB.rollup(CB.review_cube(reviews)).filter(F.col("level") == "product")
    j = join_dimension(products, c.drop("level", "name"), "product_id", "left")
    zero = F.lit(0).cast("long")
    total = F.coalesce("reviews", zero)
    return j.select(
        "product_id",
        "name",
        total.alias("total_reviews"),
        CB.mean_rating("rating_sum", "rated").alias("avg_rating"),
        safe_pct(F.coalesce("positive", zero), total).alias("positive_pct"),
        F.coalesce("worst.theme", F.lit(NO_VALUE)).alias("top_complaint"),
        F.coalesce("best.theme", F.lit(NO_VALUE)).alias("top_praise"),
    )


def first_quotes(mentions: DataFrame, by: list[str]) -> DataFrame:
    """First matching review text per (``by``, theme, sentiment), 150 chars + '…'.

    One grouped pass: ``min_by`` keeps the text of the first arrival and is
    combined before the shuffle, so neither the text is read twice nor a join
    fetches it. ``mentions`` carry ``text``, cut to what a quote shows.
    """
    firsts = mentions.filter(F.col("sentiment").isNotNull()).groupBy(*by, "theme", "sentiment").agg(
        F.min_by("text", "arrival_seq").alias("text")
    )
    return firsts.select(*by, "theme", "sentiment", quote_text("text").alias("quote"))


def quote_text(text: str) -> F.Column:
    """What a quote shows of a review text; a fixed line where there is none."""
    c = F.col(text)
    return F.when(c.isNotNull() & (c != ""), truncate(c, QUOTE_CHARS)).otherwise(F.lit(NO_QUOTE))


def quote_for(quotes: DataFrame, rows: DataFrame, sentiment: str, product_id: str | None) -> DataFrame:
    """Attach the quote of (theme, sentiment[, product]) to ``rows``; fallback text.

    observed: quotes per product, one fixed ``product_id`` picked;
    intended: ``product_id=None`` with global quotes (``first_quotes(by=[])``).
    """
    q = quotes.filter(F.col("sentiment") == sentiment)
    if product_id is not None:
        q = q.filter(F.col("product_id") == product_id).drop("product_id")
    elif "product_id" in q.columns:
        raise ValueError("without a quote product, pass global quotes: first_quotes(..., by=[])")
    q = q.select("theme", "quote")
    return rows.join(q, "theme", "left").withColumn("quote", F.coalesce("quote", F.lit(NO_QUOTE)))


def critical_issues(trends: DataFrame, quotes: DataFrame | None = None, quote_product: str | None = None) -> DataFrame:
    """K2: themes whose negative share is > 10 %, with a negative quote.

    observed: the quote comes from one fixed product (``quote_product``).
    """
    t = trends.filter((F.col("mentions") > 0) & (F.col("negative") / F.col("mentions") > CRITICAL_NEG_SHARE))
    out = t.select(
        "theme",
        "negative",
        "mentions",
        safe_pct("negative", "mentions").alias("neg_pct"),
        "avg_rating",
        "first_seen",
        "first_pos",
    )
    if quotes is not None:
        out = quote_for(quotes, out, "Negative", quote_product)
    return out


def wins(trends: DataFrame) -> DataFrame:
    """K3: themes whose positive share is > 20 %."""
    t = trends.filter((F.col("mentions") > 0) & (F.col("positive") / F.col("mentions") > WIN_POS_SHARE))
    return t.select("theme", "positive", "mentions", safe_pct("positive", "mentions").alias("pos_pct"), "avg_rating", "first_seen", "first_pos")


def _top_then_drop(trends: DataFrame, col: str, k: int) -> DataFrame:
    """Top ``k`` by ``col`` (stable over the trend order), THEN drop zeros.

    The cut comes before the filter on purpose: fewer than ``k`` rows may
    remain. ``limit`` after a global sort plans as TakeOrderedAndProject.
    """
    ranked = trends.orderBy(F.desc(col), *trend_order()).limit(k)
    w = Window.orderBy(F.desc(col), *trend_order())
    return ranked.withColumn("rank", F.row_number().over(w)).filter(F.col(col) > 0)


def messaging_opportunities(trends: DataFrame, k: int = 5) -> DataFrame:
    return _top_then_drop(trends, "positive", k).select("rank", "theme", "positive", "avg_rating")


def claims_to_retire(trends: DataFrame, k: int = 3) -> DataFrame:
    return _top_then_drop(trends, "negative", k).select("rank", "theme", "negative")


def faq_candidates(trends: DataFrame, k: int = 5) -> DataFrame:
    ranked = trends.orderBy(*trend_order()).limit(k)
    w = Window.orderBy(*trend_order())
    return ranked.withColumn("rank", F.row_number().over(w)).select("rank", "theme", "mentions")


def escalation_patterns(reviews: DataFrame, k: int = 5, max_rating: int = 2, canonical: bool = False) -> DataFrame:
    """Low-rated processed reviews grouped by their exact theme list.

    ``rating <= 2`` (0 included, NULL out). The list order matters unless
    ``canonical``; ties at the cut are broken by the joined label.
    """
    r = reviews.filter(
        (F.col("rating") <= max_rating) & (F.col("processed") == 1) & F.col("themes").isNotNull()
    )
    key = F.array_sort("themes") if canonical else F.col("themes")
    g = r.groupBy(key.alias("themes")).agg(F.count(F.lit(1)).alias("cnt"))
    g = g.withColumn("themes_label", F.array_join("themes", ", "))
    top = g.orderBy(F.desc("cnt"), F.asc("themes_label")).limit(k)
    w = Window.orderBy(F.desc("cnt"), F.asc("themes_label"))
    return top.withColumn("rank", F.row_number().over(w)).select("rank", "themes_label", "cnt")


def theme_table(trends: DataFrame) -> DataFrame:
    """K6: mentions, positive %, negative %, average rating per theme."""
    return trends.select(
        "theme",
        "mentions",
        safe_pct("positive", "mentions").alias("pos_pct"),
        safe_pct("negative", "mentions").alias("neg_pct"),
        "avg_rating",
        "first_seen",
        "first_pos",
    )


def exec_summary_long(summary: DataFrame) -> DataFrame:
    """The executive table as (metric, product_id, value) — one row per
    cell. Long form keeps the schema fixed however many products exist; a
    display layer pivots it."""
    return summary.select(
        "product_id",
        F.expr(
            "stack(5, 'total_reviews', cast(total_reviews as string), "
            "'avg_rating', concat(cast(avg_rating as string), '/5'), "
            "'positive_pct', concat(cast(positive_pct as string), '%'), "
            "'top_complaint', top_complaint, 'top_praise', top_praise) as (metric, value)"
        ),
    )


def product_list(products: DataFrame, most: int = 1000) -> list[str]:
    """All product ids in order; a table with more than ``most`` columns is refused, not cut."""
    ids = [r[0] for r in products.select("product_id").distinct().orderBy("product_id").take(most + 1)]
    if len(ids) > most:
        raise ValueError(f"more than {most} products: use exec_summary_long")
    return ids


def exec_summary_wide(long: DataFrame, product_ids: list[str]) -> DataFrame:
    """J7 display form: one row per metric, one column per product.

    The product list is passed in (from the product dimension), so the pivot
    needs no extra job to discover values and the schema is known up front.
    """
    return long.groupBy("metric").pivot("product_id", product_ids).agg(F.first("value"))
