"""Weekly change report.

The as-of date is always a parameter. Two clocks, as in the reference:
volume counts by ``ingested_at``; theme trends filter on the review ``date``.

Modes for the previous-period theme window (SURVEY §8.1):
* observed — ``date >= prev_start`` with no upper bound (so it contains the
  current week; spikes can only go down);
* intended — ``prev_start <= date < since``.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revq.functions.text import py_strip, signed_pct_label
from revq.operators.joins import join_dimension
from revq.operators.mentions import appearance, filter_mentions, first_mention, in_period, theme_trends
from revq.schema import NEW_TREND_MIN, NO_PREVIOUS_WEEK, NO_THEMES_YET, SPIKE_PCT


def week_bounds(as_of: str, since: str | None = None) -> tuple[str, str]:
    """(since, prev_start): since defaults to as_of - 7 days."""
    a = _dt.date.fromisoformat(as_of)
    s = _dt.date.fromisoformat(since) if since else a - _dt.timedelta(days=7)
    return s.isoformat(), (s - _dt.timedelta(days=7)).isoformat()


def pct_change(this: F.Column, prev: F.Column) -> F.Column:
    """round((this-prev)/prev*100), half-even; NULL when prev is 0."""
    return F.when(prev > 0, F.bround((this - prev) * 100.0 / prev, 0).cast("long"))


def spike_alert(this: F.Column, prev: F.Column, chg: F.Column) -> F.Column:
    """'UP' / 'DOWN' beyond the threshold, 'NEW TREND' for a theme that was absent, else NULL."""
    direction = F.when(chg > 0, F.lit("UP")).otherwise(F.lit("DOWN"))
    return F.when((prev > 0) & (F.abs(chg) > SPIKE_PCT), direction).when((prev == 0) & (this >= NEW_TREND_MIN), F.lit("NEW TREND"))


def weekly_volume(reviews: DataFrame, as_of: str, since: str | None = None) -> DataFrame:
    """Rows ingested this week (>= since, no upper bound) vs the 7 days before."""
    s, p = week_bounds(as_of, since)
    ts = F.col("ingested_at")
    s_ts, p_ts = F.lit(s).cast("timestamp_ntz"), F.lit(p).cast("timestamp_ntz")
    v = reviews.agg(
        F.count_if(ts >= s_ts).alias("this_week"),
        F.count_if((ts >= p_ts) & (ts < s_ts)).alias("prev_week"),
    )
    chg = pct_change(F.col("this_week"), F.col("prev_week"))
    return v.select(
        F.lit(s).alias("since"),
        "this_week",
        "prev_week",
        chg.alias("change_pct"),
        F.when(chg.isNull(), F.lit(NO_PREVIOUS_WEEK))
        .otherwise(signed_pct_label(chg))
        .alias("change_label"),
    )


def weekly_spikes(mentions: DataFrame, as_of: str, since: str | None = None, mode: str = "observed") -> DataFrame:
    """Every theme of this week with its previous count and alert kind.

    alert: 'UP' / 'DOWN' when |change| > 20 %, 'NEW TREND' when the theme was
    absent before and has >= 3 mentions now, else NULL.
    """
    s, p = week_bounds(as_of, since)
    # one pass over both periods: the date filter reaches the scan, the first
    # arrivals that it is joined with are found on all rows
    in_this = in_period(since=s, mode=mode)
    in_prev = in_period(since=p, until=None if mode == "observed" else s, mode=mode)
    both = mentions.filter(in_period(since=p, mode=mode)).groupBy("theme").agg(
        F.count_if(in_this).alias("this_count"),
        F.count_if(in_prev).alias("prev_count"),
        F.min(F.when(in_this, appearance())).alias("first"),
    )
    j = first_mention(both.filter("this_count > 0"))
    chg = pct_change(F.col("this_count"), F.col("prev_count"))
    direction = F.when(chg > 0, F.lit("UP")).otherwise(F.lit("DOWN"))
    alert = spike_alert(F.col("this_count"), F.col("prev_count"), chg)
    return j.select(
        "theme",
        "this_count",
        "prev_count",
        chg.alias("change_pct"),
        F.when(F.col("prev_count") > 0, direction).alias("direction"),
        alert.alias("alert"),
        "first_seen",
        "first_pos",
    )


def weekly_product(
    reviews: DataFrame, mentions: DataFrame, products: DataFrame, as_of: str, since: str | None = None, k: int = 3
) -> DataFrame:
    """K8 per product: rows ingested this week, mean of non-zero ratings,
    and the top-``k`` themes by review date (label 'Theme (n), …')."""
    s, _ = week_bounds(as_of, since)
    wk = reviews.filter(F.col("ingested_at") >= F.lit(s).cast("timestamp_ntz"))
    vol = wk.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("new_reviews"),
        F.avg(F.nullif(F.col("rating"), F.lit(0))).alias("_avg"),
    )
    tt = theme_trends(filter_mentions(mentions, since=s), by=["product_id"])
    w = Window.partitionBy("product_id").orderBy(F.desc("mentions"), "first_seen", "first_pos")
    top = (
        tt.withColumn("rn", F.row_number().over(w))
        .filter(F.col("rn") <= k)
        .groupBy("product_id")
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("rn", F.format_string("%s (%d)", "theme", "mentions").alias("l")))),
                    lambda x: x["l"],
                ),
                ", ",
            ).alias("top_themes")
        )
    )
    base = join_dimension(products, vol, "product_id", "left")
    out = join_dimension(base, top, "product_id", "left")
    return out.select(
        "product_id",
        "name",
        F.coalesce("new_reviews", F.lit(0).cast("long")).alias("new_reviews"),
        F.coalesce(F.bround("_avg", 1), F.lit(0.0)).alias("avg_rating"),
        F.coalesce("top_themes", F.lit(NO_THEMES_YET)).alias("top_themes"),
    )


def weekly_cube(
    reviews: DataFrame, as_of: str, since: str | None = None, mode: str = "observed", quote_product: str | None = None, k: int = 3
) -> DataFrame:
    """Every figure of the weekly report from one pass over the reviews.

    A review counts for itself and for each theme it mentions; both are added
    up per (product, theme) with partials before the shuffle, then per level:
    'all' (volume), 'theme' (counts of both periods, first negative quote) and
    'product' (new reviews, mean rating, ``top_themes``). ``reviews`` carry
    ``text`` cut to what a quote shows.
    """
    s, p = week_bounds(as_of, since)
    ts = F.col("ingested_at")
    new = ts >= F.lit(s).cast("timestamp_ntz")
    old = (ts >= F.lit(p).cast("timestamp_ntz")) & ~new
    done = (F.col("processed") == 1) & F.col("themes").isNotNull()
    fact = "struct<theme:string,pos:int>"
    themes = F.transform("themes", lambda t, i: F.struct(t.alias("theme"), i.cast("int").alias("pos")))
    themes = F.when(done, F.filter(themes, lambda x: x["theme"].isNotNull()))
    itself = F.array(F.lit(None).cast(fact))
    cols = ["arrival_seq", "product_id", "rating", "sentiment", "date", "ingested_at", "text"]
    facts = reviews.select(*cols, F.explode_outer(F.concat(itself, F.coalesce(themes, F.array().cast(f"array<{fact}>")))).alias("f"))
    facts = facts.select(*cols, py_strip("f.theme").alias("theme"), "f.pos")
    mention, rating = F.col("theme").isNotNull(), F.nullif(F.col("rating"), F.lit(0))
    this = F.when(mention, in_period(since=s, mode=mode)).otherwise(new)
    prev = F.when(mention, in_period(since=p, until=None if mode == "observed" else s, mode=mode)).otherwise(old)
    quoted = mention & (F.col("sentiment") == "Negative")
    if quote_product is not None:
        quoted = quoted & (F.col("product_id") == quote_product)
    # the themes of a product count by review date as text, in every mode
    shown = mention & in_period(since=s)
    cube = facts.groupBy("product_id", "theme").agg(
        F.count_if(this).alias("this"),
        F.count_if(prev).alias("prev"),
        F.sum(F.when(this, rating)).cast("long").alias("rating_sum"),
        F.count(F.when(this, rating)).alias("rated"),
        F.min(F.when(this, appearance())).alias("first"),
        F.count_if(shown).alias("shown"),
        F.min(F.when(shown, appearance())).alias("shown_first"),
        F.min(F.when(quoted, F.struct("arrival_seq", "text"))).alias("quote"),
    )

    def level(name: str) -> F.Column:
        return F.struct(
            F.lit(name).alias("level"),
            F.when(F.lit(name == "product"), F.col("product_id")).alias("product_id"),
            F.when(F.lit(name == "theme"), F.col("theme")).alias("theme"),
        )

    itself = F.col("theme").isNull()
    to = F.when(itself, F.array(level("all"), level("product"))).otherwise(F.array(level("theme"), level("product")))
    rows = cube.select("*", F.explode_outer(to).alias("to"))
    own = itself | (F.col("to.level") == "theme")
    top = F.struct(F.negative("shown"), "shown_first", F.format_string("%s (%d)", "theme", "shown").alias("l"))
    top = F.collect_list(F.when(~own & (F.col("shown") > 0), top))  # a theme once a product
    sums = [F.sum(F.when(own, F.col(c))).alias(c) for c in ("this", "prev", "rating_sum", "rated")]
    out = rows.groupBy(*(F.col(f"to.{c}").alias(c) for c in ("level", "product_id", "theme"))).agg(
        *sums,
        F.min(F.when(own, F.col("first"))).alias("first"),
        F.min(F.when(own, F.col("quote"))).alias("quote"),
        F.array_join(F.transform(F.slice(F.array_sort(top), 1, k), lambda x: x["l"]), ", ").alias("top_themes"),
    )
    change = pct_change(F.col("this"), F.col("prev"))
    return first_mention(out).withColumn("change_pct", change).withColumn("alert", F.when(F.col("level") == "theme", spike_alert(F.col("this"), F.col("prev"), change)))


def weekly_series(events: DataFrame, ts: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """Calendar weeks (Monday-aligned tumbling windows) per key, with the
    change against the immediately preceding week.

    ``window`` aligns to the epoch (a Thursday); the 4-day offset moves the
    boundaries to Monday. The lag runs over the aggregated series
    (keys x weeks rows).
    """
    wk = events.groupBy(F.window(ts, "7 days", "7 days", "4 days").alias("w"), key).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(value).alias("value_sum"),
    )
    wk = wk.select(F.to_date(F.col("w.start")).alias("week_start"), key, "n", "value_sum")
    w = Window.partitionBy(key).orderBy("week_start")
    prev_start = F.lag("week_start").over(w)
    prev_n = F.when(F.date_add(prev_start, 7) == F.col("week_start"), F.lag("n").over(w))
    wk = wk.withColumn("prev_n", prev_n)
    return wk.withColumn("change_pct", pct_change(F.col("n"), F.col("prev_n")))
