"""Report documents (K9, W6): the global action report and the weekly
change report as ``(section, ord, line)`` DataFrames.

Each document is one plan over one cube (``operators.cube``,
``operators.weekly``): the reviews are read once, a row of the cube gives its
lines with ``format_string`` on the executors, and one window numbers the
lines within their sections (a row per theme, theme list or product). Only
the finished lines are ever coalesced, when a document is written as one
text file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revq.functions.text import safe_pct, signed_pct_label
from revq.operators import cube as CB
from revq.operators import report as R
from revq.operators import weekly as W
from revq.schema import ACTIONS, CRITICAL_NEG_SHARE, NO_PREVIOUS_WEEK, NO_SPIKES, NO_THEMES_YET, NO_VALUE, WIN_POS_SHARE
from revq.sources.files import exists

GLOBAL_SECTIONS = ["head", "executive_summary", "critical_issues", "wins", "messaging", "claims_to_retire", "faq", "escalation", "theme_analysis"]
WEEKLY_SECTIONS = ["head", "spikes", "per_product"]
GLOBAL_TOP = {4: 5, 5: 3, 6: 5, 7: 5}  # fixed: lines of a section


GLOBAL_TITLES = [
    "# Review Intelligence Report",
    "## Executive summary\n| Product | Reviews | Avg rating | Positive % | Top complaint | Top praise |",
    "## Product team: critical issues",
    "## Product team: wins",
    "## Marketing: messaging opportunities",
    "## Marketing: claims to retire",
    "## Support: FAQ candidates",
    "## Support: escalation patterns",
    "## Theme analysis\n| Theme | Mentions | Positive % | Negative % | Avg rating |",
]


def _with_all(cube: DataFrame, products: DataFrame) -> DataFrame:
    """``cube`` with the products' names; the store and every product have a row, with or without reviews."""
    there = products.select(F.lit("product").alias("_level"), F.col("product_id").alias("_id"), "name")
    there = there.unionByName(cube.sparkSession.createDataFrame([("all", None, None)], there.schema))
    both = cube.join(there, (F.col("level") == F.col("_level")) & F.col("product_id").eqNullSafe(F.col("_id")), "full")
    return both.withColumn("level", F.coalesce("level", "_level")).withColumn("product_id", F.coalesce("product_id", "_id")).drop("_level", "_id")


def global_report_lines(reviews: DataFrame, products: DataFrame, quote_product: str | None = None) -> DataFrame:
    """K9: every section from one cube (``operators.cube``), so the reviews and their texts are read once.

    A row of the cube gives its line in each section that it belongs to; one
    window numbers the lines within their sections. ``reviews`` carry ``text``
    cut to what a quote shows.
    """
    cube = CB.rollup(CB.review_cube(reviews, full=True, quote_product=quote_product))
    cube = _with_all(cube, products)
    zero = F.lit(0).cast("long")
    n, pos, neg = (F.coalesce(c, zero) for c in ("reviews", "positive", "negative"))
    mean = F.bround(F.col("rating_sum") / n, 2).cast("string")
    label, key = F.col("label"), {"trend": [-n, F.col("first_seen"), F.col("first_pos").cast("long"), F.lit("")]}
    key["product"] = [zero, zero, zero, F.col("product_id")]
    themes = F.array_join(F.from_json(label, "array<string>"), ", ")

    def line(section: int, when: F.Column, order: list, text: F.Column, first: F.Column = zero) -> F.Column:
        place = F.struct(first.alias("a"), *(c.alias(x) for c, x in zip(order, "bcde", strict=True)))
        return F.when(when, F.struct(F.lit(section).alias("section"), place.alias("place"), text.alias("line")))

    theme, product, every, pattern = (F.col("level") == x for x in ("theme", "product", "all", "pattern"))
    lines = F.array(
        line(0, every, key["product"], F.format_string("Total reviews: %d | Period: %s to %s", n, F.coalesce("earliest", F.lit(NO_VALUE)), F.coalesce("latest", F.lit(NO_VALUE)))),
        line(
            1, product, key["product"],
            F.format_string(
                "| %s | %d | %s/5 | %d%% | %s | %s |", "name", n, CB.mean_rating("rating_sum", "rated").cast("string"), safe_pct(pos, n),
                F.coalesce("worst.theme", F.lit(NO_VALUE)), F.coalesce("best.theme", F.lit(NO_VALUE)),
            ),
        ),
        line(
            2, theme & (neg / n > CRITICAL_NEG_SHARE), key["trend"],
            F.format_string(
                "**%s:** %d negative mentions (%d%% of %d) - average rating when mentioned %s/5\n> Evidence: \"%s\"",
                label, neg, safe_pct(neg, n), n, mean, R.quote_text("quote.text"),
            ),
        ),
        line(3, theme & (pos / n > WIN_POS_SHARE), key["trend"], F.format_string("**%s:** %d positive mentions (%d%% positive) - avg rating %s/5", label, pos, safe_pct(pos, n), mean)),
        line(4, theme, key["trend"], F.format_string("- **%s** - %d positive mentions (avg %s/5)", label, pos, mean), -pos),
        line(5, theme, key["trend"], F.format_string("- **%s** - %d negative mentions", label, neg), -neg),
        line(6, theme, key["trend"], F.format_string("- **%s** - %d mentions", label, n)),
        line(7, pattern, [zero, zero, zero, themes], F.format_string("- **%s** - %d reviews rated 2 stars or less", themes, n), -n),
        line(
            8, theme, key["trend"],
            F.format_string("| %s | %d | %d%% | %d%% | %s/5 |", label, n, safe_pct(pos, n), safe_pct(neg, n), mean),
        ),
    )
    rows = cube.select(F.inline_outer(F.array_compact(lines))).filter("section is not null")
    w = Window.partitionBy("section").orderBy("place")
    rows = rows.withColumn("ord", F.row_number().over(w).cast("long"))
    # the first so many, THEN without those that have no such mention
    top = F.expr(f"map({', '.join(f'{k}, {v}' for k, v in GLOBAL_TOP.items())})")
    kept = F.coalesce(F.col("ord") <= top[F.col("section")], F.lit(True)) & ~(F.col("section").isin(4, 5) & (F.col("place.a") >= 0))
    rows = rows.filter(kept).select("section", "ord", "line")
    titles = reviews.sparkSession.createDataFrame([(i, 0, t) for i, t in enumerate(GLOBAL_TITLES)], rows.schema)
    return titles.unionByName(rows)


WEEKLY_TITLES = [None, "## Spikes and alerts (>20% change)", "## Per product"]


def weekly_report_lines(reviews: DataFrame, products: DataFrame, as_of: str, mode: str = "observed", quote_product: str | None = None) -> DataFrame:
    """K7/K8 document from one cube. Spike lines carry a negative evidence
    quote; observed mode takes it from one fixed product and for DOWN spikes
    too, as the reference does. ``reviews`` carry ``text`` cut to what a quote shows."""
    cube = W.weekly_cube(reviews, as_of, mode=mode, quote_product=quote_product)
    cube = _with_all(cube, products)
    zero = F.lit(0).cast("long")
    this, prev, chg = F.coalesce("this", zero), F.coalesce("prev", zero), F.col("change_pct")
    since, _ = W.week_bounds(as_of)
    change = F.when(chg.isNull(), F.lit(NO_PREVIOUS_WEEK)).otherwise(signed_pct_label(chg))
    action = F.when(F.col("alert") == "UP", F.lit(ACTIONS["UP"])).otherwise(F.lit(ACTIONS["DOWN"]))
    spike = F.when(
        F.col("alert") == "NEW TREND",
        F.format_string("**%s - NEW TREND (%d mentions)** - not seen last week; monitor", "theme", this),
    ).otherwise(
        F.format_string(
            "**%s - %s %d%%** (previous %d, this week %d)\n- Key review: \"%s\"\n- Action: %s",
            "theme", "alert", F.abs(chg), prev, this, R.quote_text("quote.text"), action,
        )
    )
    mean = CB.mean_rating("rating_sum", "rated").cast("string")
    topics = F.when(F.coalesce("top_themes", F.lit("")) == "", F.lit(NO_THEMES_YET)).otherwise(F.col("top_themes"))
    no_spike = F.lit(NO_SPIKES)

    def line(section: int, order: list, text: F.Column, alert: bool = False) -> F.Column:
        place = F.struct(*(c.alias(x) for c, x in zip(order, "abcd", strict=True)))
        return F.struct(F.lit(section).alias("section"), place.alias("place"), text.alias("line"), F.lit(alert).alias("alert"))

    none = F.lit("")
    volume = F.format_string("# Weekly change report - week of %s\nNew reviews this week: %d | vs last week: %s", F.lit(since), this, change)
    last = [F.lit(1).cast("long"), zero, zero, none]
    lines = (
        F.when(F.col("level") == "all", F.array(line(0, [zero, zero, zero, none], volume), line(1, last, no_spike)))
        .when(
            (F.col("level") == "theme") & F.col("alert").isNotNull() & (this > 0),
            F.array(line(1, [-this, F.col("first_seen"), F.col("first_pos").cast("long"), none], spike, True)),
        )
        .when(F.col("level") == "product", F.array(line(2, [zero, zero, zero, F.col("product_id")], F.format_string("%s: %d new reviews | avg rating %s/5 | top themes: %s", "name", this, mean, topics))))
    )
    rows = cube.select(F.inline_outer(lines)).filter("section is not null")
    w = Window.partitionBy("section").orderBy("place")
    rows = rows.withColumn("ord", F.row_number().over(w).cast("long"))
    # the line for a week without spikes stands last in its section, and stays if it is also the first
    rows = rows.filter((F.col("section") != 1) | F.col("alert") | (F.col("ord") == 1)).select("section", "ord", "line")
    titles = reviews.sparkSession.createDataFrame([(i, 0, t) for i, t in enumerate(WEEKLY_TITLES) if t], rows.schema)
    return titles.unionByName(rows)


def write_report(lines: DataFrame, path: str) -> None:
    """One UTF-8 text file, lines in order.

    A line that holds line breaks of its own (a table's head, a quote) goes on
    indented by two spaces, so that ``read_reports`` finds its end again.
    """
    text = F.replace(F.col("line"), F.lit("\n"), F.lit("\n  "))
    lines.orderBy("section", "ord").select(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_reports(spark: SparkSession, *paths: str) -> DataFrame:
    """(document, section, ord, line) of written reports.

    A folder that is not there is left out, as a report that was not made yet.
    A document is cut at line breaks that no indent follows; a heading opens a
    section and is its line 0. Sections are counted within a document by array
    functions, so documents need no shuffle.
    """
    there = [p for p in paths if exists(spark, p)]
    if not there:
        return spark.createDataFrame([], "document string, section int, ord long, line string")
    docs = spark.read.text(there, wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1).alias("document"),
        F.split(F.regexp_replace("value", "\n$", ""), "\n(?!  )").alias("parts"),
    )
    title = lambda x: x.startswith("# ") & ~x.contains("\n")
    begin = F.struct(F.lit(0).alias("section"), F.lit(0).cast("long").alias("ord"), F.lit(None).cast("string").alias("line"))

    def step(held, x):
        last, new = F.element_at(held, -1), x.startswith("## ")
        place = F.struct(
            F.when(new, last["section"] + 1).otherwise(last["section"]).alias("section"),
            F.when(new | title(x), F.lit(0)).otherwise(last["ord"] + 1).cast("long").alias("ord"),
            F.replace(x, F.lit("\n  "), F.lit("\n")).alias("line"),
        )
        return F.concat(held, F.array(place))

    kind = "array<struct<section:int,ord:bigint,line:string>>"
    placed = F.aggregate("parts", F.array(begin).cast(kind), step)
    return docs.select("document", F.inline(F.slice(placed, 2, F.size("parts"))))


def report_context(spark: SparkSession, *paths: str) -> DataFrame:
    """(context): the text of the reports that are there, each under its name, for an answer's prompt."""
    lines = read_reports(spark, *paths)
    docs = lines.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("section", "ord", "line"))).alias("all"))
    text = F.format_string("--- %s ---\n%s", "document", F.array_join(F.transform("all", lambda x: x["line"]), "\n"))
    return docs.agg(F.array_join(F.array_sort(F.collect_list(text)), "\n").alias("context"))


def global_report(reviews: DataFrame, products: DataFrame, quote_product: str | None = None, path: str | None = None) -> dict[str, DataFrame]:
    """The global action report in one call: its lines, and each section's, by name; written to ``path`` if given."""
    lines = global_report_lines(reviews, products, quote_product)
    return _sections(lines, GLOBAL_SECTIONS, path)


def weekly_report(
    reviews: DataFrame, products: DataFrame, as_of: str, mode: str = "observed", quote_product: str | None = None, path: str | None = None
) -> dict[str, DataFrame]:
    """The weekly change report in one call, as ``global_report``."""
    return _sections(weekly_report_lines(reviews, products, as_of, mode, quote_product), WEEKLY_SECTIONS, path)


def _sections(lines: DataFrame, names: list[str], path: str | None) -> dict[str, DataFrame]:
    if path is not None:
        write_report(lines, path)
        lines = read_reports(lines.sparkSession, path).drop("document")  # no second pass over the reviews
    return {"lines": lines} | {n: lines.filter(F.col("section") == i).drop("section") for i, n in enumerate(names)}
