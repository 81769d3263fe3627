"""Registered queries that reach rules the given rows do not reach by
themselves: more than three theme hits (H17), what a model or a console is
shown (H7, I7), a pluggable scorer (I7), work and display caps (T6, T7), and
query answers in a fence (H15). Each derives its rows from the given tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revq.functions.prompts import BATCH_CHARS, SINGLE_CHARS, cell, model_input
from revq.operators import adhoc as A
from revq.operators import classify as C
from revq.plans import oracle as O
from revq.plans.base import reviews as _reviews
from revq.plans.catalog import CLASSIFY_SQL, register
from revq.plans.oracle import with_base
from revq.schema import DEFAULT_THEME
from revq.sources.fixtures import reviews_in

# a keyword of each of seven themes, put before a text where the arrival has the bit
RICH = ["bass", "battery", "comfort", "price", "plastic", "delivery", "bluetooth"]


@register(
    "rich_keyword_themes",
    with_base(
        f"""SELECT arrival_seq, CAST(len(h) AS INTEGER) AS n_hits, array_to_string({O._themes_sql()}, '|') AS themes_label
            FROM (SELECT arrival_seq, {O._theme_list_sql()} AS h FROM (
              SELECT arrival_seq, lower(concat({", ' ', ".join(f"CASE WHEN (arrival_seq >> {i}) & 1 = 1 THEN '{k}' ELSE '' END" for i, k in enumerate(RICH))},
                     ' ', coalesce(text, ''), ' ', coalesce(title, ''))) AS b FROM reviews_in) s) h"""
    ),
)
def q_rich_keyword_themes(spark, sf):
    """Texts that name up to seven themes and more; the first three in taxonomy order stay."""
    from revq.functions.classify import themes_of

    bits = [F.when(F.shiftright("arrival_seq", i).bitwiseAND(F.lit(1)) == 1, F.lit(k)).otherwise(F.lit("")) for i, k in enumerate(RICH)]
    b = reviews_in(spark, sf).withColumn("text", F.concat_ws(" ", *bits, F.coalesce("text", F.lit(""))))
    hits = C.with_hits(b)
    return hits.select("arrival_seq", F.size("hits").alias("n_hits"), F.array_join(themes_of(F.col("hits")), "|").alias("themes_label"))


def _input_sql(chars: int) -> str:
    return (
        "concat('rating=', coalesce(rating, 0), '/5', chr(10), 'title=', coalesce(title, ''), chr(10), "
        f"'text=', substr(coalesce(text, ''), 1, {chars}))"
    )


CELL = "replace(coalesce(text, ''), chr(10), ' ')"


@register(
    "shown_texts",
    with_base(
        f"""SELECT arrival_seq, md5({_input_sql(500)}) AS single_md5, md5({_input_sql(300)}) AS batch_md5,
                   CASE WHEN length({CELL}) > 50 THEN concat(substr({CELL}, 1, 47), '...') ELSE {CELL} END AS cell
            FROM reviews_in"""
    ),
)
def q_shown_texts(spark, sf):
    """H7: a text as a single call (500), a call of many (300) and a table cell (50) show it."""
    r = reviews_in(spark, sf)
    return r.select(
        "arrival_seq",
        F.md5(model_input("text", "title", "rating", SINGLE_CHARS)).alias("single_md5"),
        F.md5(model_input("text", "title", "rating", BATCH_CHARS)).alias("batch_md5"),
        cell("text").alias("cell"),
    )


def _stars_scorer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A stand-in for a model: it answers from the stars alone, in a fence, and not at all for three stars."""
    for b in batches:
        stars = b["rating"].fillna(0).astype(int)
        mood = stars.map(lambda s: "Positive" if s > 3 else "Negative")
        raw = '```json\n{"sentiment": "' + mood + '", "themes": ["Price & Value", "no such theme"], "confidence": ' + (stars * 0.25).astype(str) + "}\n```"
        yield pd.DataFrame({"review_id": b["review_id"], "raw": raw.where(stars != 3, "no idea")})


@register(
    "classify_scorer",
    with_base(
        f"""SELECT review_id, classifier,
                   CASE WHEN stars = 3 THEN 'Neutral' WHEN stars > 3 THEN 'Positive' ELSE 'Negative' END AS sentiment,
                   CASE WHEN stars = 3 THEN '{DEFAULT_THEME}' ELSE 'Price & Value' END AS themes_label,
                   CASE WHEN stars = 3 THEN 0.1::DOUBLE ELSE least(1.0::DOUBLE, stars * 0.25::DOUBLE) END AS confidence
            FROM (SELECT review_id, 'stars' AS classifier, coalesce(rating, 0) AS stars FROM reviews WHERE processed = 0) r"""
    ),
)
def q_classify_scorer(spark, sf):
    """Unprocessed reviews through a pluggable scorer, its answers through the sanitiser."""
    un = _reviews(spark, sf).filter(F.col("processed") == 0)
    a = C.classify_batch(un, scorer=_stars_scorer, classifier="stars")
    return a.select("review_id", "classifier", "sentiment", F.array_join("themes", "|").alias("themes_label"), "confidence")


@register(
    "run_tally_top",
    with_base(
        """SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, t) AS INTEGER) AS rank, t AS theme, count(*) AS cnt
           FROM (SELECT unnest(themes) AS t FROM cb) u GROUP BY t QUALIFY rank <= 10""",
        CLASSIFY_SQL,
    ),
)
def q_run_tally_top(spark, sf):
    """A run's ten most frequent themes, most frequent first (the limit is the feature)."""
    un = _reviews(spark, sf).filter(F.col("processed") == 0)
    top = C.run_tally(C.classify_batch(un)).filter("kind = 'theme'").orderBy(F.desc("cnt"), "label").limit(10)
    return top.select(F.row_number().over(Window.orderBy(F.desc("cnt"), "label")).alias("rank"), F.col("label").alias("theme"), "cnt")


CAPPED = "SELECT review_id, rating FROM reviews WHERE processed = 1 ORDER BY rating DESC NULLS LAST, review_id"


@register("adhoc_capped", with_base(f"{CAPPED} LIMIT 50"))
def q_adhoc_capped(spark, sf):
    """A query answer in a fence with a leading 'SQL', its result cut to the rows a summary takes."""
    answer = f"```sql\nSQL {CAPPED};\n```"
    return A.adhoc_select(spark, answer, {"reviews": _reviews(spark, sf)}, limit=A.SHOWN)


@register("unprocessed_capped", with_base("SELECT review_id, arrival_seq FROM reviews WHERE processed = 0 ORDER BY arrival_seq LIMIT 100"))
def q_unprocessed_capped(spark, sf):
    """The work cap of one run, in arrival order (the limit is the feature)."""
    return C.unprocessed(_reviews(spark, sf), limit=100).select("review_id", "arrival_seq")
