"""Classification jobs (I4, I7, A19) and the analysis write-back view.

The default scorer is the deterministic rule set of ``revq.functions.classify``
(pure Column expressions). A model-backed scorer plugs in as an Arrow-batched
``mapInPandas`` function; its raw answers go through ``sanitize_answer``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revq.functions.classify import keyword_themes, match_blob, rating_confidence, rating_sentiment, theme_hits
from revq.functions.labels import sanitize_answer
from revq.schema import KEYWORD_THEMES

Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]

RULES = "keyword_rules"


def classify_rules(df: DataFrame, whole_word: bool = False, max_themes: int = 3) -> DataFrame:
    """Add sentiment / themes / confidence with the keyword + rating rules.

    The lower-cased match text is its own projection: CollapseProject will
    not inline an expensive expression that is referenced 11 times, so it is
    computed once per row.
    """
    return (
        df.withColumn("_blob", match_blob("text", "title"))
        .withColumn("sentiment", rating_sentiment("rating"))
        .withColumn("themes", keyword_themes("_blob", whole_word, max_themes))
        .withColumn("confidence", rating_confidence("rating"))
        .drop("_blob")
    )


def with_hits(df: DataFrame, whole_word: bool = False) -> DataFrame:
    """``df`` and ``hits``, the matched themes; the match text is a projection of its own."""
    return df.withColumn("_blob", match_blob("text", "title")).withColumn("hits", theme_hits("_blob", whole_word)).drop("_blob")


def with_keywords(df: DataFrame) -> DataFrame:
    """``df`` and ``found``, the (keyword, theme) pairs whose keyword occurs in text or title.

    One condition per keyword, not a lambda over a list of keywords: a lambda
    names the match text once, so the optimizer would inline and repeat it.
    """
    blob = F.col("_blob")
    pairs = [F.when(blob.contains(k), F.struct(F.lit(k).alias("keyword"), F.lit(t).alias("theme"))) for k, t in KEYWORD_THEMES]
    return df.withColumn("_blob", match_blob("text", "title")).withColumn("found", F.array_compact(F.array(*pairs))).drop("_blob")


def classify_batch(
    unprocessed: DataFrame,
    scorer: Scorer | None = None,
    classifier: str = RULES,
    analyzed_at=None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Analysis rows ``(review_id, sentiment, themes, confidence, classifier, analyzed_at)``.

    ``keep`` names columns of the reviews that the rows also carry (and their rating).

    ``scorer`` maps pandas batches with columns review_id, title, text, rating
    to batches with columns review_id, raw (the model's JSON answer).
    """
    ts = analyzed_at if analyzed_at is not None else F.current_timestamp().cast("timestamp_ntz")
    if scorer is None:
        out = classify_rules(unprocessed.select("review_id", "title", "text", "rating", *(keep or [])))
        res = out.select("review_id", "sentiment", "themes", "confidence", *(["rating", *keep] if keep else []))
    else:
        raw = unprocessed.select("review_id", "title", "text", "rating").mapInPandas(
            scorer, "review_id string, raw string"
        )
        s = raw.select("review_id", sanitize_answer("raw").alias("a"))
        res = s.select("review_id", "a.sentiment", "a.themes", "a.confidence")
        if keep:
            res = res.join(unprocessed.select("review_id", "rating", *keep), "review_id")
    return res.withColumn("classifier", F.lit(classifier)).withColumn("analyzed_at", ts)


def latest_analysis(analysis: DataFrame) -> DataFrame:
    """Latest analysis row per review_id (write-back = append + resolve).

    ``max_by`` over a struct keeps the aggregate map-side-combinable, so a
    review analysed many times costs one row per task before the shuffle.
    """
    cols = [c for c in analysis.columns if c != "review_id"]
    best = analysis.groupBy("review_id").agg(
        F.max_by(F.struct(*cols), F.col("analyzed_at")).alias("a")
    )
    return best.select("review_id", *[F.col(f"a.{c}").alias(c) for c in cols])


def apply_analysis(raw: DataFrame, analysis: DataFrame) -> DataFrame:
    """reviews = raw LEFT JOIN latest(analysis); processed = analysis exists.

    An analysis for an unknown key changes nothing (left join from raw).
    """
    la = latest_analysis(analysis).select("review_id", "sentiment", "themes", "confidence")
    base = raw.drop("sentiment", "themes", "confidence", "processed")
    return base.join(la, "review_id", "left").withColumn(
        "processed", F.when(F.col("sentiment").isNotNull(), 1).otherwise(0)
    )


def run_tally(analysis: DataFrame) -> DataFrame:
    """Per-run tallies (A19): long form (kind, label, cnt) for sentiments and themes."""
    sent = analysis.groupBy(F.col("sentiment").alias("label")).agg(F.count(F.lit(1)).alias("cnt"))
    th = (
        analysis.select(F.explode("themes").alias("label"))
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    total = analysis.agg(F.count(F.lit(1)).alias("cnt")).select(
        F.lit("processed").alias("kind"), F.lit("all").alias("label"), "cnt"
    )
    return (
        total.unionByName(sent.select(F.lit("sentiment").alias("kind"), "label", "cnt"))
        .unionByName(th.select(F.lit("theme").alias("kind"), "label", "cnt"))
    )


def top_new_theme(analysis: DataFrame) -> DataFrame:
    """Arg-max theme of a run (Z6): most frequent, ties by name."""
    t = (
        analysis.select(F.explode("themes").alias("theme"))
        .groupBy("theme")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    return t.orderBy(F.desc("cnt"), "theme").limit(1)


def batch_align(assign: DataFrame, answers: DataFrame) -> DataFrame:
    """Align batched model answers to reviews by key, not by position.

    ``assign``: (batch_id, pos, review_id) — which review sat at which
    position of which call; ``answers``: (batch_id, raw) — the call's JSON
    array. Elements are exploded with their position and joined back on
    (batch_id, pos): a missing answer or an unreadable batch gives the
    fallback label, surplus answers are dropped, nothing shifts into the
    next batch.
    """
    from revq.functions.labels import answer_elements

    el = answers.select("batch_id", F.posexplode_outer(answer_elements("raw")).alias("pos", "elem"))
    el = el.filter(F.col("pos").isNotNull()).select("batch_id", "pos", sanitize_answer("elem").alias("a"))
    j = assign.join(el, ["batch_id", "pos"], "left")
    fb = sanitize_answer(F.lit("not json"))  # the fallback struct
    a = F.coalesce(F.col("a"), fb)
    return j.select("batch_id", "pos", "review_id", a.alias("a")).select(
        "batch_id", "pos", "review_id", "a.sentiment", "a.themes", "a.confidence", "a.fallback"
    )


def align_with_retry(assign: DataFrame, answers: DataFrame, reviews: DataFrame, score_single: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Batch answers, and single calls for the reviews of batches that failed.

    A batch fails as a whole when its answer is missing, is no JSON array, or
    holds an element that cannot be read; its reviews are then scored one by
    one with ``score_single`` (reviews -> (review_id, raw)). The fallback label
    comes only after that: where the single answer cannot be read either, or
    where a readable batch answer has too few elements. ``answers`` is read
    twice and should be a stored table, so that no call is made again.

    Returns (review_id, sentiment, themes, confidence, fallback, mode).
    """
    from revq.functions.labels import answer_elements

    read = answers.select("batch_id", answer_elements("raw").alias("elements"))
    read = read.select("batch_id", F.transform("elements", lambda x: sanitize_answer(x)).alias("read"))
    good = read.filter(F.col("read").isNotNull() & ~F.exists("read", lambda a: a["fallback"]))
    got = assign.join(good, "batch_id").select("review_id", F.get("read", F.col("pos").cast("int")).alias("a"), F.lit("batch").alias("mode"))
    rest = assign.join(good.select("batch_id"), "batch_id", "left_anti").select("review_id")
    raw = score_single(reviews.join(rest, "review_id", "left_semi")).select("review_id", sanitize_answer("raw").alias("a"))
    single = rest.join(raw, "review_id", "left").select("review_id", "a", F.lit("single").alias("mode"))
    both = got.unionByName(single).withColumn("a", F.coalesce("a", sanitize_answer(F.lit("not json"))))
    return both.select("review_id", "a.sentiment", "a.themes", "a.confidence", "a.fallback", "mode")


def unprocessed(
    reviews: DataFrame,
    analysis: DataFrame | None = None,
    product_id: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Reviews still to analyse.

    With an ``analysis`` table this is a ``left_anti`` join on the key (both
    sides key-unique after ``latest_analysis``); otherwise the ``processed``
    flag. ``limit`` (the reference's work cap) is optional and, unlike the
    reference, ordered by arrival so the cut is deterministic.
    """
    r = reviews if product_id is None else reviews.filter(F.col("product_id") == product_id)
    if analysis is not None:
        r = r.join(latest_analysis(analysis).select("review_id"), "review_id", "left_anti")
    else:
        r = r.filter(F.col("processed") == 0)
    return r.orderBy("arrival_seq").limit(limit) if limit is not None else r
