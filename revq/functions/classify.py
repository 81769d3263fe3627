"""Deterministic classifier expressions.

All rules are plain Column expressions so that classification runs inside
whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from revq.functions.text import _c
from revq.schema import DEFAULT_THEME, keywords_by_theme

ColumnOrName = Column | str


def rating_sentiment(rating: ColumnOrName) -> Column:
    """>=4 Positive, <=2 Negative (0 too), else Neutral; NULL -> Neutral."""
    r = _c(rating)
    return (
        F.when(r >= 4, F.lit("Positive"))
        .when(r <= 2, F.lit("Negative"))
        .otherwise(F.lit("Neutral"))
    )


def rating_confidence(rating: ColumnOrName) -> Column:
    return F.when(_c(rating).isin(1, 5), F.lit(0.85)).otherwise(F.lit(0.65))


def match_blob(text: ColumnOrName, title: ColumnOrName) -> Column:
    """lower(text + ' ' + title), missing parts read as ''."""
    return F.lower(
        F.concat(F.coalesce(_c(text), F.lit("")), F.lit(" "), F.coalesce(_c(title), F.lit("")))
    )


def theme_hits(blob: ColumnOrName, whole_word: bool = False) -> Column:
    """Array of matched themes in taxonomy order, without NULLs or repeats.

    One ``when`` per theme (its keywords OR-ed), so a theme appears at most
    once and the order is the taxonomy's. Substring rules by default, as the
    reference ("ear" matches "year"); ``whole_word=True`` uses word bounds.
    """
    b = _c(blob)
    per_theme = []
    for theme, kws in keywords_by_theme():
        if whole_word:
            cond = b.rlike(r"\b(" + "|".join(kws) + r")\b")
        else:
            # a keyword that contains another one of its theme adds nothing
            least = [k for k in kws if not any(o != k and o in k for o in kws)]
            cond = reduce(lambda a, c: a | c, [b.contains(k) for k in least])
        per_theme.append(F.when(cond, F.lit(theme)))
    return F.array_compact(F.array(*per_theme))


def keyword_themes(
    blob: ColumnOrName,
    whole_word: bool = False,
    max_themes: int = 3,
    default: str = DEFAULT_THEME,
) -> Column:
    """First ``max_themes`` matched themes; no match -> [default]."""
    return themes_of(theme_hits(blob, whole_word), max_themes, default)


def themes_of(hits: Column, max_themes: int = 3, default: str = DEFAULT_THEME) -> Column:
    """The first ``max_themes`` of matched themes, or [default]."""
    first = F.slice(hits, 1, max_themes)
    return F.when(F.size(first) > 0, first).otherwise(F.array(F.lit(default)))
