"""Review date normalisation (H1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revq.functions.text import _c, collapse_ws, py_strip

ColumnOrName = Column | str

# --- fixed values: the accepted layouts, tried in this order ----------------
# (Python strptime forms: %d %B %Y, %d %b %Y, %B %d, %Y, %b %d, %Y,
#  %d-%m-%Y, %d/%m/%Y, %b, %Y, %B, %Y; month-only forms give day 1)
DATE_PATTERNS = [
    "d MMMM yyyy",
    "d MMM yyyy",
    "MMMM d, yyyy",
    "MMM d, yyyy",
    "d-M-yyyy",
    "d/M/yyyy",
    "MMM, yyyy",
    "MMMM, yyyy",
]
COUNTRY_PREFIX = r"(?U)Reviewed in \w+ on\s*"
BUYER_PREFIX = r"Certified Buyer,?\s*"
# --- end of fixed values ---------------------------------------------------


def clean_date_text(raw: ColumnOrName) -> Column:
    s = py_strip(F.regexp_replace(_c(raw), COUNTRY_PREFIX, ""))
    s = py_strip(F.regexp_replace(s, BUYER_PREFIX, ""))
    # strptime lets one space in the layout match any whitespace run
    return collapse_ws(s)


def parse_review_date(raw: ColumnOrName) -> Column:
    """DATE or NULL. ``try_to_date`` keeps ANSI mode from raising."""
    s = clean_date_text(raw)
    return F.coalesce(*[F.try_to_date(s, p) for p in DATE_PATTERNS])


def normalize_date(raw: ColumnOrName) -> Column:
    """'YYYY-MM-DD' when parsed, else the *uncleaned* input (observed rule)."""
    d = parse_review_date(raw)
    return F.when(d.isNotNull(), F.date_format(d, "yyyy-MM-dd")).otherwise(_c(raw))
