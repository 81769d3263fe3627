"""Key, rating, title and URL rules (H2-H5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revq.functions.text import _c, py_strip

ColumnOrName = Column | str

# --- fixed values: patterns of page texts and product URLs ---------------------
TITLE_STARS = r"^\d+\.?\d*\s+out of \d+ stars\s*"
ASIN_RE = r"/dp/([A-Z0-9]{10})"
# --- end of fixed values --------------------------------------------------------


def review_key(
    reviewer_id: ColumnOrName,
    date: ColumnOrName,
    product_id: ColumnOrName,
    source: ColumnOrName | None = None,
    strict: bool = False,
) -> Column:
    """md5(reviewer_id || date || product_id), hex.

    ``strict=True`` puts a separator between the parts and adds the source,
    which removes the collisions of the plain concatenation.
    """
    parts = [_c(reviewer_id), _c(date), _c(product_id)]
    if not strict:
        return F.md5(F.concat(*parts))
    if source is not None:
        parts.append(F.lower(_c(source)))
    return F.md5(F.concat_ws("\u001f", *[F.coalesce(p, F.lit("")) for p in parts]))


def parse_rating(star_text: ColumnOrName) -> Column:
    """int(float(first token)) of a star label; NULL when unreadable.

    '4.5 out of 5 stars' -> 4 (truncates toward zero like ``int``). NaN and
    infinities cannot become an int, so they are unreadable, and so is a number
    beyond an int or with a type letter ('4d'). A missing
    star element is the caller's business (the extractor maps it to 0).
    """
    tok = F.split(py_strip(star_text), " ", 2).getItem(0)
    number = F.when(tok.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), tok.try_cast("double"))
    return number.try_cast("int")


def clean_title(title: ColumnOrName) -> Column:
    """Drop a leading 'N out of M stars' label from a review title."""
    return F.regexp_replace(_c(title), TITLE_STARS, "")


def url_tail(url: ColumnOrName) -> Column:
    """Last '/' segment of a URL, cut at '?'."""
    return F.split_part(F.element_at(F.split(_c(url), "/"), -1), F.lit("?"), F.lit(1))


def url_base(url: ColumnOrName) -> Column:
    """URL without query string and fragment."""
    return F.regexp_replace(_c(url), r"[?#].*$", "")


def url_page_no(url: ColumnOrName) -> Column:
    """Value of a ``page=`` / ``pageNumber=`` query parameter, else 1."""
    p = F.regexp_extract(_c(url), r"[?&](?:page|pageNumber)=(\d+)", 1)
    return F.when(p == "", F.lit(1)).otherwise(p.cast("int"))


def asin(url: ColumnOrName) -> Column:
    """Marketplace-A product code from a product URL; NULL when absent."""
    a = F.regexp_extract(_c(url), ASIN_RE, 1)
    return F.when(a == "", F.lit(None)).otherwise(a)
