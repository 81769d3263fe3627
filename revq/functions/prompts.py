"""What a model or a console is shown of a review (H7, I7): fixed cuts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revq.functions.text import _c

ColumnOrName = Column | str

SINGLE_CHARS, BATCH_CHARS, CELL_CHARS = 500, 300, 50  # fixed: code points of a text in a single call, in a call of many, in a table cell


def model_input(text: ColumnOrName, title: ColumnOrName, rating: ColumnOrName, chars: int = SINGLE_CHARS) -> Column:
    """One review as a model is asked about it: rating, title and the first ``chars`` of the text, a line each."""
    empty = F.lit("")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("rating="), F.coalesce(_c(rating), F.lit(0)).cast("string"), F.lit("/5")),
        F.concat(F.lit("title="), F.coalesce(_c(title), empty)),
        F.concat(F.lit("text="), F.substring(F.coalesce(_c(text), empty), 1, chars)),
    )


def cell(value: ColumnOrName, chars: int = CELL_CHARS) -> Column:
    """A value as a table cell: one line of at most ``chars`` code points, '...' where something was cut."""
    c = F.replace(F.coalesce(_c(value).cast("string"), F.lit("")), F.lit("\n"), F.lit(" "))
    return F.when(F.length(c) > chars, F.concat(F.substring(c, 1, chars - 3), F.lit("..."))).otherwise(c)
