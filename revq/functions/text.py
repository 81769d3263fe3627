"""String helpers as Column expressions (all JVM-side, codegen'd)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revq.schema import ELLIPSIS

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(x: ColumnOrName) -> Column:
    """Remove leading/trailing whitespace the way Python's ``str.strip`` does.

    Spark's ``trim`` removes spaces only; ``(?U)`` makes ``\\s`` Unicode-aware.
    """
    return F.regexp_replace(_c(x), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def collapse_ws(x: ColumnOrName) -> Column:
    return F.regexp_replace(_c(x), r"(?U)\s+", " ")


def truncate(x: ColumnOrName, n: int, marker: str = ELLIPSIS) -> Column:
    """First ``n`` characters, plus ``marker`` when something was cut."""
    c = _c(x)
    return F.concat(
        F.substring(c, 1, n), F.when(F.length(c) > n, F.lit(marker)).otherwise(F.lit(""))
    )


def safe_pct(num: ColumnOrName, den: ColumnOrName) -> Column:
    """round(100*num/den) with half-even ties; 0 when den is 0 (BIGINT)."""
    n, d = _c(num), _c(den)
    return (
        F.when(d == 0, F.lit(0))
        .otherwise(F.bround(n.cast("double") * 100.0 / d, 0))
        .cast("long")
    )


def signed_pct_label(pct: ColumnOrName) -> Column:
    """'+12%' / '-5%' / '+0%'."""
    p = _c(pct)
    return F.concat(F.when(p >= 0, F.lit("+")).otherwise(F.lit("")), p.cast("string"), F.lit("%"))
