"""Join helpers.

Dimension joins are left to the planner: AQE re-plans from the measured bytes
of the smaller side (``spark.sql.adaptive.autoBroadcastJoinThreshold``), so a
dimension is broadcast when it is small and hash-joined when it is not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def join_dimension(fact: DataFrame, dim: DataFrame, on: str | list[str], how: str = "left") -> DataFrame:
    """``fact JOIN dim``, broadcast or not by measured size."""
    return fact.join(dim, on, how)
