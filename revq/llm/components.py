"""Connected components of an edge table, without gathering any of it.

Edges are first thinned by union-find inside each partition; then large-star
and small-star steps run on the whole table until nothing changes. Each step
writes its table to the shared folder, so nothing is replayed from the start
when an executor is lost, and the number of steps grows with the logarithm of
the longest path. Minima are combined on the map side before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revq.llm.common import in_tasks, tidy, written


def union_find(pairs: list[tuple[int, int]]) -> dict[int, int]:
    """The smallest member of each node's group."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (p := parent.setdefault(top, top)) != top:
            top = p
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch the forest that its edges span, as (child, smallest member)."""
    for batch in batches:
        pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        found = [(x, r) for x, r in union_find(list(pairs)).items() if x != r]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())],
            names=["u", "v"],
        )


@tidy
def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) -> (node, label); label is the smallest node reached.

    Nodes without an edge do not come out. Null ends, loops and repeated
    edges do no harm; an empty table gives an empty one.
    """
    clean = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a != b")
    now = written(clean.transform(in_tasks, _thin, "u long, v long").distinct(), "edges")
    last = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.filter("u != v").distinct(), "large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "small")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.filter("u != v").union(low).distinct(), "edges")
        row = now.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if row == last:
            break
        last = row
    roots = now.select(F.col("v").alias("u"), "v").distinct()
    return now.union(roots).select(F.col("u").alias("node"), F.col("v").alias("label"))
