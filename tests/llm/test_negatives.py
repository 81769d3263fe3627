"""Hard negatives against plain scoring of all rows; boxes, ties, unequal lengths and odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import types as T

from revq.llm import negatives

SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
        T.StructField("row", T.StringType()), T.StructField("slot", T.StringType()), T.StructField("x", T.StringType()),
    ]
)


def brute(rows):
    part = []
    for vec_id, x, label in rows:
        if label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        part.append((vec_id, [math.floor(256 * float(np.float32(v))) for v in x], label))
    out = []
    for i, (a, x, label) in enumerate(part):
        if a is None or a % 100:
            continue
        rest = [(-sum(p * q for p, q in zip(x, y)), v is None, v or 0, v, w == label) for j, (v, y, w) in enumerate(part) if j != i]
        rest.sort(key=lambda r: r[:3])
        for ps, _, _, p, _ in [r for r in rest if r[4]][:5]:
            found = [(v, -s) for s, _, _, v, same in rest if not same and 30 * -ps <= 100 * -s <= 90 * -ps]
            out += [(a, p, k + 1, v, -ps, s) for k, (v, s) in enumerate(found[:10])]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=repr)


def make(seed, n, dim=8, labels=10):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(labels, dim))
    return [(i, (middle[i % labels] * 0.6 + r.normal(size=dim) * 0.5).astype(np.float32).tolist(), int(i % labels)) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)


ODD = [
    (None, [0.5] * 8, 3), (None, None, 1), (100, None, 1), (200, [1.0] * 7 + [float("nan")], 2), (300, [1.0] * 7 + [None], 2), (400, [float("inf")] * 8, 2),
    (500, [0.25] * 8, None), (600, [], 4), (700, [0.5] * 3, 4), (800, [0.5] * 11, 4), (900, [0.0] * 8, 5), (100, [0.5] * 8, 3), (100, [0.5] * 8, 3), (100, [0.5] * 8, 4),
    (1000, [300.0] * 8, -1), (1001, [-0.001] * 8, 0),
]


def test_brute_force(spark):
    rows = make(1, 400) + ODD
    for parts in (1, 5):
        assert got(negatives.hard_negatives(frame(spark, rows).repartition(parts))) == brute(rows)


def test_small_trees_and_blocks(spark, monkeypatch):
    rows = make(2, 700, dim=3)
    monkeypatch.setattr(negatives, "BLOCK", 3)
    assert got(negatives.hard_negatives(frame(spark, rows))) == brute(rows)


def test_ties_and_one_hot_vector(spark):
    rows = make(3, 200) + [(1000 + i, [0.75] * 8, 2) for i in range(300)] + [(2000 + i, [0.75] * 8, 3) for i in range(300)]
    assert got(negatives.hard_negatives(frame(spark, rows).repartition(4))) == brute(rows)


def test_sf_small(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert got(negatives.hard_negatives(table)) == brute([(r.vec_id, r.embedding, r.label) for r in table.collect()])


def test_boxes_hold_their_scores(monkeypatch):
    monkeypatch.setattr(negatives, "LEAF", 8)
    r = np.random.default_rng(4)
    x, label = r.integers(-300, 300, (900, 5)), r.integers(0, 4, 900)
    tree = negatives.Tree(x, label)
    assert sorted(tree.order.tolist()) == list(range(900)) and len(tree.levels) > 1
    a = r.integers(-300, 300, (6, 5))
    seen = []
    upper = tree.bounds(a, lambda who, fewest, most: seen.append((fewest <= most).all()) or np.ones(most.shape, bool))
    for (begin, end), v, most in zip(tree.leaf, tree.label, upper.T, strict=True):
        assert set(label[tree.order[begin:end]]) == {v}
        assert ((a @ tree.x[begin:end].T).max(1) <= most).all()
    assert all(seen)


def test_whole_numbers_beyond_doubles(spark):
    rows = [(100 * i if i < 3 else i, [float(2**20 + i), float(2**21 - i), 1.0], i % 2) for i in range(60)]
    assert got(negatives.hard_negatives(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, [0.5], 1)], [(100, [0.5], 1)], [(100, [], 1), (101, [], 1), (102, [], 2)]])
def test_few_rows(spark, rows):
    assert got(negatives.hard_negatives(frame(spark, rows))) == brute(rows)
