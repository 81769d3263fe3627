"""Ranked search against a plain scoring of all documents; strata, bounds, blocks and odd rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from helpers import odd_rows, prose
from pyspark.sql import types as T

from revq.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # fixed
ITEMS = T.StructType([T.StructField(n, t) for n, t in (("item_id", T.LongType()), ("text", T.StringType()), ("terms", T.StringType()), ("row", T.StringType()))])


def words(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=50):
    counted = [(d, Counter(words(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in counted:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(words(text)) if t in c)
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.fixture(scope="module")
def items(spark):
    texts = [(1, prose(1, 12)), (2, "Ñandú ÑANDÚ € über a b"), (3, None), (4, ""), (5, "nowhere-found!"), (6, "A b C d E"), (6, "one two"), (None, "x y z a")]
    return spark.createDataFrame([(*t, "x", "y") for t in texts], ITEMS)


def test_odd_rows(spark, odd, items):
    want = brute([(r[0], r[1]) for r in odd_rows()], [(r.item_id, r.text) for r in items.collect()])
    assert got(search.search(odd, items)) == want
    assert got(search.search(odd.repartition(5), items)) == want


def test_sf_small(spark, docs, monkeypatch):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got(search.search(docs, items)) == want
    monkeypatch.setattr(search, "BLOCK_ITEMS", 9)  # several blocks of items
    assert got(search.search(docs, items)) == want


def test_ties_and_a_hot_stratum(spark):
    rows = [(i, "same text here again", None, None, 0) for i in range(400)] + [(1000 + i, prose(i, 5 + i), None, None, 0) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    items = spark.createDataFrame([(0, "same here"), (1, "again " + prose(7, 9))], "item_id long, text string")
    want = brute([(r[0], r[1]) for r in rows], [(r.item_id, r.text) for r in items.collect()])
    assert got(search.search(docs, items)) == want
    assert [r[2] for r in want if r[0] == 0] and all(r[2] < 50 for r in want if r[0] == 0)


def test_visit_skips_strata_but_no_result():
    r = np.random.default_rng(5)
    n, n_terms = 3000, 40
    m = 50 + r.integers(0, 60, n)
    held = r.random((n, n_terms)) < 0.2
    doc, term = np.nonzero(held)
    tf = r.integers(1, 9, len(doc))
    weight = r.integers(1, 8000, n_terms)
    strata = search.Strata(m, term, tf, doc, n_terms)
    for of in (np.arange(5), np.array([7]), np.arange(40), np.array([], int)):
        impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[doc])
        full = np.bincount(doc, np.where(np.isin(term, of), weight[term] * impact, 0), n).astype(np.int64)
        seen = {}

        def better(d, s, seen=seen):
            seen.update(zip(d.tolist(), s.tolist(), strict=True))
            return sorted(seen.values())[-50] if len(seen) >= 50 else 0

        strata.search(of, weight[of], better, 0)
        assert all(full[d] == s for d, s in seen.items())
        assert sorted(seen.values())[-50:] == sorted(full[full > 0].tolist())[-50:]


def test_slices_and_wide_numbers(monkeypatch):
    text = (prose(1, 3000) + "-A_ñ\0É9").encode()
    one = [t for part in search.terms(text) for t in part]
    assert [t.decode() for t in one] == words(text.decode())
    monkeypatch.setattr(search, "SLICE", 17)
    assert [t for part in search.terms(text) for t in part] == one
    n = np.array([1, 10**9, 7])
    assert search.normaliser(n, 10**11, 10**13).tolist() == [50 + 50 * int(x) * 10**11 // 10**13 for x in n]


def test_long_text_in_slices(spark, monkeypatch):
    place = {b"a": 0, b"b": 1, b"c": 2}
    monkeypatch.setattr(search, "SLICE", 8)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a b A zz c a zzz b a" * 3, None]})
    rows = next(search._forward(place)(iter([batch]))).to_pylist()
    count = Counter(w for w in words("a b A zz c a zzz b a" * 3))
    assert rows[0]["n"] == sum(count.values()) and rows[0]["tfs"] == [count["a"], count["b"], count["c"]]
    assert rows[1] == {"doc_id": 2, "n": 0, "terms": [], "tfs": []}


def test_empty_tables(spark, empty, odd, items):
    assert search.search(empty, items).collect() == []
    assert search.search(odd, items.limit(0)).collect() == []
