from collections import defaultdict

from helpers import prose

from revq.llm import mixing


def fill(sizes):
    """Targets by adding words in small steps is too coarse; share the rest by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    room, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = room / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not above:
            return target | {s: level * weight[s] for s in open_}
        for s in above:
            target[s] = 2.0 * sizes[s]
            room -= target[s]
        open_ -= above
    return target


def check(df):
    rows = mixing.mix(df).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(df.repartition(3)).collect()), key=repr)
    by, largest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        by[r.source] += r.size
        largest[r.source] = max(largest[r.source], r.size)
        taken[r.source] += r.taken
        assert r.taken in (0, r.size, 2 * r.size)
    target = fill(by)
    for r in rows:
        assert r.source_size == by[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, r.target)
    for s in by:
        assert abs(taken[s] - target[s]) <= 2 * largest[s]
    assert sum(taken.values()) <= 1.5 * sum(by.values())
    return rows


def test_targets_and_takings(docs, odd):
    check(docs)
    rows = check(odd)
    assert len(rows) == odd.count() and {r.taken for r in rows if r.size == 0} == {0}


def test_stage(odd, empty, docs):
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    want = {r.doc_id: r.taken // r.size for r in mixing.mix(docs).collect() if r.taken}
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == want
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_few_sources(spark):
    rows = [(i, "w " * (i % 7 + 1), "only") for i in range(50)]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    rows = [(1, "a b c", "s"), (2, "a", "t"), (3, None, None)]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_rows_without_id_keep_the_budget(spark):
    """Each row comes as often as the mix took it, rows without an id and repeated ones too."""
    rows = [(None, prose(i, 20 + i), "x", "a") for i in range(40)] + [(None, prose(1, 21), "x", "a")] * 3
    rows += [(5, prose(70 + i, 30), "x", "b") for i in range(3)] + [(i, prose(100 + i, 25), "x", "c") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    took = mixing.mix(df).collect()
    out = mixing.mixed_documents(df).collect()
    words = lambda r: len(r.text.split())
    assert sum(map(words, out)) == sum(r.taken for r in took) <= 1.5 * sum(r.size for r in took)
    for s in "abc":
        assert sum(words(r) for r in out if r.source == s) == sum(r.taken for r in took if r.source == s)
