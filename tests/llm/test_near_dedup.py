import re
from collections import Counter, defaultdict

import numpy as np
from helpers import prose

from revq.llm import minhash
from revq.llm.components import components, union_find


def brute(rows):
    """doc_id -> (set size, smallest doc_id reachable), all pairs that share a shingle."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else ({tuple(w)} if w else set())
    post = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            post[x].append(i)
    both = Counter((a, b) for p in post.values() for a in p for b in p if a < b)
    links = [(a, b) for (a, b), n in both.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    root = union_find(links)
    return {i: (len(s), root.get(i, i)) for i, s in sets.items()}


def result(df):
    return {(r.doc_id): (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()}


def test_matches_brute_force(docs):
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert result(docs) == want
    assert sum(i != c for i, (_, c) in want.items()) > 5


def test_groups_of_many_blocks(spark, monkeypatch):
    """Copies edited so that only some pairs link, in blocks far smaller than the group."""
    real = minhash.link_groups
    monkeypatch.setattr(minhash, "link_groups", lambda m, p, k, n, limit: real(m, p, k, n, 40 if n == "brief" else 3000))
    r = np.random.default_rng(3)
    base = prose(11, 150).split()
    rows = []
    for i in range(160):
        w = list(base)
        for p in r.integers(0, 150, 3):
            w[p] = f"w{i}x{p}"
        rows.append((i + 1, " ".join(w)))
    rows += [(1000 + i, prose(100 + i, 60)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    assert len({c for _, c in want.values()}) < 190
    assert result(df) == want


def test_odd_rows(odd, empty):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
    assert {x[1:] for x in by[1]} == {(1, True)} and {x[1:] for x in by[2]} == {(1, False)} and {x[1:] for x in by[3]} == {(1, False)}
    for i in (4, 5, 6):
        assert by[i] == {(0, i, True)}
    assert by[8] == {(1, 7, False)} and by[16] == {(1, 15, False)} and len(by[13]) == 1
    kept = minhash.deduplicate(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(13) == 1 and 2 not in ids and ids.count(None) == 2 and {1, 4, 5, 6, 7, 15} <= set(ids)
    assert minhash.near_duplicates(empty).count() == 0 and minhash.deduplicate(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200), (101, 100)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_superminhash_estimates_jaccard():
    r = np.random.default_rng(5)
    x = r.integers(0, 1 << 63, 1500).astype(np.uint64)
    a, b = x[:1000], x[250:1250]
    sig = minhash.superminhash(np.concatenate([a, b]), np.repeat([0, 1], 1000), 2, 128)
    assert abs((sig[0] == sig[1]).mean() - 750 / 1250) < 0.12
    one = minhash.superminhash(x[:1], np.zeros(1, np.int64), 1, 128)
    assert len(np.unique(one >> np.uint64(32))) == 128  # a single element fills every place, in every round


def near(text, *at):
    w = text.split()
    for p in at:
        w[p] = f"edit{p}"
    return " ".join(w)


def test_links_through_rows_without_id(spark):
    base = prose(21, 200)
    # 1 and 2 meet only through the row without an id; 3 is far
    rows = [(1, near(base, 10, 30, 50)), (None, base), (2, near(base, 110, 130, 150)), (3, prose(22, 200))]
    ids = {k: (i or -1, t) for k, (i, t) in enumerate(rows)}
    want = brute([(k + 1, t) for k, (_, t) in ids.items()])
    assert want[1][1] == want[2][1] == want[3][1] == 1 and want[4][1] == 4
    alone = brute([(1, rows[0][1]), (2, rows[2][1])])
    assert alone[2][1] == 2  # without the row between them they stay apart
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()}
    assert got == {(1, 1, True), (None, 1, False), (2, 1, False), (3, 3, True)}
    assert sorted(r.doc_id for r in minhash.deduplicate(df).collect()) == [1, 3]


def test_group_without_any_id(spark):
    base = prose(23, 120)
    rows = [(None, base), (None, near(base, 5)), (None, base), (None, ""), (None, None), (None, prose(24, 120))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(df).collect()
    assert all(r.component_id is None and r.kept for r in got)
    left = sorted(((r.text or "")[:20] for r in minhash.deduplicate(df).collect()))
    assert len(left) == 4 and left.count("") == 2  # one of the group, the far one, both without words


def test_one_id_with_two_texts(spark):
    x, a, c, d = (prose(30 + k, 80) for k in range(4))
    rows = [(1, x, "r1"), (2, a, "r2"), (2, x, "r3"), (3, c, "r4"), (3, d, "r5"), (3, d, "r6")]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark string").repartition(3)
    left = sorted((r.doc_id, r.text) for r in minhash.deduplicate(df).collect())
    assert left == sorted([(1, x), (2, a), (3, c), (3, d)])


def pages(n, seed=9, shared=80, own=20, every=3):
    """Pages of one template with words of their own: rough links, no exact ones; each third has a near copy."""
    template = prose(seed, shared * 2)
    rows = [(i + 1, f"{template} {prose(1000 + i, own * 2)}") for i in range(n)]
    rows += [(10_000 + i, near(rows[i][1], 3, shared * 2 + 7)) for i in range(0, n, every)]
    return rows


def test_template_pages_stay_in_their_blocks(spark, monkeypatch):
    """Many classes of a rough group ask, but sets are sent only where a link may be."""
    real, sent = minhash.routes, []

    def counted(asks, held):
        out = real(asks, held)
        sent.append((asks.count(), asks.agg({"n_blk": "sum"}).first()[0], out.count(), out))
        return out

    monkeypatch.setattr(minhash, "routes", counted)
    # one rough group of all pages, in blocks of few sets
    monkeypatch.setattr(minhash, "ROUGH", 60)
    link = minhash.link_groups
    monkeypatch.setattr(minhash, "link_groups", lambda m, p, k, n, limit: link(m, p, k, n, limit if n == "brief" else 2500))
    rows = pages(200)
    want = brute(rows)
    assert sum(i != c for i, (_, c) in want.items()) == 67
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == want
    asks, everywhere, routed, _ = sent[0]
    assert asks > 200 and everywhere > 4 * asks  # each to every block, before
    assert routed < 1.5 * asks + 200  # now to few blocks beside its own


def test_prefixes_meet_for_every_linked_pair():
    """The first seventh of the smaller set and the first quarter of the larger one share an element, in any order of elements."""
    r = np.random.default_rng(8)
    found = 0
    for _ in range(3000):
        a = set(r.integers(0, 60, r.integers(1, 40)).tolist())
        b = {x for x in a if r.random() > 0.1} | set(r.integers(0, 60, r.integers(0, 5)).tolist())
        small, large = sorted((a, b), key=len)
        if not small or 100 * len(a & b) < 75 * len(a | b):
            continue
        found += 1
        order = r.permutation(60).tolist()
        seventh = len(small) - (150 * len(small) + 174) // 175 + 1
        quarter = len(large) - (75 * len(large) + 99) // 100 + 1
        assert set(sorted(small, key=order.index)[:seventh]) & set(sorted(large, key=order.index)[:quarter])
    assert found > 500
