"""Adaptive rules: fences against exact quantiles, and groups with habits of their own."""

import random

import numpy as np
import pytest

from revq.llm import rules

SCHEMA = "doc_id long, text string, lang string, source string"


def text(r, words, symbols=0, letters=5, again=0):
    out = ["".join(r.choice("abcdefghijklmnopq") for _ in range(max(1, letters + r.randint(-1, 1)))) for _ in range(words)]
    for i in r.sample(range(words), symbols):
        out[i] = r.choice("#*$%&|<>")
    lines = [" ".join(out[i : i + 12]) for i in range(0, words, 12)]
    return "\n".join(lines + lines[:again])


@pytest.fixture(scope="module")
def rows():
    r, out = random.Random(3), []

    def add(n, lang, source, **k):
        for _ in range(n):
            out.append((len(out), text(r, r.randint(80, 160), **{a: (b() if callable(b) else b) for a, b in k.items()}), lang, source))

    add(120, "en", "plain")
    add(120, "en", "markup", symbols=lambda: r.randint(0, 40))
    add(90, "de", "long", letters=9)
    add(20, "de", "few", letters=6)  # judged by its language
    for lang, source in (("en", "plain"), ("en", "markup"), ("de", "long"), ("de", "few")):
        add(1, lang, source, symbols=40)
        add(1, lang, source, letters=14)
        add(1, lang, source, letters=1)
        add(1, lang, source, again=5)
    out += [(len(out), None, "en", "plain"), (len(out) + 1, "", None, None), (len(out) + 2, text(r, 200), "xx", "alone")]
    return out


def ratios(t):
    c = {k: int(v[0]) for k, v in rules.count_block([(t or "").encode()]).items()}
    n = max(1, c["n_words"])
    return c, {"symbols": c["n_symbols"] / n, "dup_lines": c["n_dup_lines"] / max(1, c["n_lines"]), "repeats": c["n_repeat_words"] / n, "word_len": c["word_chars"] / n}


def exact(values, q):
    """Smallest value whose rank is ``q`` or more."""
    return sorted(values)[max(0, int(np.ceil(round(q * len(values), 9))) - 1)]


def brute(rows, least):
    made = {i: ratios(t) for i, t, *_ in rows}
    out = {}
    for i, _, lang, source in rows:
        c, mine = made[i]
        groups = [lambda l, s: (l, s) == (lang, source), lambda l, s: l == lang, lambda l, s: True]
        for k, own in enumerate(groups):
            members = [made[j] for j, _, l, s in rows if own(l, s) and made[j][0]["n_words"]]
            if len(members) >= least or k == 2:
                break
        found = []
        if c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]:
            found.append("base")
        words = exact([m[0]["n_words"] for m in members], 0.5)
        for k, q in rules.OUTER.items():
            lo, mid, hi = (exact([m[1][k] for m in members], x) for x in (1 - q, 0.5, q))
            width = rules.LEAST_COUNT[k] / words if k in rules.LEAST_COUNT else rules.LEAST[k]
            if mine[k] > hi + rules.SPREAD * max(hi - mid, width):
                found.append(k)
            if k == "word_len" and mine[k] < lo - rules.SPREAD * max(mid - lo, width):
                found.append("short_words")
        out[i] = sorted(found)
    return out


def test_fences_equal_exact_quantiles(spark, rows, monkeypatch):
    monkeypatch.setattr(rules, "MIN_ROWS", 60)  # the sketches hold so few rows whole
    got = {r.doc_id: sorted(r.reasons) for r in rules.judge(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    # a row without words has no group of its own in the brute force either
    want = brute([x for x in rows if x[1]], 60) | {i: ["base"] for i, t, *_ in rows if not t}
    assert got == want


def test_groups_have_fences_of_their_own(spark, rows, monkeypatch):
    monkeypatch.setattr(rules, "MIN_ROWS", 60)
    found = {r.doc_id: (r.lang, r.source, set(r.reasons)) for r in rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    by = {}
    for lang, source, reasons in (found[i] for i in range(350, 366)):
        by.setdefault((lang, source), []).append(reasons)
    # forty symbols are usual in one source and not in the other; so are long words
    assert "symbols" in by["en", "plain"][0] and "symbols" not in by["en", "markup"][0]
    assert "word_len" in by["en", "plain"][1] and "short_words" in by["de", "long"][2] and "dup_lines" in by["en", "plain"][3]
    clean = [found[i][2] for i in range(350)]
    assert sum(not x for x in clean) >= 0.97 * len(clean)


def test_fences_decide_at_scale(spark):
    """On the given rows every ratio has fences that differ between groups, and clean rows stay."""
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    counts = rules.text_counts(d).cache()
    cut = [r.cut for r in rules.fences(counts).collect()]
    counts.unpersist()
    for k in rules.OUTER:
        width = {round(rules.LEAST_COUNT[k] / c.words_mid if k in rules.LEAST_COUNT else max(rules.LEAST[k], c[f"{k}_hi"] - c[f"{k}_mid"]), 6) for c in cut}
        assert len(width) > 1, k
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = [r for r in rules.judge(d).collect() if not r.base_failed and labels.get(r.doc_id) is not None]
    clean, junk = [r.kept for r in rows if labels[r.doc_id] == 1], [r.kept for r in rows if labels[r.doc_id] == 0]
    assert np.mean(clean) > 0.98 and np.mean(junk) < 0.02
    reasons = {x for r in rows for x in r.reasons}
    assert {"symbols", "repeats", "word_len"} <= reasons
