import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from revq.llm import fingerprint, language, licenses, quality, rules
from revq.llm.queries import op6_cws_fingerprint, op8_quality_trees, op9_adaptive_rules, op10_language_hd
from revq.llm.words import word_hashes

SF = "/root/testdata/sf0.01"


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    hot = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(hot) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hot), failed


def test_rule_counts(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op9_adaptive_rules(spark, SF).collect()
    want = {r.doc_id: counts(r.text) for r in docs.select("doc_id", "text").collect()}
    assert {r.doc_id: tuple(r)[1:7] for r in rows} == want
    assert not any(r.kept and r.base_failed for r in rows)
    clean = [r.kept for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    junk = [r.kept for r in rows if labels.get(r.doc_id) == 0]
    assert np.mean(clean) > 0.98 and np.mean(junk) < 0.05
    got = sorted((tuple(r)[0:1] + tuple(r)[3:9] for r in rules.judge(odd).collect()), key=repr)
    assert got == sorted(((r.doc_id, *counts(r.text)) for r in odd.select("doc_id", "text").collect()), key=repr)
    assert rules.judge(empty).count() == 0


def test_long_text_in_pieces(monkeypatch):
    from revq.llm import words

    text = ("alpha beta\n" * 700 + "x" * 5000 + " omega").encode()
    whole, _ = word_hashes([text])
    monkeypatch.setattr(words, "BLOCK", 1000)
    words._powers.cache_clear()
    cut, _ = word_hashes([text])
    words._powers.cache_clear()
    assert (whole == cut).all() and len(whole) == 1402


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_quality_held_out(spark, odd, empty):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op8_quality_trees(spark, SF).collect()
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) > 0.95
    none = spark.createDataFrame([], "doc_id long, quality int")
    trees = quality.fit(odd, none, F.lit(True))
    assert {r.score for r in quality.score(odd, trees).collect()} == {0.5}
    some = spark.createDataFrame([(1, 1), (14, 0), (14, 0), (None, 1), (2, None)], "doc_id long, quality int")
    assert quality.score(odd, quality.fit(odd, some, F.lit(True))).count() == odd.count()
    assert quality.score(empty, trees).count() == 0


def test_flat_trees_equal_walked_trees():
    r = np.random.default_rng(1)
    x = r.normal(size=(2000, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    trees = quality.train(x, y)
    walked = []
    for row in x[:200]:
        total = trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + int(row[f[at]] > t[at])
            total += leaf[at - len(f)]
        walked.append(1 / (1 + np.exp(-total)))
    assert np.allclose(walked, trees.score(x[:200])) and ((trees.score(x) > 0.5) == y).mean() > 0.97


def test_language_held_out(spark, odd, empty):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op10_language_hd(spark, SF).collect()
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)
    held = [langs[r.doc_id] == r.lang_pred for r in rows if r.held_out and langs[r.doc_id]]
    assert len(held) > 100 and np.mean(held) > 0.98
    got = language.identify(odd, F.lit(True)).collect()
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert len(got) == odd.count() and und == {4, 5, 6, 9, None} and all(r.score == 0 for r in got if r.lang_pred == "und")
    kept = language.keep_identified(odd, F.lit(True))
    assert kept.columns == odd.columns and not {4, 5, 6, 9} & {r.doc_id for r in kept.collect()}
    assert language.identify(empty, F.lit(True)).count() == 0


def test_unlearned_languages_go(spark):
    """Other scripts and letter junk go, whatever their length allows to tell; clean texts stay."""
    import random

    r = random.Random(4)
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    junk = [" ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(200)) for _ in range(5)]
    russian = "Это совсем обычный русский текст о погоде и жизни. "
    bad = [*junk, russian, russian * 40, "日本語の文章です", "Αυτό είναι ελληνικό κείμενο " * 5, "12 34 !!", "", None]
    made = rows.unionByName(spark.createDataFrame([(10**6 + i, t, None) for i, t in enumerate(bad)], rows.schema))
    kept = {x.doc_id for x in language.keep_identified(made, F.lit(True)).collect()}
    assert not [i for i in range(len(bad)) if 10**6 + i in kept]
    quality = {x.doc_id: x.quality for x in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    clean = [i for i, q in quality.items() if q == 1]
    assert sum(i in kept for i in clean) >= 0.995 * len(clean)


def test_language_pieces(monkeypatch):
    """A text read in small pieces has the same trigrams as one read whole."""
    text = "Ünder the 12 bridges, señor! Ça va?" * 9
    whole = language.trigrams(text)
    monkeypatch.setattr(language, "PIECE", 7)
    cut = language.trigrams(text)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def jaccard(a, b):
    a, b = (Counter(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))) for t in (a, b))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_fingerprints(spark):
    import hashlib

    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    rows = {r.doc_id: r for r in op6_cws_fingerprint(spark, SF).collect()}
    errors = []
    prints = {}
    for k, (i, t) in enumerate(docs):
        nxt = docs[(k + 1) % len(docs)]
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[1][:q]
        r = rows[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        same = lambda a, b: np.mean([a[j : j + 4] == b[j : j + 4] for j in range(0, len(a), 4)])
        assert r.near_edited == same(r.fingerprint, r.edited_fingerprint) and r.near_next == same(r.fingerprint, rows[nxt[0]].fingerprint)
        errors.append((r.near_edited - jaccard(t, edited), r.near_next - jaccard(t, nxt[1])))
    err = np.array(errors)
    assert np.abs(err.mean(axis=0)).max() < 0.01 and err.std(axis=0).max() < 0.07


def test_fingerprint_odd_rows(spark, odd, empty):
    rows = fingerprint.fingerprint(odd).collect()
    assert len(rows) == odd.count() and fingerprint.fingerprint(empty).count() == 0
    by = {r.doc_id: r for r in rows}
    assert set(by[4].fingerprint) == {"0"} and by[4].near_next == 1.0 and by[4].near_edited == 1.0  # 4 and 5 are both empty
    one = spark.createDataFrame([(3, "alone here")], "doc_id long, text string")
    r = fingerprint.fingerprint(one).first()
    assert r.near_next == 1.0


def test_fingerprints_of_rows_without_id(spark):
    """Rows without an id are many ranges, in the order of their texts' hashes, before all others."""
    import hashlib

    from helpers import prose

    rows = [(None, prose(i, 30)) for i in range(60)] + [(i, prose(100 + i, 30)) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    texts = [r.text for r in df.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).collect()]
    want = set()
    for k, t in enumerate(texts):
        q = len(t) // 4
        want.add(hashlib.sha256((t[: len(t) - q] + texts[(k + 1) % len(texts)][:q]).encode()).hexdigest())
    assert {r.edited_sha256 for r in fingerprint.fingerprint(df).collect()} == want


def brute_pairs(text, form):
    """Longest common subsequence length, for short notices."""
    table = np.zeros((len(text) + 1, len(form) + 1), int)
    for i, a in enumerate(text):
        for j, b in enumerate(form):
            table[i + 1, j + 1] = table[i, j] + 1 if a == b else max(table[i, j + 1], table[i + 1, j])
    return table[-1, -1]


def test_licenses(spark, docs, odd, empty):
    notice = licenses.TEMPLATES
    for name, text in notice.items():
        found = licenses.licenses_of("Some words before. " + text + " and some after it")
        assert name in {n for n, c, *_ in found if c == 1.0}, name
    twice = licenses.licenses_of(notice["MIT"] + "\n" + notice["MIT"])
    assert [n for n, *_ in twice].count("MIT") == 2
    assert licenses.licenses_of("a license to sing, under the moon") == [] and licenses.licenses_of(None) == []
    form = licenses.FORMS["GPL-header"]
    text = [w for k, w in enumerate(form) if k % 11] + ["extra"]
    assert len(licenses.align(text, form)) == brute_pairs(text, form)
    rows = {r.doc_id: {x.license for x in r.spans} for r in licenses.scan_licenses(docs).collect()}
    lines = {"Apache-2.0", "GPL-3.0", "MIT", "CC-BY-NC-4.0", "All-rights-reserved"}
    for r in docs.collect():
        assert {n for n in lines if notice[n] in (r.text or "")} <= rows[r.doc_id]
        if not re.search("licen|rights|copyright", r.text or "", re.I):
            assert not rows[r.doc_id]
    assert licenses.scan_licenses(odd).count() == odd.count() and licenses.scan_licenses(empty).count() == 0


def test_licenses_beside_other_cues():
    """A cue before, inside or after a notice cuts it nowhere."""
    notice = licenses.TEMPLATES

    def names(text):
        return [(n, c) for n, c, *_ in licenses.licenses_of(text)]

    assert names("Copyright (c) 2024 X. " + notice["BSD"]) == [("BSD", 1.0)]
    assert names("License: " + notice["Apache-2.0"]) == [("Apache-2.0", 1.0)]
    assert names(notice["MIT"] + " so" * 20 + " " + notice["Apache-2.0"]) == [("MIT", 1.0), ("Apache-2.0", 1.0)]
    for name in ("MIT", "MIT-full", "BSD", "GPL-header"):
        for between in ("\n", "\nCopyright (c) 2024 X.\n", "\nLicense:\n"):
            assert names(between.join([notice[name]] * 3)).count((name, 1.0)) == 3, (name, between)
    edited = " ".join(w for k, w in enumerate(notice["MIT-full"].split()) if k % 9 != 4)
    assert [n for n, _ in names("the license " + edited + " Copyright 2024 " + edited)] == ["MIT-full", "MIT-full"]
    assert names("Released under something else. rights " * 5 + "license " * 500) == []


def test_license_names():
    """One-line notices that differ in a name, a version or a variant get their own name or none."""
    notices = {
        "Released under the BSD License.": ["BSD"],
        "Licensed under the Mozilla Public License, Version 2.0.": ["MPL-2.0"],
        "This work is licensed under the GNU Lesser General Public License, version 3.": ["LGPL-3.0"],
        "This work is licensed under the GNU General Public License, version 2.": ["GPL-2.0"],
        "Licensed under CC BY 4.0.": ["CC-BY-4.0"],
        "Licensed under CC BY-SA 4.0.": ["CC-BY-SA-4.0"],
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": ["CC-BY-SA-4.0"],
        licenses.TEMPLATES["ISC-full"]: ["ISC"],
        "Licensed under the Eclipse Public License, Version 2.0.": [],
        "Licensed under CC BY 3.0.": [],
        "This work is licensed under the GNU General Public License, version 1.": [],
        "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License.": [],
        "Licensed under the Apache License, Version 1.1.": [],
        "Released under the PHP License.": [],
    }
    for text, names in notices.items():
        for whole in (text, "Some words before. " + text + " and words after it."):
            assert [licenses.identifier(n) for n, *_ in licenses.licenses_of(whole)] == names, whole


def test_every_notice_has_its_own_name():
    for name, text in licenses.TEMPLATES.items():
        assert any(w in licenses.CUES for w in licenses.FORMS[name]), name
        found = licenses.licenses_of("Words before it. " + text + " Words after.")
        assert {licenses.identifier(n) for n, *_ in found} == {licenses.identifier(name)}, (name, found)
    both = licenses.licenses_of(licenses.TEMPLATES["GPL-2.0-header"] + "\n" + licenses.TEMPLATES["LGPL-3.0-header"] + "\n" + licenses.TEMPLATES["GPL-header"])
    assert [licenses.identifier(n) for n, *_ in both] == ["GPL-2.0", "LGPL-3.0", "GPL-3.0"]


def test_license_lines_by_brute_force(docs):
    """Short notices against the longest common subsequence of every window of every text."""
    short = {n: f for n, f in licenses.FORMS.items() if len(f) <= 14}
    hits = 0
    for r in docs.collect():
        words = licenses.norm((r.text or "").split())
        cues = [i for i, w in enumerate(words) if w in licenses.CUES]
        want = set()
        for name, form in short.items():
            telling = licenses.TELLING[name].split()
            for i in cues:
                part = words[max(0, i - len(form)) : i + len(form)]
                for a in range(len(part)):
                    span = part[a : a + len(form)]
                    if all(t in span for t in telling) and brute_pairs(span, form) >= licenses.COVER * len(form):
                        if not any(w in licenses.FOREIGN and w not in form for w in span):
                            want.add(licenses.identifier(name))
        got = {licenses.identifier(n) for n, *_ in licenses.licenses_of(r.text) if n in short}
        assert got == want, (r.doc_id, got, want)
        hits += len(got)
    assert hits > 5
