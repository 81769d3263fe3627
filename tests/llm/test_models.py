"""Trained and sampled parts against plain versions: tree splits, bound letter vectors, weighted samples."""

from collections import Counter

import numpy as np

from revq.llm import fingerprint, language, quality
from revq.llm.words import word_hashes


def best_split(x, g, h):
    """The cut of largest gain over all features and cuts, by adding up both sides."""
    out = (0.0, None)
    for f in range(x.shape[1]):
        cuts = np.quantile(x_all[:, f], np.arange(1, quality.BINS) / quality.BINS)
        for c in cuts:
            left = x[:, f] <= c
            if h[left].sum() < quality.MIN_HESS or h[~left].sum() < quality.MIN_HESS:
                continue
            score = lambda m: g[m].sum() ** 2 / (h[m].sum() + quality.L2)
            gain = score(left) + score(~left) - g.sum() ** 2 / (h.sum() + quality.L2)
            if gain > out[0] + 1e-9:
                out = (gain, (f, c))
    return out[1]


def test_trees_equal_exhaustive_splits(monkeypatch):
    global x_all
    monkeypatch.setattr(quality, "TREES", 2)
    monkeypatch.setattr(quality, "DEPTH", 2)
    r = np.random.default_rng(3)
    x_all = r.normal(size=(400, 4)).round(2)
    y = ((x_all[:, 1] > 0.3) ^ (x_all[:, 2] > -0.2) | (r.random(400) < 0.1)).astype(int)
    trees = quality.train(x_all, y)
    raw = np.full(400, np.log(y.mean() / (1 - y.mean())))
    assert abs(trees.base - raw[0]) < 1e-12
    for k in range(2):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)

        def walk(rows, node, depth, k=k, g=g, h=h):
            if depth == 2:
                value = quality.RATE * g[rows].sum() / (h[rows].sum() + quality.L2)
                assert abs(trees.leaf[k, node - 3] - value) < 1e-9
                raw[rows] += value
                return
            split = best_split(x_all[rows], g[rows], h[rows])
            if split is None:
                assert trees.threshold[k, node] == np.inf
                walk(rows, 2 * node + 1, depth + 1)
                return
            assert (trees.feature[k, node], trees.threshold[k, node]) == split
            right = x_all[rows, split[0]] > split[1]
            walk(rows[~right], 2 * node + 1, depth + 1)
            walk(rows[right], 2 * node + 2, depth + 1)

        walk(np.arange(400), 0, 0)
    assert np.allclose(trees.score(x_all), 1 / (1 + np.exp(-raw)))


def test_bound_vectors_and_bundles():
    letter = np.random.default_rng(language.SEED).choice(np.array([-1, 1], np.int8), (language.SYMBOLS, language.DIM))
    rot = lambda v: np.concatenate([v[-1:], v[:-1]])
    table, made = language._symbol_table(), language.trigram_vectors()

    def naive(text):
        s = [0]
        for ch in text:
            v = int(table[ord(ch)])
            if v or s[-1]:
                s.append(v)
        if s[-1]:
            s.append(0)
        total = np.zeros(language.DIM)
        for a, b, c in zip(s, s[1:], s[2:]):
            if b:
                bound = rot(rot(letter[a])) * rot(letter[b]) * letter[c]
                assert (made[(a * language.SYMBOLS + b) * language.SYMBOLS + c] == bound).all()
                total += bound
        return total

    texts = ["The quick brown fox", "¿Dónde está el niño?", "x", "a-b  c\n\nd", "Straße über Äpfel 12 mal"]
    proto = np.random.default_rng(1).normal(size=(3, language.DIM))
    proto /= np.linalg.norm(proto, axis=1, keepdims=True)
    pred, score = language.classify(texts, ["p", "q", "r"], proto)
    for i, text in enumerate(texts):
        v = naive(text)
        cos = proto @ v / np.linalg.norm(v)
        assert pred[i] == "pqr"[int(cos.argmax())] and abs(score[i] - max(0.0, cos.max())) < 1e-4


def test_weighted_samples_one_by_one():
    """The smallest a of all weighted terms of a text, place by place."""
    gamma, log_gamma = fingerprint._gamma()
    mask, odd = (1 << 64) - 1, 0xD6E8FEB86659FD93

    def mixed(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    text = b"the cat and the dog and the bird saw a cat and a fox " * 3 + b"once"
    h, _ = word_hashes([text], lower=True)
    weights = Counter(h.tolist())
    want = []
    for k in range(fingerprint.SAMPLES):
        place = mixed((k + 1) * 0x9E3779B97F4A7C15 & mask)
        found = []
        for term, w in weights.items():
            z = mixed((term + place) & mask)
            r, log_c = gamma[z & 0xFFFF], log_gamma[z >> 16 & 0xFFFF]
            beta = np.float32(z >> 32) * np.float32(2.0**-32)
            t = np.floor(np.log(np.float32(w)) / r + beta)
            found.append((float(log_c - r * (t - beta) - r), mixed((z + int(t) * odd) & mask) >> 32 & 0xFFFF))
        want.append(max(1, min(found)[1]))
    assert fingerprint.fingerprints([text])[0].tolist() == want
