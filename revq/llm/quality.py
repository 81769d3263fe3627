"""Quality classifier: histogram gradient-boosted trees over text statistics.

``FEATURES`` are counts and ratios of the whole text. Training takes at most
``MAX_ROWS`` labelled rows (chosen by a hash of doc_id; the bound is a
parameter), bins every feature into ``BINS`` quantile bins and grows
``TREES`` trees of depth ``DEPTH`` on the logistic loss, level by level, from
gradient histograms. The model is three flat arrays (feature, threshold,
leaf); scoring walks all rows of a batch down one level at a time in numpy
inside ``mapInArrow``, one scan without a shuffle.

Nulls and odd input: a null or empty text has all-zero statistics and gets a
score like any other; rows without a label or doc_id teach nothing; repeated
rows score alike; without training rows every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revq.llm.common import in_tasks, texts_of
from revq.llm.rules import count_block
from revq.llm.words import blocks, owners, word_hashes

MAX_ROWS = 40_000
BINS, TREES, DEPTH, RATE, L2, MIN_HESS = 64, 48, 4, 0.2, 1.0, 1.0
THRESHOLD = 0.3
FEATURES = [
    "log_words", "word_len", "symbols", "dup_lines", "repeats", "line_words", "distinct", "upper", "digits",
    "punct", "marks", "bars", "non_ascii", "stops", "commas", "letters", "log_lines", "top_byte",
]


def _spread(counts: np.ndarray, of: bytes) -> np.ndarray:
    return counts[:, np.frombuffer(of, np.uint8)].sum(axis=1)


UPPER, LOWER, DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
PUNCT = bytes(c for c in range(33, 127) if c not in UPPER + LOWER + DIGIT)


def features(texts: list[bytes]) -> np.ndarray:
    """(texts x FEATURES) float64 statistics of a block of texts."""
    c = count_block(texts)
    size = np.array([len(t) for t in texts], np.float64)
    per = np.stack([np.bincount(np.frombuffer(t, np.uint8), minlength=256) for t in texts]).astype(np.float64)
    h, bounds = word_hashes(texts, lower=True)
    own = owners(bounds)
    order = np.lexsort((h, own))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (own[order][1:] != own[order][:-1])
    distinct = np.bincount(own[order][new], minlength=len(texts))
    words, lines, size = np.maximum(c["n_words"], 1), np.maximum(c["n_lines"], 1), np.maximum(size, 1)
    letters = _spread(per, UPPER) + _spread(per, LOWER)
    cols = [
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines,
        c["n_repeat_words"] / words, c["n_words"] / lines, distinct / words, _spread(per, UPPER) / np.maximum(letters, 1),
        _spread(per, DIGIT) / size, _spread(per, PUNCT) / size, _spread(per, b"!?") / words, _spread(per, b"|") / words,
        per[:, 128:].sum(axis=1) / size, _spread(per, b".") / words, _spread(per, b",") / words, letters / size,
        np.log1p(c["n_lines"]), per.max(axis=1) / size,
    ]
    return np.stack(cols, axis=1)


@dataclass
class Trees:
    """Complete binary trees, flat: node i has the children 2i+1 and 2i+2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes; right if value > threshold
    leaf: np.ndarray  # trees x 2^depth

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - (len(leaf) - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def train(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees on the rows x with labels y (0 or 1)."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    if not len(y):
        return Trees(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    p = np.clip(y.mean(), 0.01, 0.99)
    raw = np.full(len(y), np.log(p / (1 - p)))
    cuts = np.quantile(x, np.arange(1, BINS) / BINS, axis=0).T  # features x (BINS - 1)
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    n_feat = x.shape[1]
    cell = binned + np.arange(n_feat) * BINS
    out = Trees(float(raw[0]), np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves)))
    for k in range(TREES):
        prob = 1 / (1 + np.exp(-raw))
        grad, hess = y - prob, prob * (1 - prob)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            width, first = 2**level, 2**level - 1
            flat = ((node - first)[:, None] * (n_feat * BINS) + cell).ravel()
            shape = (width, n_feat, BINS)
            g, h = (
                np.bincount(flat, np.repeat(w, n_feat), width * n_feat * BINS).reshape(shape).cumsum(axis=2) for w in (grad, hess)
            )
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + L2) + (all_g - g) ** 2 / (all_h - h + L2) - all_g**2 / (all_h + L2)
            gain = np.where((h >= MIN_HESS) & (all_h - h >= MIN_HESS), gain, -1.0)[:, :, :-1].reshape(width, -1)
            best = gain.argmax(axis=1)
            feat, cut = best // (BINS - 1), best % (BINS - 1)
            splits = gain[np.arange(width), best] > 1e-6
            out.feature[k, first : first + width] = np.where(splits, feat, 0)
            out.threshold[k, first : first + width] = np.where(splits, cuts[feat, cut], np.inf)
            node = 2 * node + 1 + (x[np.arange(len(y)), out.feature[k, node]] > out.threshold[k, node])
        end = node - inner
        g, h = np.bincount(end, grad, leaves), np.bincount(end, hess, leaves)
        out.leaf[k] = RATE * g / (h + L2)
        raw += out.leaf[k][end]
    return out


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = texts_of(batch.column("text"))
        for first, end in blocks(texts):
            x = features(texts[first:end])
            n = end - first
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(first, n), batch.column("quality").slice(first, n),
                    *(pa.array(x[:, i]) for i in range(x.shape[1])),
                ],
                names=["doc_id", "quality", *FEATURES],
            )


def fit(docs: DataFrame, labels: DataFrame, training: Column, max_rows: int = MAX_ROWS) -> Trees:
    """Trees learned from at most ``max_rows`` labelled documents where ``training`` (on doc_id) holds."""
    usable = labels.filter(training & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    usable = usable.select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    share = min(1.0, 0.97 * max_rows / max(1, usable.count()))
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20)))
    chosen = chosen.limit(max_rows).withColumnRenamed("doc_id", "_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))  # at most max_rows narrow rows
    made = rows.select("doc_id", "quality", "text").transform(in_tasks, _featured, "doc_id long, quality int, " + ", ".join(f"{c} double" for c in FEATURES)
    )
    found = made.toPandas().sort_values(["doc_id", "quality", *FEATURES], kind="stable")
    return train(found[FEATURES].to_numpy(np.float64), (found["quality"].to_numpy() > 0).astype(np.float64))


def _scorer(trees: Trees) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for first, end in blocks(texts):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, end - first), pa.array(trees.score(features(texts[first:end])))],
                    names=["doc_id", "score"],
                )

    return run


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    made = docs.select("doc_id", "text").transform(in_tasks, _scorer(trees), "doc_id long, score double")
    return made.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
