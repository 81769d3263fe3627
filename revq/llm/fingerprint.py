"""Document fingerprints by consistent weighted sampling.

A text's weighted terms are its words (A-Z lower-cased) with their counts. For
each of ``SAMPLES`` places and each term, r and c are Gamma(2, 1) and beta is
uniform, all drawn from a hash of term and place; with weight w

    t = floor(ln w / r + beta),   ln a = ln c - r * (t - beta) - r,

and the place's sample is the (term, t) with the smallest a. Two texts share a
place's sample with probability equal to their generalised Jaccard similarity,
sum(min(w)) / sum(max(w)). A fingerprint is 16 bits of each sample as hex;
likeness is the share of equal places.

The edited text and the next document need neighbours in doc_id order:
documents are dealt into doc_id ranges (bounds from Spark's quantiles, a
number per partition), sorted inside, and the first document of each range is
also sent to the range before. That is the only shuffle of text.

Order: null doc_id first, by a hash of the text, in ranges of that hash; then
ascending, equal ids by the hash too; the last document's next is the first. Nulls and odd input: a null text counts as
empty; an empty text, or one without words, has the fingerprint of all zeros,
like only to another such; a document that is alone is its own next; an empty
table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revq.llm.common import in_tasks, tidy, written
from revq.llm.words import BLOCK, U64, blocks, mix, owners, word_hashes

SAMPLES = 64
SLAB = 1 << 14
OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


@lru_cache(maxsize=1)
def _gamma() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1) at 65536 even steps, and their logarithms."""
    u = (np.arange(65536) + 0.5) / 65536
    x = np.sqrt(2 * u) + u  # near the small quantiles; Newton steps do the rest
    for _ in range(60):
        x = np.maximum(x - (1 - np.exp(-x) * (1 + x) - u) / np.maximum(x * np.exp(-x), 1e-12) * 0.8, 1e-6)
    return x.astype(np.float32), np.log(x).astype(np.float32)


@lru_cache(maxsize=1)
def _places() -> np.ndarray:
    return mix(np.arange(1, SAMPLES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def _draws(term: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """(terms x SAMPLES): ln a in order-preserving bits above, 32 bits of the sample (term, t) below."""
    gamma, log_gamma = _gamma()
    z = mix(term[:, None] + _places()[None])
    r = gamma[(z & U64(0xFFFF)).astype(np.int64)]
    log_c = log_gamma[((z >> U64(16)) & U64(0xFFFF)).astype(np.int64)]
    beta = (z >> U64(32)).astype(np.float32) * np.float32(2.0**-32)
    t = np.floor(np.log(weight.astype(np.float32))[:, None] / r + beta)
    log_a = log_c - r * (t - beta) - r
    bits = log_a.view(np.uint32)
    bits = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(U64)
    name = mix(z + t.astype(np.int64).view(U64) * U64(0xD6E8FEB86659FD93)) >> U64(32)
    return (bits << U64(32)) | name


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """(texts x SAMPLES) uint16 samples; a text without words has zeros."""
    out = np.zeros((len(texts), SAMPLES), np.uint16)
    for first, end in blocks(texts, BLOCK // 4):
        h, bounds = word_hashes(texts[first:end], lower=True)
        if not len(h):
            continue
        own = owners(bounds)
        order = np.lexsort((h, own))
        h, own = h[order], own[order]
        at = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])))
        count = np.diff(np.append(at, len(h)))
        h, own = h[at], own[at]
        best = np.full((end - first, SAMPLES), np.iinfo(U64).max, U64)
        for a in range(0, len(h), SLAB):
            hs, cs, os = h[a : a + SLAB], count[a : a + SLAB], own[a : a + SLAB]
            pair, back = _pairs(hs, cs)
            drawn = _draws(pair[0], pair[1])
            heads = np.flatnonzero(np.append(True, os[1:] != os[:-1]))
            low = np.minimum.reduceat(drawn[back], heads, axis=0)
            best[os[heads]] = np.minimum(best[os[heads]], low)
        some = np.diff(bounds) > 0
        got = (best[some] & U64(0xFFFF)).astype(np.uint16)
        out[first:end][some] = np.where(got == 0, np.uint16(1), got)
    return out


def _pairs(term: np.ndarray, count: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Distinct (term, count) and the index of each row's pair."""
    order = np.lexsort((count, term))
    t, c = term[order], count[order]
    new = np.append(True, (t[1:] != t[:-1]) | (c[1:] != c[:-1]))
    back = np.empty(len(term), np.int64)
    back[order] = np.cumsum(new) - 1
    return (t[new], c[new]), back


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range and order; a row marked ``copy`` closes its range and is not put out."""
    pending: tuple | None = None  # the row that waits for its next
    ready: list[tuple] = []
    size = 0
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("rng", "copy", "doc_id", "text")]
        for rng, copy, doc_id, text in zip(*cols, strict=True):
            text = text or ""
            if pending is not None and pending[0] == rng:
                ready.append((pending[1], pending[2], text))
                size += len(pending[2])
            pending = None if copy else (rng, doc_id, text)
            if size > BLOCK:
                yield _compare(ready)
                ready, size = [], 0
    if ready:
        yield _compare(ready)


def _compare(rows: list[tuple]) -> pa.RecordBatch:
    own = [text for _, text, _ in rows]
    quarter = [len(t) // 4 for t in own]
    edited = [(t[: len(t) - q] + nxt[:q]).encode() for (_, t, nxt), q in zip(rows, quarter, strict=True)]
    raw = [t.encode() for t in own]
    # consecutive rows share a text: only a next that is not the following row is computed apart
    apart = [i for i, (_, _, nxt) in enumerate(rows) if i + 1 >= len(rows) or rows[i + 1][1] is not nxt]
    # a text and its edited text side by side: the terms they share are drawn once
    both = fingerprints([t for pair in zip(raw, edited, strict=True) for t in pair])
    prints, changed = both[0::2], both[1::2]
    other = dict(zip(apart, fingerprints([rows[i][2].encode() for i in apart]), strict=True))
    nexts = [other[i] if i in other else prints[i + 1] for i in range(len(rows))]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([i for i, _, _ in rows], pa.int64()), pa.array([len(t) for t in own], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
            pa.array([p.astype(">u2").tobytes().hex() for p in prints]), pa.array([p.astype(">u2").tobytes().hex() for p in changed]),
            pa.array([likeness(a, b) for a, b in zip(prints, changed, strict=True)]),
            pa.array([likeness(a, b) for a, b in zip(prints, nexts, strict=True)]),
        ],
        names=[x.split()[0] for x in OUT.split(", ")],
    )


@tidy
def fingerprint(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited text, and how near it is to that and to the next document."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n_ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * 4)
    cuts = sorted(set(docs.select("doc_id").approxQuantile("doc_id", [i / n_ranges for i in range(1, n_ranges)], 0.5 / n_ranges)))
    rows = rows.withColumn("_id", F.col("doc_id").cast("double")).withColumn("rng", F.lit(0))
    if cuts:
        split = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_id", outputCol="rng", handleInvalid="keep")
        rows = split.transform(rows.drop("rng"))
    # rows without an id come first, in the order of their texts' hashes: ranges of these
    bits = max(1, n_ranges.bit_length())
    nameless = F.shiftright(F.xxhash64("text"), 64 - bits).cast("int") - (1 << (bits - 1))
    rng = F.when(F.col("doc_id").isNull(), nameless).otherwise(F.col("rng").cast("int"))
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("x"))
    rows = rows.select("doc_id", "text", rng.alias("rng"))
    heads = rows.groupBy("rng").agg(F.min(order).alias("first"))
    back = F.lag("rng").over(Window.orderBy("rng"))
    heads = heads.withColumn("back", back)  # a row per range
    end = heads.agg(F.max("rng")).first()[0]
    heads = written(heads.withColumn("back", F.coalesce("back", F.lit(end))).select(F.col("rng").alias("_rng"), "first", "back"), "heads")
    dealt = rows.withColumn("ord", order)
    first = dealt.join(F.broadcast(heads), (F.col("rng") == F.col("_rng")) & (F.col("ord") == F.col("first")))  # a row per range
    first = first.dropDuplicates(["_rng"]).select(F.col("back").alias("rng"), F.lit(True).alias("copy"), "ord", "doc_id", "text")
    both = dealt.select("rng", F.lit(False).alias("copy"), "ord", "doc_id", "text").unionByName(first)
    placed = both.repartition("rng").sortWithinPartitions("rng", "copy", "ord")
    return placed.select("rng", "copy", "doc_id", "text").transform(in_tasks, _neighbours, OUT)
