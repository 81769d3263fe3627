"""Language identification with hyperdimensional letter profiles.

Every letter symbol has a random vector of +1/-1 of ``DIM`` places. A trigram
abc is bound into rot(rot(A)) * rot(B) * C, where rot turns a vector by one
place; a text's vector is the bundle (sum) of the vectors of all its trigrams.
A language's prototype bundles the trigrams of all its training documents,
less the mean of the languages' unit bundles (what they share says nothing).
A text gets the language whose prototype has the largest cosine with it.

Training counts trigrams per language over all training rows, with partial
sums before the shuffle; the counts have at most SYMBOLS^3 rows a language,
whatever the corpus size, and only they reach the driver. Prediction is one
scan without shuffle; the whole text is read, in bounded pieces.

Nulls and odd input: a null or empty text, or one without a letter, gets
``und`` with score 0; rows with null lang or text teach nothing; ties go to the
language that sorts first; without any training row every text gets ``und``.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revq.llm.common import in_tasks

SYMBOLS, DIM, SEED = 48, 512, 7
PIECE = 1 << 20
# a text stays identified if its score reaches MARGIN times the LOW quantile of the rows of its length class (of
# those with CLASS_ROWS rows at least), and MIN_SCORE; and if most of its letters were met in training
MIN_SCORE, MARGIN, LOW, CLASS_ROWS = 0.02, 0.4, 0.05, 50


@lru_cache(maxsize=1)
def _symbol_table() -> np.ndarray:
    """Symbol of each code point: 0 no letter, 1-26 a-z, then the other letters by remainder."""
    t = np.zeros(sys.maxunicode + 1, np.uint8)
    for cp in range(sys.maxunicode + 1):
        ch = chr(cp)
        if ch.isalpha():
            low = ord(ch.lower()[0])
            t[cp] = low - 96 if 97 <= low <= 122 else 27 + low % (SYMBOLS - 27)
    return t


@lru_cache(maxsize=1)
def trigram_vectors() -> np.ndarray:
    """(SYMBOLS^3, DIM) int8: the bound vector of each trigram."""
    letter = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIM))
    a, b = np.roll(letter, 2, axis=1), np.roll(letter, 1, axis=1)
    pair = (a[:, None] * b[None]).reshape(-1, 1, DIM)
    return (pair * letter[None]).reshape(-1, DIM)


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of a text and their counts; runs of non-letters count as one blank."""
    table, parts = _symbol_table(), []
    tail = np.zeros(1, np.uint8)
    for at in range(0, len(text or ""), PIECE):
        raw = np.frombuffer(text[at : at + PIECE].encode("utf-32-le"), np.uint32)
        s = np.concatenate([tail, table[raw]])
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] > 0) | (s[:-1] > 0)
        s = s[keep]
        if at + PIECE >= len(text) and s[-1]:
            s = np.append(s, np.uint8(0))
        if len(s) >= 3:
            g = (s[:-2].astype(np.int32) * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
            g = g[s[1:-1] > 0]
            parts.append(np.unique(g, return_counts=True))
        tail = s[-2:]
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    if len(parts) == 1:
        return parts[0]
    total = np.bincount(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    g = np.flatnonzero(total)
    return g.astype(np.int32), total[g].astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition: trigram counts of each language, and counts of letters (g under 0), held in arrays of fixed size."""
    sums: dict[str, np.ndarray] = {}
    seen = np.zeros(sys.maxunicode + 1, np.int64)
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            g, n = trigrams(text)
            if lang not in sums:
                sums[lang] = np.zeros(SYMBOLS**3, np.int64)
            sums[lang][g] += n
            for at in range(0, len(text), PIECE):
                cp = np.bincount(np.frombuffer(text[at : at + PIECE].encode("utf-32-le"), np.uint32))
                seen[: len(cp)] += cp
    letters = np.flatnonzero(seen * (_symbol_table() > 0))
    for lang, g, n in [*((lang, np.flatnonzero(t), t[t > 0]) for lang, t in sums.items()), (None, -1 - letters, seen[letters])]:
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(g), pa.string()), pa.array(g, pa.int32()), pa.array(n, pa.int64())], names=["lang", "g", "n"]
        )


def learn(docs: DataFrame, training: Column) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, prototypes, which code points are known letters) from the rows where ``training`` holds."""
    rows = docs.filter(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    made = rows.transform(in_tasks, _count, "lang string, g int, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    found = made.toPandas()
    letters, found = found[found["g"] < 0], found[found["g"] >= 0]
    known = np.zeros(sys.maxunicode + 1, bool)
    # a letter that is one in a hundred thousand, or rarer, is a stray one
    known[-1 - letters["g"][letters["n"] * 100_000 > letters["n"].sum()].to_numpy(np.int64)] = True
    langs = sorted(found["lang"].unique())
    proto = np.zeros((len(langs), DIM))
    for i, lang in enumerate(langs):
        own = found[found["lang"] == lang]
        proto[i] = own["n"].to_numpy(np.float64) @ trigram_vectors()[own["g"].to_numpy()].astype(np.float64)
    proto /= np.maximum(np.linalg.norm(proto, axis=1, keepdims=True), 1e-12)
    if len(langs) > 1:
        proto = proto - proto.mean(axis=0)
        proto /= np.maximum(np.linalg.norm(proto, axis=1, keepdims=True), 1e-12)
    return langs, np.round(proto, 9), known


def fit(docs: DataFrame, training: Column) -> tuple[list[str], np.ndarray]:
    """(languages, prototypes) from the rows where ``training`` holds."""
    return learn(docs, training)[:2]


def classify(texts: list[str | None], langs: list[str], proto: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    vectors, pred, score = trigram_vectors(), [], np.zeros(len(texts))
    proto32 = proto.astype(np.float32).T
    for i, text in enumerate(texts):
        g, n = trigrams(text)
        if not len(g) or not langs:
            pred.append("und")
            continue
        bundle = n.astype(np.float32) @ vectors[g].astype(np.float32)
        cos = (bundle @ proto32) / max(float(np.linalg.norm(bundle)), 1e-9)
        best = int(cos.argmax())
        pred.append(langs[best])
        score[i] = min(1.0, max(0.0, float(cos[best])))
    return pred, score


def length_class(n: np.ndarray) -> np.ndarray:
    """Texts of alike length: whole part of the binary logarithm of the number of trigrams."""
    return np.frexp(np.maximum(n, 1).astype(np.float64))[1] - 1


def share_known(text: str | None, known: np.ndarray) -> float:
    """Share of a text's letters that are known ones; 0 without letters."""
    letters = met = 0
    for at in range(0, len(text or ""), PIECE):
        cp = np.frombuffer(text[at : at + PIECE].encode("utf-32-le"), np.uint32)
        letter = _symbol_table()[cp] > 0
        letters += int(letter.sum())
        met += int((letter & known[cp]).sum())
    return met / letters if letters else 0.0


def _predictor(langs: list[str], proto: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score = classify(batch.column("text").to_pylist(), langs, proto)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return run


def identify(docs: DataFrame, training: Column) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    langs, proto = fit(docs, training)
    return docs.select("doc_id", "text").transform(in_tasks, _predictor(langs, proto), "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, training: Column) -> DataFrame:
    """The rows whose language is told; columns as they came.

    A text goes if it has no letter, if most of its letters were not met in
    training, or if its score is far under what texts of its length reach: the
    limit of a length class is taken from a quantile sketch over all rows.
    Nothing is shuffled but the sketches; a row is judged where it is read.
    """
    langs, proto, known = learn(docs, training)

    def judged(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        texts = batch.column("text").to_pylist()
        _, got = classify(texts, langs, proto)
        got[np.array([share_known(t, known) for t in texts]) < 0.5] = -1
        return got, length_class(np.array([trigrams(t)[1].sum() for t in texts], np.int64))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got, cls = judged(batch)
            yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(cls.astype(np.int32))], names=["score", "cls"])
        trigram_vectors.cache_clear()  # a worker that goes on to other work holds no table

    told = docs.select("text").transform(in_tasks, scores, "score double, cls int").filter("score > 0")
    told = told.groupBy("cls").agg(F.count("score").alias("n"), F.kll_sketch_agg_double("score").alias("k")).filter(F.col("n") >= CLASS_ROWS)
    low = told.select("cls", F.kll_sketch_get_quantile_double("k", F.lit(LOW)))
    least = np.full(64, MIN_SCORE)
    for cls, q in low.collect():  # a row a length class: at most as many as a number has bits
        least[cls] = max(MIN_SCORE, MARGIN * q)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got, cls = judged(batch)
            yield batch.filter(pa.array(got >= least[cls]))
        trigram_vectors.cache_clear()

    return docs.transform(in_tasks, kept, docs.schema)
