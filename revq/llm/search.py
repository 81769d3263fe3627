"""Ranked lexical search over a length-stratified index.

A document's normaliser m depends on its length alone, so documents of equal m
form a stratum, and in a stratum a term's part of the score depends on its
frequency tf alone. Postings are kept by (term, stratum, tf) and the impact
``(1000000000 tf) div (1000 tf + 20 m)`` is computed once for each such group,
not for each posting. The largest tf of a term in a stratum bounds its part
there; an item's strata are visited by falling bound and the visit ends where
the bound is strictly below the score of the last place held.

Scale: texts are read once (``forward``): each document leaves its length and
the items' terms it holds, a narrow written table. N, L and df are aggregates
of that table. Then every task builds the strata of its own rows, ``CHUNK``
documents at a time, and keeps the best ``k`` per item: postings are never
shuffled, and a stratum that holds a third of all documents lies in as many
tasks as its rows do. A first search of one document in ``SAMPLE`` gives each
item a score that its last place surely has (a valid bound, nothing is lost),
so that later tasks skip most strata and send few rows to the final cut.
Items go in blocks of bounded size; only a block's terms, their counts and its
bounds reach the driver.

Nulls and odd input: null texts and texts without a term count neither for N
nor as results; an item without terms, or none of whose terms occurs, has no
rows; equal items rank each for itself; a null doc_id comes after all others
of its score; rows that repeat a document are ranked one by one; an empty
table gives an empty one; long texts are read in slices; other columns are
not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revq.llm.common import in_tasks, list_column, texts_of, tidy, written

K = 50  # results an item
BLOCK_ITEMS, BLOCK_TERMS = 4096, 1 << 18  # items searched together, and their terms
CHUNK = 1 << 16  # documents whose strata are built together
SAMPLE = 16  # one document in so many gives the first bounds
SLICE = 1 << 20  # bytes of a text split at once
SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])  # fixed
LOWER = bytes(0x20 if b in SEPARATORS else b + 32 if 65 <= b < 91 else b for b in range(256))
CUT = re.compile(b"[" + re.escape(SEPARATORS) + b"]")


def terms(text: bytes) -> Iterator[list[bytes]]:
    """All terms of a text in order, a list a slice."""
    at = 0
    while at < len(text):
        cut = CUT.search(text, at + SLICE) if len(text) - at > SLICE else None
        to = cut.start() if cut else len(text)
        yield text[at:to].translate(LOWER).split()
        at = to


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted({t for part in terms(text) for t in part}) for text in texts_of(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("item_id"), pa.array(found, pa.list_(pa.binary()))], names=["row", "item_id", "terms"]
        )


def _forward(place: dict[bytes, int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, bounds = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows + 1, np.int64)
            held, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, text in enumerate(texts_of(batch.column("text"))):
                total = np.zeros(0, np.int64), np.zeros(0, np.int64)
                for words in terms(text):
                    n[i] += len(words)
                    hits = [x for x in map(place.get, words) if x is not None]
                    if hits:
                        t, c = np.unique(np.array(hits, np.int64), return_counts=True)
                        if len(total[0]):  # a long text comes in slices
                            t, own = np.unique(np.concatenate([total[0], t]), return_inverse=True)
                            c = np.bincount(own, np.concatenate([total[1], c])).astype(np.int64)
                        total = t, c
                held.append(total[0])
                times.append(total[1])
                bounds[i + 1] = bounds[i] + len(total[0])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), list_column(np.concatenate(held), bounds, pa.int64()), list_column(np.concatenate(times), bounds, pa.int64())],
                names=["doc_id", "n", "terms", "tfs"],
            )

    return run


def forward(docs: DataFrame, place: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): length of each text, and which of the given terms it holds how often."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(in_tasks, _forward(place), "doc_id long, n long, terms array<long>, tfs array<long>"
    )


class Strata:
    """Documents of equal normaliser, their postings grouped by (term, stratum, tf)."""

    def __init__(self, m: np.ndarray, term: np.ndarray, tf: np.ndarray, doc: np.ndarray, n_terms: int):
        levels, stratum = np.unique(m, return_inverse=True)
        order = np.lexsort((tf, stratum[doc], term))
        term, tf, self.doc = term[order], tf[order], doc[order]
        stratum = stratum[self.doc]
        new = np.ones(len(term), bool)  # a (term, stratum, tf) begins
        new[1:] = (term[1:] != term[:-1]) | (stratum[1:] != stratum[:-1]) | (tf[1:] != tf[:-1])
        group = np.flatnonzero(new)
        once = 1_000_000_000 * tf[group] // (1000 * tf[group] + 20 * levels[stratum[group]])
        self.impact = np.repeat(once, np.diff(np.append(group, len(term))))
        pair = np.ones(len(term), bool)  # a (term, stratum) begins
        pair[1:] = (term[1:] != term[:-1]) | (stratum[1:] != stratum[:-1])
        self.first = np.flatnonzero(pair)
        self.last = np.append(self.first[1:], len(term))
        self.level = stratum[self.first]
        self.top = self.impact[self.last - 1] if len(term) else np.zeros(0, np.int64)  # impact grows with tf
        self.pairs = np.searchsorted(term[self.first], np.arange(n_terms + 1))
        self.n_levels, self.score = len(levels), np.zeros(len(m), np.int64)

    def search(self, of: np.ndarray, weight: np.ndarray, better: Callable[[np.ndarray, np.ndarray], int], least: int) -> None:
        """Visit strata by falling bound; ``better(docs, scores)`` takes results and gives the least score that still counts."""
        at = [np.arange(self.pairs[t], self.pairs[t + 1]) for t in of]
        w = np.repeat(weight, [len(a) for a in at])
        at = np.concatenate(at) if at else np.zeros(0, np.int64)
        if not len(at):
            return
        bound = np.zeros(self.n_levels, np.int64)
        np.add.at(bound, self.level[at], w * self.top[at])
        order = np.argsort(-bound, kind="stable")
        turn = np.empty(self.n_levels, np.int64)
        turn[order] = np.arange(self.n_levels)
        of_turn = turn[self.level[at]]
        done, step = 0, 1
        while done < self.n_levels:
            open_ = int(np.searchsorted(-bound[order], -max(least, 1), "right"))  # strata whose bound is not below
            to = min(done + step, open_)
            if to <= done:
                return
            now = (of_turn >= done) & (of_turn < to)
            first, size = self.first[at[now]], (self.last - self.first)[at[now]]
            place = np.repeat(first - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
            doc = self.doc[place]
            np.add.at(self.score, doc, np.repeat(w[now], size) * self.impact[place])
            doc = np.unique(doc)
            got = self.score[doc]
            self.score[doc] = 0
            keep = got >= max(least, 1)
            if keep.any():
                least = max(least, better(doc[keep], got[keep]))
            done, step = to, step * 4


def normaliser(n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """m of each length; whole numbers also where the product needs more than 64 bits."""
    if not len(n) or 50 * int(n.max()) * n_docs < 1 << 62:
        return 50 + 50 * n * n_docs // total
    return np.array([50 + 50 * int(x) * n_docs // total for x in n], np.int64)


def _searcher(item_ids: list, item_terms: list[np.ndarray], weight: np.ndarray, floors: list[int], n_docs: int, total: int, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        best = [(none, none, none)] * len(item_terms)  # score, doc_id, whether it is null

        def chunk(held: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            ids = rows.column("doc_id").combine_chunks()
            null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            ids = ids.fill_null(0).to_numpy()
            lists, times = rows.column("terms").combine_chunks(), rows.column("tfs").combine_chunks()
            size = lists.value_lengths().to_numpy()
            strata = Strata(
                normaliser(rows.column("n").to_numpy(), n_docs, total), lists.flatten().to_numpy(), times.flatten().to_numpy(),
                np.repeat(np.arange(len(size)), size), len(weight),
            )
            for i, of in enumerate(item_terms):

                def better(doc: np.ndarray, score: np.ndarray, i: int = i) -> int:
                    s, d, x = (np.concatenate(p) for p in zip(best[i], (score, ids[doc], null[doc]), strict=True))
                    first = np.lexsort((d, x, -s))[:k]
                    best[i] = s[first], d[first], x[first]
                    return int(best[i][0][-1]) if len(first) == k else 0

                held_least = int(best[i][0][-1]) if len(best[i][0]) == k else 0
                strata.search(of, weight[of], better, max(held_least, floors[i]))

        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                if held and sum(b.num_rows for b in held) + part.num_rows > CHUNK:
                    chunk(held)
                    held = []
                held.append(part)
        if held:
            chunk(held)
        for i, (score, doc, null) in enumerate(best):
            if len(score):
                n = len(score)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * n, pa.int64()), pa.array([item_ids[i]] * n, pa.int64()), pa.array(doc, mask=null.astype(bool)), pa.array(score)],
                    names=["item", "item_id", "doc_id", "score"],
                )

    return run


def _block(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Results of one block of items: its terms are few enough to be sent to every task."""
    asked = items.select("item_id", "terms").collect()
    words = sorted({bytes(t) for r in asked for t in r["terms"]})
    place = {t: i for i, t in enumerate(words)}
    item_ids = [r["item_id"] for r in asked]
    item_terms = [np.array([place[bytes(t)] for t in r["terms"]], np.int64) for r in asked]
    rows = written(forward(docs, place).filter("n > 0"), "forward")
    n_docs, total = rows.agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(words), np.int64)
    for t, n in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row a term of the block
        df[t] = n
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    schema = "item long, item_id long, doc_id long, score long"

    def search(part: DataFrame, floors: list[int]) -> DataFrame:
        found = part.select("doc_id", "n", "terms", "tfs").transform(in_tasks, _searcher(item_ids, item_terms, weight, floors, n_docs, total, k), schema)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    floors = [0] * len(asked)
    few = search(rows.filter(F.pmod(F.xxhash64("doc_id", "n"), F.lit(SAMPLE)) == 0), floors)
    for item, score in few.filter(F.col("rank") == k).select("item", "score").collect():  # a row an item of the block
        floors[item] = score
    return search(rows, floors).select("item_id", "rank", "doc_id", "score")


@tidy
def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item."""
    asked = items.select(F.monotonically_increasing_id().alias("row"), F.col("item_id").cast("long").alias("item_id"), "text")
    asked = written(asked.transform(in_tasks, _item_terms, "row long, item_id long, terms array<binary>"), "items")
    asked = asked.filter(F.size("terms") > 0)
    n, n_terms = asked.agg(F.count("row"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-n_terms // BLOCK_TERMS))
    out = None
    for b in range(blocks):
        part = _block(docs, asked.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b), k)
        out = part if out is None else out.unionByName(part)
    return out
