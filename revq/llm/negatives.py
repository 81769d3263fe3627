"""Hard negatives by score windows, found in STR-packed R-trees.

An anchor's positives are its nearest other rows of its label; for each
positive, the negatives are the nearest rows of other labels whose score lies
in a window around a share of the positive's score. Rows are packed into
R-trees by sort-tile-recursive order: by label, then in slabs along the
coordinates of widest spread. A box gives the interval of a coordinate, and
so the interval of the inner product with an anchor. Boxes outside every
window, or strictly below the kth score held, are left out, level by level;
the leaves that remain are read best bound first, in batches that grow, until
the next bound is strictly below the kth.

Scale: rows are read once into a narrow written table of whole numbers. Each
task packs trees over its own rows, ``CHUNK`` at a time, and keeps the best
few per anchor and window, so what is shuffled is k rows an anchor and task,
never a pair. Anchors go in blocks of bounded size: a block's vectors, and
then its positives, are all that reaches the driver. A label or vector that a
third of all rows share lies in as many tasks as its rows do.

Nulls and odd input: rows with a null label, a null vector, or a null or
non-finite component take no part; a null vec_id is no anchor and comes after
all others of its score; rows that repeat an id are rows of their own (each an
anchor, if the id is one); vectors of unequal length are filled up with zeros;
an anchor without positives, or a window without rows, has no result; an empty
table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revq.llm.common import in_tasks, tidy, written

EVERY, RELABEL, LABELS = 100, 7, 10  # fixed: which rows are anchors, which labels move, how many labels
SCALE = 256  # fixed
POSITIVES, NEGATIVES = 5, 10  # fixed
LOW, HIGH = 30, 90  # fixed: window, hundredths of the positive's score
BLOCK = 2048  # anchors searched together
CHUNK, LEAF, FAN, DEEP = 1 << 15, 64, 16, 3  # rows of a tree, of a leaf; children of a box; coordinates tiled
HELD = 1 << 21  # results held before they are cut to the best


def vectors(embeddings: DataFrame) -> DataFrame:
    """(row, vec_id, label, x): rows that take part, labels moved, components as whole numbers."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % RELABEL == 0, (label + 1) % LABELS).otherwise(label)
    return (
        embeddings.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
        .filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
        .select("row", "vec_id", moved.alias("label"), F.transform("embedding", lambda v: F.floor(v.cast("double") * SCALE).cast("long")).alias("x"))
    )


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of whole numbers, filled up with zeros to the widest."""
    size, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
    out = np.zeros((len(size), max([width, *size.tolist()])), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out


class Tree:
    """Boxes over rows in sort-tile-recursive order; a leaf holds rows of one label."""

    def __init__(self, x: np.ndarray, label: np.ndarray):
        wide = np.argsort(-(x.max(0) - x.min(0)), kind="stable")[:DEEP]
        self.order, leaves = [], []
        for v in np.unique(label):
            for leaf in self._tiles(x, np.flatnonzero(label == v), list(wide)):
                leaves.append((len(leaf), v))
                self.order.append(leaf)
        self.order = np.concatenate(self.order)
        self.x = x[self.order]
        ends = np.cumsum([n for n, _ in leaves])
        starts = np.append(0, ends[:-1])
        self.leaf = list(zip(starts.tolist(), ends.tolist(), strict=True))
        self.label = np.array([v for _, v in leaves])
        self.levels = [(np.minimum.reduceat(self.x, starts), np.maximum.reduceat(self.x, starts))]
        while len(self.levels[-1][0]) > FAN:
            at = np.arange(0, len(self.levels[-1][0]), FAN)
            self.levels.append((np.minimum.reduceat(self.levels[-1][0], at), np.maximum.reduceat(self.levels[-1][1], at)))

    def _tiles(self, x: np.ndarray, rows: np.ndarray, axes: list[int]) -> Iterator[np.ndarray]:
        pages = -(-len(rows) // LEAF)
        if not axes or pages == 1:
            yield from (rows[at : at + LEAF] for at in range(0, len(rows), LEAF))
            return
        rows = rows[np.argsort(x[rows, axes[0]], kind="stable")]
        slabs = int(np.ceil(pages ** (1 / len(axes))))
        size = -(-pages // slabs) * LEAF
        for at in range(0, len(rows), size):
            yield from self._tiles(x, rows[at : at + size], axes[1:])

    def bounds(self, a: np.ndarray, useful: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """Upper bound of each anchor in each leaf; the lowest number where a box on the way is not useful."""
        up, down = np.maximum(a, 0), np.minimum(a, 0)
        least = np.iinfo(np.int64).min if a.dtype == np.int64 else -np.inf
        upper = np.full((len(a), len(self.leaf)), least, a.dtype)
        level = len(self.levels) - 1
        todo = [(np.arange(len(a)), 0, len(self.levels[-1][0]))]
        while todo:
            below = []
            lo, hi = self.levels[level]
            for who, first, last in todo:
                most = up[who] @ hi[first:last].T + down[who] @ lo[first:last].T
                fewest = up[who] @ lo[first:last].T + down[who] @ hi[first:last].T
                ok = useful(who, fewest, most)
                if not level:
                    upper[who[:, None], np.arange(first, last)] = np.where(ok, most, least)
                    continue
                for node in np.flatnonzero(ok.any(0)):
                    child = (first + int(node)) * FAN
                    below.append((who[ok[:, node]], child, min(child + FAN, len(self.levels[level - 1][0]))))
            todo, level = below, level - 1
        return upper


class Best:
    """The k best rows of every (anchor, window), by score, then smaller id, nulls last."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.kth = low.copy()  # what a score must reach to count
        self.rows = np.zeros((4, 0), np.int64)  # slot, score, id, whether it is null
        self.new: list[np.ndarray] = []
        self.n_new = 0

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        self.new.append(np.stack([slot, score.astype(np.int64), ids, null]))
        self.n_new += len(slot)
        if self.n_new > HELD:
            self.cut()

    def cut(self) -> None:
        if not self.n_new:
            return
        slot, score, ids, null = np.concatenate([self.rows, *self.new], axis=1)
        order = np.lexsort((ids, null, -score, slot))
        slot = slot[order]
        begin = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        place = np.arange(len(slot)) - np.repeat(begin, np.diff(np.append(begin, len(slot))))
        keep = order[place < self.k]
        self.rows = np.stack([slot[place < self.k], score[keep], ids[keep], null[keep]])
        full = place == self.k - 1
        np.maximum.at(self.kth.reshape(-1), slot[full], score[order][full])
        self.new, self.n_new = [], 0


def _visit(tree: Tree, a: np.ndarray, label: np.ndarray, same: bool, own: np.ndarray, rows: tuple, best: Best) -> None:
    """Read the leaves of ``tree`` that may hold results, each anchor's best bound first."""
    row, ids, null = (c[tree.order] for c in rows)
    windows = best.low.shape[1]

    def useful(who: np.ndarray, fewest: np.ndarray, most: np.ndarray) -> np.ndarray:
        ok = np.zeros(most.shape, bool)
        for j in range(windows):
            ok |= (most >= best.kth[who, j, None]) & (fewest <= best.high[who, j, None])
        return ok

    upper = tree.bounds(a, useful)
    least = upper.dtype.type(np.iinfo(np.int64).min) if upper.dtype == np.int64 else -np.inf
    upper[(label[:, None] == tree.label) != same] = least
    order = np.argsort(-upper if upper.dtype != np.int64 else ~upper, axis=1, kind="stable")
    done, step = 0, 1
    while done < order.shape[1]:
        leaf = order[:, done : done + step]
        bound = np.take_along_axis(upper, leaf, 1)
        ok = (bound > least) & (bound >= best.kth.min(1)[:, None])
        who, place = np.nonzero(ok)
        if not len(who):
            return
        leaf = leaf[who, place]
        by = np.argsort(leaf, kind="stable")
        who, leaf = who[by], leaf[by]
        for at, to in zip(first := np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1])), np.append(first[1:], len(leaf)), strict=True):
            some, (begin, end) = who[at:to], tree.leaf[leaf[at]]
            score = a[some] @ tree.x[begin:end].T
            other = own[some, None] != row[begin:end]
            for j in range(windows):
                i, r = np.nonzero((score >= best.kth[some, j, None]) & (score <= best.high[some, j, None]) & other)
                if len(i):
                    best.add(some[i] * windows + j, score[i, r], ids[begin + r], null[begin + r])
        best.cut()
        done, step = done + step, step * 4


def _searcher(x: np.ndarray, label: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(low, high, k)

        def chunk(held: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            their = _matrix(rows.column("x").combine_chunks(), x.shape[1])
            a = np.pad(x, ((0, 0), (0, their.shape[1] - x.shape[1])))
            exact = float(np.abs(a).max(initial=0)) * float(np.abs(their).max(initial=0)) * a.shape[1] < 2**52
            if exact:  # products and sums are whole numbers that doubles hold
                a, their = a.astype(np.float64), their.astype(np.float64)
            ids = rows.column("vec_id").combine_chunks()
            null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            of = rows.column("row").to_numpy(), ids.fill_null(0).to_numpy(), null
            _visit(Tree(their, rows.column("label").to_numpy()), a, label, same, own, of, best)

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
        slot, score, ids, null = best.rows
        if len(slot):
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.array(ids, mask=null.astype(bool)), pa.array(score)], names=["slot", "vec_id", "score"]
            )

    return run


def _best(rows: DataFrame, run: Callable, k: int) -> DataFrame:
    """(slot, vec_id, score, rank): the tasks' results cut to the k best of each slot."""
    found = rows.select("row", "vec_id", "label", "x").transform(in_tasks, run, "slot long, vec_id long, score long")
    order = Window.partitionBy("slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _block(rows: DataFrame, anchors: DataFrame) -> DataFrame | None:
    """Results of one block of anchors."""
    asked = anchors.select("row", "vec_id", "label", "x").toArrow()
    n = asked.num_rows
    if not n:
        return None
    x = _matrix(asked.column("x").combine_chunks(), 0)
    label, own, anchor_id = (asked.column(c).to_numpy() for c in ("label", "row", "vec_id"))
    most = np.iinfo(np.int64).max
    every = np.full((n, 1), -most), np.full((n, 1), most)
    near = written(_best(rows, _searcher(x, label, own, *every, True, POSITIVES), POSITIVES), "positives")
    low, high = np.full((n, POSITIVES), most), np.full((n, POSITIVES), -most)
    for r in near.collect():  # POSITIVES rows an anchor of the block
        low[r["slot"], r["rank"] - 1] = -(-LOW * r["score"] // 100)
        high[r["slot"], r["rank"] - 1] = HIGH * r["score"] // 100
    # a window that holds nothing has a floor above its ceiling, so no score counts
    found = _best(rows, _searcher(x, label, own, low, high, False, NEGATIVES), NEGATIVES)
    found = found.select(
        F.expr(f"slot div {POSITIVES}").alias("a"), (F.col("slot") % POSITIVES + 1).cast("int").alias("p"), "rank",
        F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"),
    )
    pairs = near.select(F.col("slot").alias("a"), F.col("rank").alias("p"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = rows.sparkSession.createDataFrame(list(enumerate(anchor_id.tolist())), "a long, anchor_id long")
    return found.join(pairs, ["a", "p"]).join(ids, "a").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def is_anchor() -> Column:
    return F.coalesce(F.col("vec_id") % EVERY == 0, F.lit(False))


@tidy
def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor."""
    rows = written(vectors(embeddings), "vectors")
    anchors = rows.filter(is_anchor())
    blocks = max(1, -(-anchors.count() // BLOCK))
    parts = [_block(rows, anchors.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b)) for b in range(blocks)]
    made = [p for p in parts if p is not None]
    if not made:
        schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return embeddings.sparkSession.createDataFrame([], schema)
    out = made[0]
    for p in made[1:]:
        out = out.unionByName(p)
    return out
