"""Near-duplicate groups: SuperMinHash signatures, bands, verification, union-find.

1. One pass over the whole texts makes, per document, the number of distinct
   five-word shingles, a 64-bit hash of the whole shingle set, a SuperMinHash
   signature of 128 places and its 32 bands of four places. Documents with
   equal sets are one class from here on (exact copies cost nothing further).
2. Classes that meet in a band are compared by signature; those with at least
   ``ROUGH`` equal places form rough groups (a pair at similarity 0.75 misses
   all bands with probability 5e-6 and the rough test with 3e-6).
3. Only classes of rough groups have their full sets fetched. Inside a rough
   group the sets are compared exactly, and 100 * |A & B| >= 75 * |A | B|
   links two classes.
4. Union-find joins the links; a document's component is the smallest doc_id
   that it reaches.

Groups of any size: a group is dealt into blocks of bounded size. A block is
searched breadth-first, so only a spanning forest leaves it. Of a group of
several blocks, every class outside the group's largest component so far is
then held against all blocks, until none is left that was not (the classes
inside it need no further link), so no link between components is missed.
Where these would be more copies than the group has sets, a set goes only to
the blocks that hold one of its rarest shingles (``prefixes``), which is exact
as well: pages that share a template but hardly link stay where they are.

Nulls and odd input: a null or empty text, or one without words, has an empty
set and is linked with nothing. Rows that repeat a document fall into one
class. Rows without doc_id link like any others, but are never a group's name
unless the whole group has none, and then component_id is null. One doc_id
with several texts is judged text by text. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revq.llm.common import fresh, group_edges, in_tasks, list_column, runs, texts_of, tidy, with_row_key, written
from revq.llm.components import components
from revq.llm.words import U64, blocks, mix, owners, shingle_sets

PLACES, BANDS = 128, 32
ROUGH = 74
WIDTH, SHARE = 5, 75
GOLDEN = 0x9E3779B97F4A7C15


def superminhash(x: np.ndarray, own: np.ndarray, n: int, places: int = PLACES) -> np.ndarray:
    """Signatures (n x places) of n sets; x are element hashes, own their set.

    In round j an element offers the value j + r (r its j-th random number,
    kept as j << 32 | r) at the j-th entry of its own random permutation. An
    element stops once j exceeds the largest value of its set's signature, as
    it can then change nothing: large sets stop after two or three rounds.
    """
    sig = np.full((n, places), np.iinfo(U64).max, U64)
    flat = sig.reshape(-1)
    perm = None
    for j in range(places):
        z = mix(x + U64((j + 1) * GOLDEN % (1 << 64)))
        k = j + (((z & U64(0xFFFFFFFF)) * U64(places - j)) >> U64(32)).astype(np.int64)
        rows = np.arange(len(x))
        if perm is None:
            perm = np.tile(np.arange(places, dtype=np.uint8), (len(x), 1))
        place = perm[rows, k]
        perm[rows, k] = perm[rows, j]
        np.minimum.at(flat, own * places + place, (U64(j) << U64(32)) | (z >> U64(32)))
        goes_on = (sig.max(axis=1) >= U64((j + 1) << 32))[own]
        if not goes_on.all():
            x, own, perm = x[goes_on], own[goes_on], perm[goes_on]
        if not len(x):
            break
    return sig


def _set_hash(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each whole set, whatever the order of its elements."""
    total = np.zeros(len(x) + 1, U64)
    np.cumsum(mix(x ^ U64(0xD6E8FEB86659FD93)), out=total[1:])
    return mix((total[bounds[1:]] - total[bounds[:-1]]) + np.diff(bounds).astype(U64) * U64(GOLDEN))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    per = PLACES // BANDS
    seed = mix(np.arange(1, BANDS + 1, dtype=U64))
    for batch in batches:
        ids, rows, texts = batch.column("doc_id"), batch.column("row"), texts_of(batch.column("text"))
        for first, end in blocks(texts):
            x, bounds = shingle_sets(texts[first:end], WIDTH)
            n, size = end - first, np.diff(bounds)
            own = owners(bounds)
            h = _set_hash(x, bounds)
            some = np.flatnonzero(size)
            rank = np.zeros(n, np.int64)
            rank[some] = np.arange(len(some))
            sig = superminhash(x, rank[own], len(some))
            key = np.tile(seed, (len(some), 1))
            for i in range(per):
                key = mix(key + sig[:, i::per] * U64(GOLDEN))
            n_bands = np.where(size > 0, BANDS, 0)
            brief = np.full((n, PLACES), 0, np.uint8)
            brief[some] = (mix(sig) & U64(0xFF)).astype(np.uint8)
            brief_bytes = brief.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    rows.slice(first, n),
                    ids.slice(first, n),
                    pa.array(size, pa.int64()),
                    pa.array(h.view(np.int64), pa.int64()),
                    pa.array([brief_bytes[i * PLACES : (i + 1) * PLACES] for i in range(n)], pa.binary()),
                    list_column(key.reshape(-1).view(np.int64), np.append(0, np.cumsum(n_bands)), pa.int64()),
                ],
                names=["row", "doc_id", "n_shingles", "h", "brief", "bands"],
            )


def signatures(docs: DataFrame, row: str | None = None) -> DataFrame:
    """(row, doc_id, n_shingles, h, brief, bands) of every row; one scan, no shuffle."""
    key = F.lit(None) if row is None else F.col(row)
    return docs.select(key.cast("decimal(38,0)").alias("row"), "doc_id", "text").transform(in_tasks, _signatures, "row decimal(38,0), doc_id long, n_shingles long, h long, brief binary, bands array<long>"
    )


class Briefs:
    """Rough links: enough equal signature places (low bytes)."""

    def __init__(self, column: pa.ChunkedArray):
        self.sig = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, PLACES)

    def linked(self, i: int, others: np.ndarray) -> np.ndarray:
        return (self.sig[others] == self.sig[i]).sum(axis=1) >= ROUGH


class Sets:
    """Exact links: full shingle sets, through the posting lists of the block."""

    def __init__(self, column: pa.ChunkedArray):
        arr = column.combine_chunks()
        arr = arr.chunk(0) if isinstance(arr, pa.ChunkedArray) else arr
        self.bounds = arr.offsets.to_numpy().astype(np.int64) - arr.offsets[0].as_py()
        values = arr.flatten().to_numpy()
        self.size = np.diff(self.bounds)
        _, self.term = np.unique(values, return_inverse=True)
        own = np.repeat(np.arange(len(self.size)), self.size)
        order = np.argsort(self.term, kind="stable")
        self.post = own[order]
        self.at = np.searchsorted(self.term[order], np.arange((self.term.max() + 2) if len(self.term) else 1))

    def linked(self, i: int, others: np.ndarray) -> np.ndarray:
        t = self.term[self.bounds[i] : self.bounds[i + 1]]
        lo, n = self.at[t], self.at[t + 1] - self.at[t]
        where = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        both = np.bincount(self.post[where], minlength=len(self.size))[others]
        return (100 + SHARE) * both >= SHARE * (self.size[others] + self.size[i])


def _block_links(kind: Callable, name: str) -> Callable:
    """Per (grp, blk): a star for each component that the block's links make."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["grp", "blk"]):
            at = group_edges(t, ["grp", "blk"])
            h = t.column("h").to_numpy()
            payload = t.column(name)
            out: list[np.ndarray] = []
            for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if z - a < 2:
                    continue
                block, rest = kind(payload.slice(a, z - a)), np.arange(z - a)
                while len(rest) > 1:
                    first, rest, queue = rest[0], rest[1:], [rest[0]]
                    while queue and len(rest):
                        hit = block.linked(queue.pop(), rest)
                        if hit.any():
                            new = rest[hit]
                            out.append(np.stack([np.full(len(new), h[a + first]), h[a + new]]))
                            queue.extend(new.tolist())
                            rest = rest[~hit]
            both = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    return run


def _query_links(kind: Callable, name: str) -> Callable:
    """Per (grp, blk): links between the queries (q) and the block's members, one per component met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["grp", "blk"]):
            at = group_edges(t, ["grp", "blk"])
            h, label, q = (t.column(c).to_numpy(zero_copy_only=False) for c in ("h", "label", "q"))
            out: set[tuple[int, int]] = set()
            for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                asks, members = np.flatnonzero(q[a:z]), np.flatnonzero(~q[a:z])
                if not len(asks) or not len(members):
                    continue
                block = kind(t.column(name).slice(a, z - a))
                for i in asks.tolist():
                    met = np.unique(label[a + members[block.linked(i, members)]])
                    out.update((int(label[a + i]), int(x)) for x in met if x != label[a + i])
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"]
            )

    return run


def prefixes(big: DataFrame) -> DataFrame:
    """(grp, blk, h, s, short): per set the shingles one of which any linked set must hold too.

    A set's shingles are ordered by how few sets of the group hold them. Two
    sets at the wanted similarity have their first common shingle among the
    first quarter of the larger one and the first seventh of the smaller one
    (``short``), as what follows it must still hold the whole overlap.
    """
    x = big.select("grp", "blk", "h", F.size("items").alias("n"), F.explode("items").alias("s"))
    held = x.groupBy("grp", "s").agg(F.count("*").alias("c"))
    own = x.join(held, ["grp", "s"]).groupBy("grp", "blk", "h", "n").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("o"))
    quarter = F.expr(f"cast(n - ({SHARE}L * n + 99) div 100 + 1 as int)")
    seventh = F.expr(f"n - ({2 * SHARE}L * n + {99 + SHARE}) div {100 + SHARE} + 1")
    rows = own.select("grp", "blk", "h", seventh.alias("least"), F.posexplode(F.slice("o", F.lit(1), quarter)).alias("at", "e"))
    return rows.select("grp", "blk", "h", F.col("e.s").alias("s"), (F.col("at") < F.col("least")).alias("short"))


def routes(asks: DataFrame, held: DataFrame) -> DataFrame:
    """(grp, h, blk): the blocks that may hold a set linked with an asking one."""
    own = held.join(asks.select("grp", "h"), ["grp", "h"], "left_semi").select("grp", "h", "s", "short")
    there = held.select("grp", "s", "blk", "short").distinct()
    as_smaller = own.filter("short").drop("short").join(there.drop("short"), ["grp", "s"])
    as_larger = own.drop("short").join(there.filter("short").drop("short"), ["grp", "s"])
    return as_smaller.unionByName(as_larger).select("grp", "h", "blk").distinct()


def link_groups(members: DataFrame, payload: DataFrame, kind: Callable, name: str, limit: int) -> DataFrame:
    """Components within groups -> (node, label) of the linked nodes.

    ``members``: (grp, h, heft), each pair once; ``payload``: (h, ``name``).
    Links are sought between members of one group only; ``limit`` bounds the
    sum of heft in one block. Groups of one member are dropped before any
    payload is moved.
    """
    sizes = members.groupBy("grp").agg(F.count("*").alias("n"), F.sum("heft").alias("heft")).filter("n > 1")
    sizes = written(sizes.select("grp", F.ceil(F.col("heft") / F.lit(limit)).cast("int").alias("n_blk")), "sizes")
    dealt = members.join(sizes, "grp").select("grp", "n_blk", F.expr("cast(pmod(xxhash64(h, grp), n_blk) as int)").alias("blk"), "h")
    dealt = written(dealt, "dealt")
    placed = dealt.drop("n_blk").join(payload, "h").repartition("grp", "blk").sortWithinPartitions("grp", "blk")
    edges = written(placed.transform(in_tasks, _block_links(kind, name), "a long, b long"), "links")
    labels = written(components(edges), "labels")
    if sizes.filter("n_blk > 1").isEmpty():
        return labels
    big = written(dealt.filter("n_blk > 1").join(payload, "h"), "big")
    n_big, held, asked = big.count(), None, None
    while True:
        now = big.join(labels, F.col("h") == F.col("node"), "left").select(
            "grp", "n_blk", "blk", "h", name, F.coalesce("label", "h").alias("label")
        )
        now = written(now, "now")
        count = now.groupBy("grp", "label").agg(F.count("*").alias("c"))
        main = written(count.groupBy("grp").agg(F.max_by("label", F.struct("c", "label")).alias("main")), "main")
        asks = now.join(main, "grp")
        if asked is None:  # a few of the largest component's members ask as well
            asks = asks.filter("label != main or pmod(xxhash64(h, 7L), 8 * n_blk) = 0")
        else:
            asks = asks.filter("label != main").join(asked, ["grp", "h"], "left_anti")
        asks = written(asks.drop("main"), "asks")
        if asks.isEmpty():
            return labels
        if kind is Sets and asks.agg(F.sum("n_blk")).first()[0] > n_big:
            # more copies than sets: each goes only to blocks that may hold a link
            held = written(prefixes(big), "prefixes") if held is None else held
            spread = asks.drop("blk").join(written(routes(asks, held), "routes"), ["grp", "h"])
        else:
            spread = asks.withColumn("blk", F.explode(F.expr("sequence(0, n_blk - 1)")))
        spread = spread.withColumn("q", F.lit(True))
        both = now.withColumn("q", F.lit(False)).unionByName(spread).select("grp", "blk", "h", "label", "q", name)
        placed = both.repartition("grp", "blk").sortWithinPartitions("grp", "blk")
        found = written(placed.transform(in_tasks, _query_links(kind, name), "a long, b long").distinct(), "found")
        joined = components(found)
        relabel = joined.select(F.col("node").alias("label"), F.col("label").alias("to"))
        keep = now.select(F.col("h").alias("node"), "label").distinct()
        rest = labels.join(now.select(F.col("h").alias("node")), "node", "left_anti")
        labels = keep.unionByName(rest).join(relabel, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        labels = written(labels.distinct(), "labels")
        done = asks.select("grp", "h")
        asked = written(done if asked is None else asked.union(done), "asked")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = texts_of(batch.column("text"))
        for first, end in blocks(texts):
            x, bounds = shingle_sets(texts[first:end], WIDTH)
            h = _set_hash(x, bounds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), list_column(x.view(np.int64), bounds, pa.int64())], names=["h", "items"]
            )


def _grouped(docs: DataFrame, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Signatures of every row, and (h, component_id, names) of every class; ``names``: the group's name comes from it."""
    sig = written(signatures(docs, row), "signatures")
    classes = sig.filter("n_shingles > 0").groupBy("h").agg(
        F.min("doc_id").alias("rep"), F.first("brief").alias("brief"), F.first("bands").alias("bands"), F.max("n_shingles").alias("n")
    )
    classes = written(classes, "classes")
    met = classes.select(F.explode("bands").alias("grp"), "h", F.lit(1).alias("heft"))
    rough = link_groups(met, classes.select("h", "brief"), Briefs, "brief", 2048)
    # sets of classes in rough groups; a class is fetched through its smallest doc_id, or among the rows without one
    wanted = classes.join(rough, F.col("h") == F.col("node"))
    wanted = written(wanted.select("rep", "h", F.col("label").alias("grp"), (F.col("n") + 64).alias("heft")), "wanted")
    reps = wanted.filter("rep is not null").select("rep").distinct()
    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(reps, "rep", "left_semi")
    sets = texts.select("text").transform(in_tasks, _sets, "h long, items array<long>")
    nameless = wanted.filter("rep is null").select("h")
    if not nameless.isEmpty():
        more = docs.filter("doc_id is null").select("text").transform(in_tasks, _sets, "h long, items array<long>")
        sets = sets.unionByName(more.join(nameless, "h", "left_semi"))
    sets = written(sets.dropDuplicates(["h"]), "sets")
    exact = link_groups(wanted.select("grp", "h", "heft"), sets, Sets, "items", 1 << 18)
    named = classes.select("h", "rep").join(exact, F.col("h") == F.col("node"), "left")
    named = named.select("h", "rep", F.coalesce("label", "h").alias("label"))
    # the group's name, and the class that it comes from
    name = named.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "h")).alias("first"))
    of_class = named.join(name, "label").select("h", F.col("first.rep").alias("component_id"), (F.col("h") == F.col("first.h")).alias("names"))
    of_class = written(of_class, "named")
    return sig, of_class


@tidy
def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, h) for every row of ``docs``."""
    sig, of_class = _grouped(docs)
    some = sig.filter("n_shingles > 0").select("doc_id", "n_shingles", "h").join(of_class.drop("names"), "h")
    none = sig.filter("n_shingles = 0").select("doc_id", "n_shingles", "h").withColumn("component_id", F.col("doc_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("doc_id").isNull() & F.col("component_id").isNull())
    out = ["doc_id", "n_shingles", "component_id", kept.alias("kept"), "h"]
    return some.select(*out).unionByName(none.select(*out))


@tidy
def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents that stay: one row of each group, columns as they came.

    Rows are told apart by a key of their own, not by doc_id: of a doc_id with
    two texts each is judged by its text. The row that stays carries the
    group's name; a group without any doc_id keeps one row too. Rows without
    words are in no group and all stay.
    """
    (row,) = fresh(docs, "row")
    rows = with_row_key(docs, row)
    sig, of_class = _grouped(rows, row)
    # found by class and name together, so that a class of many copies is no hot key
    names = of_class.filter("names").select(F.col("h").alias("_h"), "component_id")
    named = sig.filter("n_shingles > 0").join(names, (F.col("h") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("component_id")))
    one = named.groupBy("h").agg(F.min("row").alias(row)).select(row)
    stays = one.unionByName(sig.filter("n_shingles = 0").select(F.col("row").alias(row)))
    return rows.join(stays, row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
