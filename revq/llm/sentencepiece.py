"""SentencePiece encoding by a max-plus (best path) scan, and decoding.

The pieces of a public model file are used as a unigram vocabulary: a piece
costs ``round(1024 * ln(rank + 2))`` with its rank in the file, a character
without a piece costs ``BYTE_COST`` per UTF-8 byte, and the best segmentation
of the text (a blank in front, blanks as U+2581) is the cheapest one. Costs
are integers, so sums are exact in any order.

No piece goes from a non-blank to a blank and none holds a line feed, so every
run of blanks and every line feed begins a new unit. A text up to ``CHUNK``
code points is encoded unit by unit. A giant text is cut every ``CHUNK`` code
points, wherever that falls. The state at a boundary is how far before it the
last cut lies (0 to 15, a piece has at most 16 code points); a chunk yields
the 16 x 16 matrix of cheapest ways from each state at its left edge to each
at its right edge. Matrices are multiplied in (min, +) in blocks of
``FAN`` chunks and the block products are scanned per document, which gives
the cheapest costs at every chunk's left edge. With these each chunk finds its
way back by itself, a table from a state at its right edge to one at its left
edge; the tables are combined from the text's end, and every chunk is then
traced back between its two known cuts. Chunks are rows, so a giant text is
spread over tasks; what one task holds of a document is 2 KB a chunk.

Among equally cheap segmentations the longest last piece wins, from the end of
a unit backwards. The ways back follow the same rule, so a text has the same
ids whatever the size of the chunks, cut or not. Decoding joins the pieces' bytes, so
decode(encode(text)) == text for every text; a literal U+2581 is kept apart
from blanks by its bytes.

Nulls and odd input: a null or empty text has one chunk without ids and
decodes to an empty text; repeated rows are encoded one by one; extra columns
are not touched; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revq.llm.common import in_tasks, list_column, shipped, tidy, written
from revq.llm.tokens import MARK, TOKENIZERS

CHUNK, FAN = 1 << 15, 64
REACH = 16  # fixed: longest piece of the model file
FAR = 1 << 60
MEMO, MEMO_LEN = 60_000, 48
BLOCK, WIDE = 4096, 256  # units segmented in step; longer ones go one by one
SLICE = 1 << 20  # bytes of text that are Python objects at a time
UNIT = re.compile(r" +[^ \n]*|[^ \n]+|\n")
PIECES = "row long, doc_id long, chunk int, n_chunks int, text string, ids array<int>"


class Model:
    """Pieces with their costs, and the bytes of every id."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.piece: dict[str, tuple[int, int]] = {}  # text -> (id, cost)
        self.bytes: list[bytes] = [b""] * n
        self.byte_id: list[int] = [0] * 256
        rank = 0
        for i in range(n):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                b = int(name[3:5], 16)
                self.byte_id[b], self.bytes[i] = i, bytes([b])
            elif not (model.is_control(i) or model.is_unknown(i)):
                text = name.replace(MARK, " ")
                self.piece[text] = (i, round(1024 * math.log(rank + 2)))
                self.bytes[i] = text.encode()
                rank += 1
        self.byte_cost = round(1024 * 1.5 * math.log(n))
        self.id_cost = np.full(n, self.byte_cost, np.int64)
        for i, c in self.piece.values():
            self.id_cost[i] = c
        self.base: np.ndarray | None = None
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _lay_out(self) -> None:
        """The piece trie in flat arrays: from node ``s`` character ``c`` leads to ``base[s] + code[c]`` if ``above`` of that is ``s``."""
        children: dict[str, list[str]] = {text[:k]: [] for text in self.piece for k in range(len(text) + 1)}
        uses: dict[str, int] = {}
        for prefix in children:
            if prefix:
                children[prefix[:-1]].append(prefix[-1])
                uses[prefix[-1]] = uses.get(prefix[-1], 0) + 1
        code = {c: k for k, c in enumerate(sorted(uses, key=lambda c: (-uses[c], c)), 1)}
        size = 2 * len(children) + 2 * len(code) + 2
        taken, free, fan, bases = bytearray(b"\1") + bytes(size), 1, 0, {}
        for prefix in sorted((x for x in children if children[x]), key=lambda x: -len(children[x])):
            codes = sorted(code[c] for c in children[prefix])
            free, fan = (free if len(codes) == fan else 1), len(codes)  # places that one node did not fit are passed over by the next of its size
            at = max(taken.index(0, free) - codes[0], 0)
            while any(taken[at + c] for c in codes):
                at = taken.index(0, at + codes[0] + 1) - codes[0]
            bases[prefix], free = at, at + codes[0]
            for c in codes:
                taken[at + c] = 1
        slot = {x: bases[x[:-1]] + code[x[-1]] if x else 0 for x in children}
        base, above = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        for prefix, at in slot.items():
            base[at] = bases.get(prefix, 0)
            if prefix:
                above[at] = slot[prefix[:-1]]
        self.base, self.above = base, above
        self.code = np.zeros(0x110000, np.int32)
        for c, k in code.items():
            self.code[ord(c)] = k
        self.node_id, self.node_cost = np.full(size, -1, np.int32), np.full(size, FAR, np.int64)
        for text, (i, c) in self.piece.items():
            self.node_id[slot[text]], self.node_cost[slot[text]] = i, c
        self.alone = np.zeros(len(code) + 1, bool)  # characters that are pieces
        for c, k in code.items():
            self.alone[k] = c in self.piece

    def steps(self, text: str, end: int) -> list[tuple[int, int]]:
        """(start, cost) of the pieces of ``text`` that end at ``end``, longest first."""
        out = []
        for start in range(max(0, end - REACH), end):
            p = self.piece.get(text[start:end])
            if p:
                out.append((start, p[1]))
        if not out or out[-1][0] != end - 1:
            out.append((end - 1, self.byte_cost * len(text[end - 1].encode())))
        return out

    def best(self, text: str) -> tuple[tuple[int, ...], int]:
        """Ids and cost of the cheapest segmentation."""
        cost, back = [0], [0]
        for end in range(1, len(text) + 1):
            least = FAR
            for start, c in self.steps(text, end):
                if cost[start] + c < least:
                    least, first = cost[start] + c, start
            cost.append(least)
            back.append(first)
        ids: list[int] = []
        end = len(text)
        while end:
            p = self.piece.get(text[back[end] : end])
            ids.extend([p[0]] if p else [self.byte_id[b] for b in reversed(text[back[end] : end].encode())])
            end = back[end]
        ids.reverse()
        return tuple(ids), cost[-1]

    def _block(self, units: list[str]) -> list[bytes]:
        """``best`` of units of pieces alone, shortest first, all in step: ids as int32 bytes."""
        lens = np.fromiter(map(len, units), np.int64, len(units))
        n, width = len(units), int(lens[-1])
        codes = np.ascontiguousarray(self.code[np.array(units, f"<U{width}").view(np.uint32).reshape(n, width)].T)
        cost = np.full((width + 1, n), FAR, np.int64)
        cost[0] = 0
        back, piece = np.zeros((width + 1, n), np.int64), np.zeros((width + 1, n), np.int32)
        for start in range(width):
            rows = np.arange(np.searchsorted(lens, start, "right"), n)
            node, so_far = np.zeros(len(rows), np.int32), cost[start, rows]
            for end in range(start + 1, min(start + REACH, width) + 1):
                to = self.base[node] + codes[end - 1, rows]
                on = np.flatnonzero(self.above[to] == node)
                if not len(on):
                    break
                rows, node, so_far = rows[on], to[on], so_far[on]
                total = so_far + self.node_cost[node]
                less = np.flatnonzero(total < cost[end, rows])
                at = rows[less]
                cost[end, at], back[end, at], piece[end, at] = total[less], start, self.node_id[node[less]]
        ids, first, end, live = np.zeros((n, width), np.int32), np.full(n, width), lens.copy(), np.arange(n)
        while len(live):
            first[live] -= 1
            ids[live, first[live]] = piece[end[live], live]
            end[live] = back[end[live], live]
            live = live[end[live] > 0]
        raw, row = ids.tobytes(), 4 * width
        return [raw[k * row + 4 * f : (k + 1) * row] for k, f in enumerate(first.tolist())]

    def best_of(self, units: list[str]) -> dict[str, bytes]:
        """``best`` of many different units: ids as int32 bytes."""
        if self.base is None:
            self._lay_out()
        out: dict[str, bytes] = {}
        units = sorted(units, key=len)
        for at in range(0, len(units), BLOCK):
            some = units[at : at + BLOCK]
            odd = np.flatnonzero(~self.alone[self.code[np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32)]])
            if len(odd) or len(some[-1]) > WIDE:
                ends = np.cumsum([len(u) for u in some])
                slow = set(np.searchsorted(ends, odd, "right").tolist()) | {k for k, u in enumerate(some) if len(u) > WIDE}
                out.update((some[k], np.array(self.best(some[k])[0], np.int32).tobytes()) for k in slow)
                some = [u for k, u in enumerate(some) if k not in slow]
            if some:
                out.update(zip(some, self._block(some), strict=True))
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids, as int32 bytes, of stretches of marked text whose ends are cuts. Short units are remembered (bounded tables)."""
        units = [UNIT.findall(t) for t in texts]
        met = set(chain.from_iterable(units))
        new = met.difference(self.memo)
        if len(self.memo) + len(new) > MEMO:  # units not met since the last turn are forgotten
            self.old, self.memo, new = self.memo, {}, met
        self.memo.update((u, self.old[u]) for u in new if u in self.old)
        self.memo.update(self.best_of([u for u in new if u not in self.memo]))
        ids = [b"".join(map(self.memo.__getitem__, u)) for u in units]
        for u in [u for u in new if len(u) > MEMO_LEN]:
            del self.memo[u]
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8")

    def transfer(self, context: str, text: str) -> np.ndarray:
        """(16 x 16) cheapest costs from a cut ``i`` before the chunk to a last cut ``j`` before its end."""
        whole, a = context + text, len(context)
        n = len(whole)
        # units that begin inside the chunk are cuts of every path
        starts = [m.start() for m in UNIT.finditer(whole) if m.start() > a]
        head_end = starts[0] if starts else n
        rows = np.full((REACH, head_end - a + 1), FAR, np.int64)  # cost of a cut at a + k per entry state
        for k in range(1, head_end - a + 1):
            for start, c in self.steps(whole, a + k):
                if start > a:
                    np.minimum(rows[:, k], rows[:, start - a] + c, out=rows[:, k])
                elif a - start < REACH:
                    rows[a - start, k] = min(rows[a - start, k], c)
        out = np.full((REACH, REACH), FAR, np.int64)
        if not starts:
            for j in range(min(REACH, n - a)):
                out[:, j] = rows[:, n - a - j]
            return np.minimum(out, FAR)
        middle = int(self.id_cost[np.frombuffer(self.encode_all([whole[starts[0] : starts[-1]]])[0], np.int32)].sum())
        tail, last = whole[starts[-1] :], starts[-1]
        cost = [0] * (len(tail) + 1)
        for end in range(1, len(tail) + 1):
            cost[end] = min(cost[start] + c for start, c in self.steps(tail, end))
        enter = np.minimum(rows[:, -1] + middle, FAR)
        for j in range(REACH):
            at = n - j - last
            if at >= 0:
                out[:, j] = np.minimum(enter + cost[at], FAR)
        return out

    def entries(self, context: str, text: str, reach: np.ndarray) -> list[int]:
        """For each state at the chunk's right edge the one at its left edge, on the path that one pass would take.

        ``reach`` are the costs of the cheapest ways to each state at the left
        edge; as in ``best``, the longest last piece wins among equal costs.
        """
        whole, a = context + text, len(context)
        end_of_head = next((m.start() for m in UNIT.finditer(whole) if m.start() > a), len(whole))
        cost = {a - i: int(c) for i, c in enumerate(reach) if i <= a and c < FAR}
        back: dict[int, int] = {}
        for end in range(a + 1, end_of_head + 1):
            least = FAR
            for start, c in self.steps(whole, end):
                if start in cost and cost[start] + c < least:
                    least, back[end] = cost[start] + c, start
            if least < FAR:
                cost[end] = least
        out = []
        for j in range(REACH):
            at = min(len(whole) - j, end_of_head)
            while at > a and at in back:
                at = back[at]
            out.append(min(max(a - at, 0), REACH - 1))
        return out


_MADE: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _MADE:
        _MADE[path] = Model(path)
    return _MADE[path]


def model_path(path: str | None = None) -> str:
    return path or os.path.join(TOKENIZERS, "piece_bpe_32k.model")


def _id_lists(lists: list[bytes]) -> pa.Array:
    bounds = np.append(0, np.cumsum([len(x) // 4 for x in lists]))
    return list_column(np.frombuffer(b"".join(lists), np.int32), bounds, pa.int32())


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about ``SLICE`` bytes of text, or one row."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < batch.num_rows:
            before = upto[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(upto, before + SLICE, "right")))
            yield batch.slice(first, last - first)
            first = last


def _small(name: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(SparkFiles.get(name))
        for part in _slices(batches):
            texts = [t or "" for t in part.column("text").to_pylist()]
            ids = m.encode_all([" " + t if t else "" for t in texts])
            n = len(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("row"), part.column("doc_id"), pa.array([0] * n, pa.int32()), pa.array([1] * n, pa.int32()),
                    pa.array(texts, pa.string()), _id_lists(ids),
                ],
                names=["row", "doc_id", "chunk", "n_chunks", "text", "ids"],
            )
        m.old = {}  # a worker that goes on to other work holds one table of units

    return run


def _cut(chunk: int) -> Callable:
    """Giant texts as chunk rows, each with the code points before it that a piece may reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                marked = " " + text
                n = -(-len(marked) // chunk)
                for k in range(n):
                    a = k * chunk
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row], pa.int64()), pa.array([doc_id], pa.int64()), pa.array([k], pa.int32()), pa.array([n], pa.int32()),
                            pa.array([marked[max(0, a - REACH + 1) : a]], pa.string()), pa.array([marked[a : a + chunk]], pa.string()),
                        ],
                        names=["row", "doc_id", "chunk", "n_chunks", "context", "text"],
                    )

    return run


def _matrices(name: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(SparkFiles.get(name))
        for batch in _slices(batches):
            mats = [m.transfer(c, t).tobytes() for c, t in zip(batch.column("context").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("chunk"), batch.column("n_chunks"), pa.array(mats, pa.binary())], names=["row", "chunk", "n_chunks", "m"]
            )

    return run


def _matrix(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.int64).reshape(REACH, REACH)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(min, +) product; associative, as costs are integers."""
    return np.minimum((a[:, :, None] + b[None]).min(axis=1), FAR)


def _product(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("chunk")
    total = _matrix(pdf["m"].iloc[0])
    for b in pdf["m"].iloc[1:]:
        total = times(total, _matrix(b))
    return pd.DataFrame({"row": [pdf["row"].iloc[0]], "part": [pdf["chunk"].iloc[0] // FAN], "m": [total.tobytes()]})


def _forward(mats: list[np.ndarray], reach: np.ndarray) -> list[bytes]:
    """Costs of the cheapest ways to each state at the left edge of each matrix."""
    out = []
    for m in mats:
        out.append(reach.tobytes())
        reach = np.minimum((reach[:, None] + m).min(axis=0), FAR)
    return out


def _scan(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per document over its block products: costs at the blocks' left edges."""
    pdf = pdf.sort_values("part")
    at_start = np.where(np.arange(REACH) == 0, 0, FAR).astype(np.int64)
    return pd.DataFrame({"row": pdf["row"], "part": pdf["part"], "reach": _forward([_matrix(b) for b in pdf["m"]], at_start)})


def _descend(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per block: costs at its chunks' left edges."""
    pdf = pdf.sort_values("chunk")
    first = np.frombuffer(pdf["reach"].iloc[0], np.int64)
    return pd.DataFrame({"row": pdf["row"], "chunk": pdf["chunk"], "reach": _forward([_matrix(b) for b in pdf["m"]], first)})


def _entries(name: str) -> Callable:
    """Each chunk's way back: from a state at its right edge to one at its left edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(SparkFiles.get(name))
        for batch in _slices(batches):
            back = [
                bytes(m.entries(c, t, np.frombuffer(r, np.int64)))
                for c, t, r in zip(*(batch.column(x).to_pylist() for x in ("context", "text", "reach")), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("chunk"), pa.array(back, pa.binary())], names=["row", "chunk", "back"])

    return run


def _ways_back(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per block: the way back through all its chunks."""
    total = list(range(REACH))
    for back in pdf.sort_values("chunk", ascending=False)["back"]:
        total = [back[j] for j in total]
    return pd.DataFrame({"row": [pdf["row"].iloc[0]], "part": [pdf["part"].iloc[0]], "back": [bytes(total)]})


def _walk(backs: list[bytes], state: int) -> list[int]:
    """The states at the right edges, from the last one backwards."""
    out = []
    for back in reversed(backs):
        out.append(state)
        state = back[state]
    return out[::-1]


def _leave(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per document: the state at each block's right edge; the text's end is a cut."""
    pdf = pdf.sort_values("part")
    return pd.DataFrame({"row": pdf["row"], "part": pdf["part"], "leave": _walk(pdf["back"].tolist(), 0)})


def _edges(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per block: the states at its chunks' edges."""
    pdf = pdf.sort_values("chunk")
    leave = _walk(pdf["back"].tolist(), int(pdf["leave"].iloc[0]))
    enter = [back[j] for back, j in zip(pdf["back"], leave, strict=True)]
    return pd.DataFrame({"row": pdf["row"], "chunk": pdf["chunk"], "enter": enter, "leave": leave})


def _trace(name: str) -> Callable:
    """Each chunk between its two cuts, on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(SparkFiles.get(name))
        for batch in _slices(batches):
            enter, leave = batch.column("enter").to_pylist(), batch.column("leave").to_pylist()
            texts = [
                c[len(c) - i :] + (t[: len(t) - j] if j else t)
                for c, t, i, j in zip(batch.column("context").to_pylist(), batch.column("text").to_pylist(), enter, leave, strict=True)
            ]
            ids = m.encode_all(texts)
            shown = [t[1:] if k == 0 else t for t, k in zip(texts, batch.column("chunk").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "doc_id", "chunk", "n_chunks")), pa.array(shown, pa.string()), _id_lists(ids)],
                names=["row", "doc_id", "chunk", "n_chunks", "text", "ids"],
            )

    return run


def encode_giants(docs: DataFrame, name: str, chunk: int) -> DataFrame:
    """Piece rows of (row, doc_id, text) whose texts are cut into chunks."""
    cut = docs.transform(in_tasks, _cut(chunk), "row long, doc_id long, chunk int, n_chunks int, context string, text string")
    cut = written(cut.repartition("row", "chunk"), "chunks")
    mats = written(cut.transform(in_tasks, _matrices(name), "row long, chunk int, n_chunks int, m binary"), "matrices")
    part = F.expr(f"chunk div {FAN}").cast("long")
    mats = mats.withColumn("part", part)
    products = mats.groupBy("row", "part").applyInPandas(_product, "row long, part long, m binary")
    starts = products.groupBy("row").applyInPandas(_scan, "row long, part long, reach binary")
    reach = mats.join(starts, ["row", "part"]).groupBy("row", "part").applyInPandas(_descend, "row long, chunk int, reach binary")
    back = cut.join(reach, ["row", "chunk"]).select("row", "chunk", "context", "text", "reach")
    back = written(back.transform(in_tasks, _entries(name), "row long, chunk int, back binary"), "back").withColumn("part", part)
    whole = back.groupBy("row", "part").applyInPandas(_ways_back, "row long, part long, back binary")
    ends = whole.groupBy("row").applyInPandas(_leave, "row long, part long, leave int")
    states = back.join(ends, ["row", "part"]).groupBy("row", "part").applyInPandas(_edges, "row long, chunk int, enter int, leave int")
    return cut.join(states, ["row", "chunk"]).transform(in_tasks, _trace(name), PIECES)


@tidy
def encode(docs: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """(row, doc_id, chunk, n_chunks, text, ids): the pieces of every row, a row per chunk.

    ``row`` tells input rows apart, ``text`` is what the chunk's ids spell.
    """
    name = shipped(docs, model_path(path))
    giant = F.coalesce(F.length("text") >= chunk, F.lit(False))
    rows = docs.select("doc_id", "text")
    small = rows.filter(~giant).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").transform(in_tasks, _small(name), PIECES)
    large = rows.filter(giant).select((-1 - F.monotonically_increasing_id()).alias("row"), "doc_id", "text")
    return small.unionByName(encode_giants(large, name, chunk))


def decode(pieces: DataFrame, path: str | None = None) -> DataFrame:
    """``pieces`` with ``decoded``: the text that each chunk's ids spell."""
    name = shipped(pieces, model_path(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(SparkFiles.get(name))
        for batch in _slices(batches):
            ids = batch.column("ids")
            at = (ids.offsets.to_numpy() - ids.offsets[0].as_py()).tolist()
            flat = ids.flatten().to_numpy().tolist()
            decoded = [m.decode(flat[a:z]) for a, z in zip(at[:-1], at[1:], strict=True)]
            chunks = batch.column("chunk").to_pylist()
            decoded = [d[1:] if k == 0 else d for d, k in zip(decoded, chunks, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.string())], names=[*batch.schema.names, "decoded"])

    return pieces.transform(in_tasks, run, f"{PIECES}, decoded string")
