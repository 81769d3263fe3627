"""Packing token ids into fixed windows by best-fit decreasing.

A document is its token ids and one end id. What is longer than a window is
first cut into full windows; the rests are placed longest first, each into the
tightest window it fits (``Room``: a segment tree indexed by the capacity
left), or a new one. Windows that are still short by more than ``SPARE`` ids
are laid end to end and cut again into full ones (``recut``); the last of them
is cut at powers of two, which need no padding. So padding is under
``SPARE`` / window size however the lengths lie, a corpus of equal lengths
included.

Scale: one scan, no shuffle. A task packs its rows in groups of about
``GROUP`` ids, so memory does not depend on the number of rows; a group holds
thousands of windows, enough for a close fit. A text is encoded in slices cut
where the pre-tokenizer cuts anyway, so the ids do not change; at most one
document's ids are held beyond the group. Sequence ids carry the task's
number. A task that is lost is run again on the same split and gives the same
rows; give a scan or a written table, not the unordered output of a shuffle.

The ids are those of the ``tokenizers`` file. Its vocabulary is proven to be
ranked by merge order and then encoded by the quicker ``tiktoken``; a file
that is not, or a text that it refuses, goes through ``tokenizers`` itself.

Nulls and odd input: a null or empty text is the end id alone; a null doc_id
is kept; equal rows are packed one by one (``doc_row`` tells them apart); a
text of any length is packed whole; an empty table gives an empty one; other
columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revq.llm.common import in_tasks, shipped, texts_of

SIZE = 2048  # fixed: ids a window
END = 1  # fixed: id after each document
SPARE = 8  # ids that a window may lack
GROUP = 1 << 22  # ids packed together
SLICE = 1 << 16  # code points encoded at once
OUT_IDS = 1 << 20  # ids in one batch of rows
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")  # a lone space begins a pre-token, whatever stands around it
SCHEMA = "doc_id long, doc_row long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """Byte-level alphabet: printable Latin-1 stands for itself, the rest follows from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranked(spec: dict, pattern: str):
    """A tiktoken encoding of a byte-level BPE file, or None where ids are not merge ranks."""
    import tiktoken

    model, vocab = spec["model"], spec["model"]["vocab"]
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    plain = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    in_order = [vocab.get(m) for m in merges] == list(range(256, 256 + len(merges))) and len(vocab) == 256 + len(merges)
    if not in_order or spec["pre_tokenizer"] != plain or spec["normalizer"] or model["type"] != "BPE" or model.get("ignore_merges"):
        return None
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        return None
    byte = _byte_of()
    ranks = {bytes(byte[c] for c in word): i for word, i in vocab.items()}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in spec["added_tokens"]})


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Token ids of one text, as the tokenizer file gives them without special tokens added."""
    from tokenizers import Tokenizer

    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed: the byte-level pre-tokenizer's
    with open(path, encoding="utf-8") as f:
        ranked = _ranked(json.load(f), pattern)
    library = Tokenizer.from_file(path)

    def part(text: str) -> np.ndarray:
        if ranked is not None:
            try:
                return ranked.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # very long runs of blanks are beyond its pattern engine
                pass
        return np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(text: str) -> np.ndarray:
        if ranked is None or len(text) <= SLICE:
            return part(text).astype(np.uint32, copy=False)
        out, at = [], 0
        while at < len(text):
            cut = SAFE_CUT.search(text, at + SLICE)
            to = cut.start() if cut else len(text)
            out.append(part(text[at:to]))
            at = to
        return np.concatenate(out).astype(np.uint32, copy=False)

    return encode


_MADE: dict[str, Callable[[str], np.ndarray]] = {}


def _encoder(path: str) -> Callable[[str], np.ndarray]:
    """Made once per worker process."""
    if path not in _MADE:
        _MADE[path] = encoder(path)
    return _MADE[path]


class Room:
    """Open windows by the capacity left: a segment tree whose nodes count the windows below."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, left: int, window: int) -> None:
        self.open[left].append(window)
        node = self.leaves + left
        while node:
            self.count[node] += 1
            node >>= 1

    def tightest(self, need: int) -> int | None:
        """Take out the window whose capacity is the smallest that is ``need`` or more."""
        count, leaves = self.count, self.leaves
        node = leaves + need
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):  # up to the first right neighbour with windows
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        window = self.open[node - leaves].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return window


Piece = tuple[int, int, int]  # item, first id, number of ids


def recut(pieces: list[Piece], size: int) -> list[list[Piece]]:
    """Pieces end to end in full windows; what is left over at the end goes into powers of two."""
    total = sum(n for _, _, n in pieces)
    left = total % size
    wanted = [size] * (total // size) + [1 << b for b in reversed(range(size.bit_length())) if left >> b & 1]
    windows: list[list[Piece]] = []
    queue = iter(pieces)
    item, at, n = 0, 0, 0
    for room in wanted:
        window: list[Piece] = []
        while room:
            if not n:
                item, at, n = next(queue)
            k = min(n, room)
            window.append((item, at, k))
            at, n, room = at + k, n - k, room - k
        windows.append(window)
    return windows


def best_fit(lengths: list[int], size: int = SIZE, spare: int = SPARE) -> list[list[Piece]]:
    """Windows of pieces that hold every id of every item once."""
    windows: list[list[Piece]] = [[(i, at, size)] for i, n in enumerate(lengths) for at in range(0, n - size + 1, size)]
    rest = [n % size for n in lengths]
    room, made, used = Room(size), [], []
    for i in sorted((i for i, r in enumerate(rest) if r), key=rest.__getitem__, reverse=True):
        w = room.tightest(rest[i])
        if w is None:
            w = len(made)
            made.append([])
            used.append(0)
        made[w].append((i, lengths[i] - rest[i], rest[i]))
        used[w] += rest[i]
        if used[w] < size:
            room.add(size - used[w], w)
    loose: list[Piece] = []
    for window, n in zip(made, used, strict=True):
        if size - n > spare and n & (n - 1):
            loose += window
        else:
            windows.append(window)
    return windows + recut(loose, size)


def _rows(held: list[tuple], size: int, spare: int, tag: int, first: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(windows so far, batch) of one group of (doc_id, doc_row, ids)."""
    windows = best_fit([len(ids) for _, _, ids in held], size, spare)
    out: list[list] = [[] for _ in range(8)]
    in_out = 0
    for k, window in enumerate(windows):
        offset = 0
        for item, at, n in window:
            doc_id, doc_row, ids = held[item]
            row = (doc_id, doc_row, at, n, ids[at : at + n].astype("<u4", copy=False).tobytes(), len(ids), tag | (first + k), offset)
            for column, value in zip(out, row, strict=True):
                column.append(value)
            offset += n
        in_out += offset
        if in_out >= OUT_IDS or k == len(windows) - 1:
            kinds = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 3
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            yield first + k + 1, pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)
            out, in_out = [[] for _ in range(8)], 0


def _packer(name: str, size: int, spare: int, end: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(SparkFiles.get(name))
        tag = TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        in_held = made = seen = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
                ids = np.append(encode(text.decode("utf-8", "replace")), np.uint32(end))
                held.append((doc_id, tag | seen, ids))
                seen += 1
                in_held += len(ids)
                if in_held >= GROUP:
                    for made, rows in _rows(held, size, spare, tag, made):
                        yield rows
                    held, in_held = [], 0
        if held:
            for made, rows in _rows(held, size, spare, tag, made):
                yield rows

    return run


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, spare: int = SPARE, end: int = END) -> DataFrame:
    """A row per piece: doc_id, doc_row, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset."""
    path = path or default_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.transform(in_tasks, _packer(shipped(docs, path), size, spare, end), SCHEMA)


def sequences(packed: DataFrame, size: int = SIZE, pad: int = 0) -> DataFrame:
    """(sequence_id, n_ids, ids) of every window, padded to ``size`` unless its length is a power of two.

    A window has at most ``size`` pieces, so no group is larger than that.
    """
    pieces = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("pieces"))
    ids = F.aggregate("pieces", F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x["ids"]))
    whole = F.expr("n_ids & (n_ids - 1)") == 0
    fill = F.lit(np.array([pad], "<u4").tobytes())
    return pieces.select("sequence_id", "n_ids", F.when(whole, ids).otherwise(F.rpad(ids, F.lit(4 * size), fill)).alias("ids"))
