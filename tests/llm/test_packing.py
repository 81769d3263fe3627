"""Packing: ids against the tokenizer library, every id once, padding, best fit against brute force."""

import random
import zlib
from collections import defaultdict

import numpy as np
from helpers import prose
from tokenizers import Tokenizer

from revq.llm import packing
from revq.llm.queries import op11_best_fit_packing


def padding(lengths, size=2048):
    return sum(0 if not n & (n - 1) else size - n for n in lengths)


def whole(rows):
    """Text row -> its ids, from pieces in any order; and sequence -> used ids."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length and r.length > 0
        docs[r.doc_row].append(r)
        sequences[r.sequence_id].append(r)
    ids = {}
    for row, pieces in docs.items():
        pieces.sort(key=lambda r: r.start)
        assert [r.start for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
        assert {r.doc_tokens for r in pieces} == {sum(r.length for r in pieces)}
        ids[row] = (pieces[0].doc_id, np.frombuffer(b"".join(bytes(r.ids) for r in pieces), "<u4").tolist())
    used = []
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
        used.append(sum(r.length for r in pieces))
    assert max(used, default=0) <= 2048
    return ids, used


def test_ids_and_padding(spark, docs, odd):
    library = Tokenizer.from_file(packing.default_path())
    for df in (docs, odd):
        ids, used = whole(packing.pack(df).collect())
        want = sorted((repr(r.doc_id), [*library.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in df.collect())
        assert sorted((repr(d), x) for d, x in ids.values()) == want
        assert padding(used) <= 0.005 * sum(used)


def test_query_columns(spark):
    rows = op11_best_fit_packing(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    again = {(r.doc_id, r.start): zlib.crc32(bytes(r.ids)) for r in packing.pack(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}
    assert {(r.doc_id, r.start): r.ids_crc32 for r in rows.collect()} == again


def test_slices_do_not_change_ids(monkeypatch):
    encode, library = packing.encoder(packing.default_path()), Tokenizer.from_file(packing.default_path())
    texts = [prose(3, 4000), "x" * 5000, "日本語 " * 900, "a <|endoftext|> b<|endoftext|>c  d\n\n e's 've ½ ² １２ \x1c \x85 ñ 😀" * 40, " " * 300_000 + "a", ""]
    monkeypatch.setattr(packing, "SLICE", 64)
    for text in texts:
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_tightest_window():
    r, room, open_ = random.Random(2), packing.Room(64), {}
    for step in range(3000):
        if r.random() < 0.5:
            open_[step] = r.randint(1, 64)
            room.add(open_[step], step)
        else:
            need = r.randint(1, 64)
            best = min((v for v in open_.values() if v >= need), default=None)
            got = room.tightest(need)
            assert (None if got is None else open_.pop(got)) == best


def test_best_fit_against_plain_scan():
    r = random.Random(3)
    lengths = [r.randint(1, 90) for _ in range(400)]
    used = []
    for n in sorted((n % 64 for n in lengths if n % 64), reverse=True):  # the same rule by a scan over all windows
        fits = [i for i, u in enumerate(used) if u + n <= 64]
        if fits:
            used[max(fits, key=lambda i: used[i])] += n
        else:
            used.append(n)
    made = [sum(p[2] for p in w) for w in packing.best_fit(lengths, 64, spare=64)]
    assert sorted(made) == sorted(used + [64] * sum(n // 64 for n in lengths))


def test_equal_lengths_leave_no_padding():
    for lengths in ([1100] * 500, [1500] * 7, [2047], [1], [3, 5], [5000] * 9, []):
        windows = packing.best_fit(lengths)
        seen = sorted((i, at, n) for w in windows for i, at, n in w)
        for i, n in enumerate(lengths):
            assert sum(k for j, _, k in seen if j == i) == n
        used = [sum(p[2] for p in w) for w in windows]
        assert padding(used) <= packing.SPARE * len(windows) and max(used, default=0) <= 2048


def test_groups_and_sequences(spark, docs, monkeypatch):
    packed = packing.pack(docs)
    out = packing.sequences(packed, pad=7).collect()
    _, used = whole(packed.collect())
    assert sorted(r.n_ids for r in out) == sorted(used)
    for r in out:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == (r.n_ids if not r.n_ids & (r.n_ids - 1) else 2048) and set(ids[r.n_ids :].tolist()) <= {7}


def test_many_groups():
    r = random.Random(4)
    held = [(i, i, np.arange(r.randint(1, 5000), dtype=np.uint32)) for i in range(300)]
    batches = list(packing._rows(held, 2048, 8, 5 << 40, 3))
    rows = [x for _, b in batches for x in b.to_pylist()]
    assert sum(x["length"] for x in rows) == sum(len(h[2]) for h in held)
    assert {x["sequence_id"] for x in rows} == {5 << 40 | k for k in range(3, batches[-1][0])}


def test_empty_table(spark, empty):
    assert packing.pack(empty).collect() == []
