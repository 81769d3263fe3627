import random

import numpy as np

from revq.llm import sentencepiece as sp
from revq.llm import tokens

PATH = sp.model_path()


def greedy(word, first, inner):
    n = i = 0
    while i < len(word):
        vocab = first if i == 0 else inner
        i = next(j for j in range(min(len(word), i + 64), i, -1) if word[i:j] in vocab)
        n += 1
    return n


def vocabularies():
    first, inner = tokens.vocabulary(PATH)
    single = {bytes([b]) for b in range(256)}
    return set(first) | single, set(inner) | single


def test_automaton_equals_greedy_cuts(docs):
    first, inner = vocabularies()
    auto, r = tokens.automaton(PATH), random.Random(2)
    words = {w for x in docs.select("text").collect() for w in x.text.encode().split()}
    words |= {"".join(r.choice("abéñtheraning▁€😀") for _ in range(r.randint(1, 40))).encode() for _ in range(4000)}
    assert all(auto.count(w) == greedy(w, first, inner) for w in words)


def test_counts(docs, odd, empty):
    first, inner = vocabularies()
    for df in (docs, odd):
        got = sorted(((r.doc_id, r.n_words, r.n_tokens) for r in tokens.count_tokens(df).collect()), key=repr)
        texts = [(r.doc_id, (r.text or "").encode().split()) for r in df.select("doc_id", "text").collect()]
        assert got == sorted(((i, len(w), sum(greedy(x, first, inner) for x in w)) for i, w in texts), key=repr)
    assert tokens.count_tokens(empty).count() == 0


def cost(model, ids, text):
    """Cost of an encoding that spells ``text``."""
    total, at = 0, 0
    for i in ids:
        b = model.bytes[i]
        piece = model.piece.get(b.decode(errors="replace"))
        total += piece[1] if piece and piece[0] == i else model.byte_cost
        at += len(b)
    assert at == len(text.encode())
    return total


def test_chunked_scan_is_one_pass(spark):
    """Any chunk size gives the ids of one pass over the whole text, ties included, and the text back."""
    model, r = sp.model(PATH), random.Random(4)
    texts = ["".join(r.choice("ab e  therng\nñ▁€😀") for _ in range(r.randint(40, 400))) for _ in range(30)]
    texts += ["internationalization" * 12, " " * 90, "\n" * 50, "x" * 5000, "the cat " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk in (16, 37):
        rows = sp.decode(sp.encode(df, chunk=chunk), PATH).collect()
        for i, text in enumerate(texts):
            own = sorted((x for x in rows if x.doc_id == i), key=lambda x: x.chunk)
            assert len(own) == -(-(len(text) + 1) // chunk)
            assert "".join(x.decoded for x in own) == text and all(x.text == x.decoded for x in own)
            ids = [y for x in own for y in x.ids]
            assert cost(model, ids, " " + text) == model.best(" " + text)[1]
            assert b"".join(model.encode_all([" " + text])) == np.array(ids, np.int32).tobytes()


def test_ties_across_edges(spark):
    """Runs of one letter have many equally cheap segmentations; every chunk size takes the same one."""
    model = sp.model(PATH)
    texts = ["a" * 157, "aaa " * 60, "=" * 211, "ab" * 90, "\t" * 77, "ee" * 50 + "ñ" + "e" * 61, "0" * 99 + " " * 33 + "0" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk in (16, 23, 50):
        rows = sp.encode(df, chunk=chunk).collect()
        for i, text in enumerate(texts):
            ids = [y for x in sorted((x for x in rows if x.doc_id == i), key=lambda x: x.chunk) for y in x.ids]
            assert tuple(ids) == tuple(np.frombuffer(model.encode_all([" " + text])[0], np.int32).tolist()), (chunk, i)


def test_products_are_associative():
    m = sp.model(PATH)
    text = "the internationalization of   token\ncounting" * 2
    a, b, c = (m.transfer(text[max(0, i - 15) : i], text[i : i + 20]) for i in (0, 20, 40))
    assert (sp.times(sp.times(a, b), c) == sp.times(a, sp.times(b, c))).all()


def test_round_trip(docs, odd, empty):
    for df in (docs, odd):
        rows = sp.decode(sp.encode(df), PATH).collect()
        texts = {}
        for x in sorted(rows, key=lambda x: x.chunk):
            texts.setdefault((x.row, x.doc_id), []).append(x.decoded)
        assert sorted(((k[1], "".join(v)) for k, v in texts.items()), key=repr) == sorted(
            ((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()), key=repr
        )
    assert sp.encode(empty).count() == 0


def test_units_in_step_equal_single_ones():
    m, r = sp.Model(PATH), random.Random(1)
    units = {"".join(r.choice("abéñtheraning▁€😀\x00日本のи") for _ in range(r.randint(1, 30))) for _ in range(6000)}
    units |= {" the", "\n", " " * 300, "x" * 257, "日本" * 200}
    got = m.best_of(list(units))
    assert all(np.frombuffer(got[u], np.int32).tolist() == list(m.best(u)[0]) for u in units)
