"""Token counts: greedy longest-match word pieces, counted without making them.

The vocabulary becomes a trie whose nodes carry a failure link and the number
of pieces that following it pops. A word is read once, byte by byte: where
the trie has no edge, the failure link is followed and its pops are added, so
the work is linear in the word's length. A word's first piece comes from the
vocabulary's word-initial pieces (marked U+2581), the next ones from its inner
pieces; every single byte is an inner piece of last resort, so any word has a
count, the number of pieces greedy longest-match-first would cut it into.

Words are ``[^\\x20\\x09-\\x0D]+``. Counts of words met are remembered per task
(bounded table), so the automaton runs once per distinct word. One scan, no
shuffle.

Nulls and odd input: a null or empty text, or one without words, has 0 words
and 0 tokens; a word of any length takes linear time; repeated rows count alike.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from revq.llm.common import in_tasks, shipped, texts_of

TOKENIZERS = "/opt/tokenizers"
MARK = "▁"  # fixed: word start in the vocabulary file
MEMO, MEMO_LEN = 400_000, 48


def vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """(word-initial pieces, inner pieces) of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    first, inner = [], []
    for i in range(model.get_piece_size()):
        if model.is_byte(i) or model.is_control(i) or model.is_unknown(i):
            continue
        piece = model.id_to_piece(i)
        if piece.startswith(MARK):
            first.append(piece[1:].encode())
        else:
            inner.append(piece.encode())
    return [p for p in first if p and MARK.encode() not in p], inner


class Automaton:
    """Trie over the inner pieces and, under its own root, the word-initial ones."""

    def __init__(self, first: list[bytes], inner: list[bytes]):
        self.next: list[dict[int, int]] = [{}, {}]  # node 0: root of a word, node 1: root inside a word
        whole = [False, False]
        for root, pieces in ((0, first), (1, inner)):
            for piece in [*pieces, *(bytes([b]) for b in range(256))]:
                node = root
                for b in piece:
                    if b not in self.next[node]:
                        self.next[node][b] = len(self.next)
                        self.next.append({})
                        whole.append(False)
                    node = self.next[node][b]
                whole[node] = True
        n = len(self.next)
        # fail[v], pops[v]: the node that spells what is left of v's string after its longest
        # pieces are popped so that a deeper match may go on, and how many pieces that pops
        self.fail, self.pops = [1] * n, [0] * n
        level = [0, 1]
        while level:
            below = []
            for v in level:
                for b, w in self.next[v].items():
                    below.append(w)
                    if whole[w]:
                        self.fail[w], self.pops[w] = 1, 1
                        continue
                    u, popped = self.fail[v], self.pops[v]
                    while b not in self.next[u]:
                        popped += self.pops[u]
                        u = self.fail[u]
                    self.fail[w], self.pops[w] = self.next[u][b], popped
            level = below

    def count(self, word: bytes) -> int:
        """Number of greedy longest-match pieces of a word."""
        step, fail, pops = self.next, self.fail, self.pops
        node, total = 0, 0
        for b in word:
            while (to := step[node].get(b)) is None:
                total += pops[node]
                node = fail[node]
            node = to
        while node > 1:
            total += pops[node]
            node = fail[node]
        return total


_MADE: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """The automaton of a model file, made once per worker process."""
    if path not in _MADE:
        _MADE[path] = Automaton(*vocabulary(path))
    return _MADE[path]


class _Memo(dict):
    def __init__(self, auto: Automaton):
        self.auto = auto

    def __missing__(self, word: bytes) -> int:
        n = self.auto.count(word)
        if len(word) <= MEMO_LEN:
            if len(self) >= MEMO:
                self.clear()
            self[word] = n
        return n


def _counter(name: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _Memo(automaton(SparkFiles.get(name))).__getitem__
        for batch in batches:
            words, tokens = [], []
            for text in texts_of(batch.column("text")):
                parts = text.split()  # bytes: splits at \x20 and \x09-\x0D only
                words.append(len(parts))
                tokens.append(sum(map(look, parts)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())],
                names=["doc_id", "n_words", "n_tokens"],
            )

    return run


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row."""
    path = path or os.path.join(TOKENIZERS, "piece_bpe_32k.model")
    return docs.select("doc_id", "text").transform(in_tasks, _counter(shipped(docs, path)), "doc_id long, n_words long, n_tokens long")
